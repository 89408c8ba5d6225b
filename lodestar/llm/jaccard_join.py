"""Similarity join of texts by the Jaccard similarity of their word n-grams.

Adaptive multi-match prefixes.  In a common order of all shingles, rare ones
first, two sets that are similar enough share a shingle of their first few, and
``l`` of them if ``l - 1`` more are taken.  Every set lengthens its prefix as far
as its estimated cost asks for: long lists of candidates are worth more shared
shingles before anything is verified.

The order needs to know how many texts hold each shingle, of all texts.  Shingles
are counted by an exchange of packed arrays: groups of texts send theirs, sorted,
to buckets of the hash space; buckets answer each group which of its shingles
other texts hold as well, and how many.  Shingles of one text alone are never in
common, so sets go on with the others: most sets have too few of those and are
done.  A shingle that many texts of a group hold is sent once, with its count.

Sets meet in blocks of a prefix shingle (:mod:`lodestar.llm.linking`), pairs must
share as many prefix shingles as both prefixes promise, and those are verified on
all shingles in common.  Shingles are known by 64 bits of hash, in the exchange
and when they are verified by 48; what that can join wrongly within a set is
allowed for.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import durable, meet, partitions, prepare, small
from lodestar.llm.linking import LARGE, in_blocks, least_overlap, link, sketch
from lodestar.llm.suffix_dedup import _bit_map as bit_map
from lodestar.llm.suffix_dedup import _in_map as in_map

WORDS, PERCENT = 5, 80
#: Shingles of a group of texts, about, and texts of one at most.
TOKENS, TEXTS = 1 << 20, 60_000
#: Texts of a group that hold a shingle beyond which it is sent once; its place among texts then.
BULK, NOBODY = 32, 0xFFFF
#: Counts of texts that are told apart.
COUNTED = 0xFFFF
#: Shingles that a prefix may be asked to share.
MATCHES = np.array([1, 2, 4, 8, 16, 32, 64])
#: Cost of verifying a candidate, in entries of candidate lists.
VERIFY = 40.0
LOW = np.uint64(16)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's different word shingles, sorted; of fewer words the whole sequence is one; none without words."""
    parts = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    digest = xxhash.xxh64_intdigest
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([digest(b" ".join(parts), len(parts))], np.uint64)
    each = np.fromiter(map(digest, parts), np.uint64, len(parts))
    n = len(each) - words + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def node_of(own: np.ndarray) -> int:
    """Name of a set, a signed long."""
    return xxhash.xxh64_intdigest(own.tobytes()) - 2**63


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: the high bytes of sorted ones hardly change and compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


# -- the exchange of counts ------------------------------------------------------


def _packed(sets: list[np.ndarray], nodes: list[int], buckets: int) -> Iterator[tuple[int, bytes]]:
    """A group of sets to ``(bucket, packed)``; bucket -1 is a note for the group itself."""
    tokens = [np.unique(own >> LOW) for own in sets]
    sizes, distinct = np.array([len(x) for x in sets]), np.array([len(x) for x in tokens])
    entry = np.sort((np.concatenate(tokens) << LOW) | np.repeat(np.arange(len(sets), dtype=np.uint64), distinct))
    token = entry >> LOW
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    counts = np.diff(np.r_[starts, len(token)])
    many = counts > BULK
    bulk, n_bulk = token[starts[many]], counts[many]
    inside = np.repeat(many, counts)
    holders = (entry[inside] & np.uint64(NOBODY)).astype(np.uint16)
    entry = np.sort(np.concatenate([entry[~inside], (bulk << LOW) | np.uint64(NOBODY)]))
    yield -1, pickle.dumps((np.array(nodes, np.int64), sizes, distinct, bulk, n_bulk, holders))
    bounds = np.array([(i << 48) // buckets for i in range(1, buckets)], np.uint64)
    cuts, at = np.searchsorted(entry, bounds << LOW).tolist(), np.searchsorted(bulk, bounds).tolist()
    for i, (a, b, c, d) in enumerate(zip([0, *cuts], [*cuts, len(entry)], [0, *at], [*at, len(bulk)])):
        yield i, (b - a).to_bytes(4, "little") + planes(entry[a:b]) + planes(n_bulk[c:d].astype(np.uint32)) if b > a else b""


def _send(held: np.ndarray, words: int, buckets: int):
    """``at, text`` to ``team, bucket, packed`` of the texts that stand for their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        have, n, team = set(), 0, TaskContext.get().partitionId() << 24

        def batch() -> pa.RecordBatch:
            rows = [(i, x) for i, x in _packed(sets, nodes, buckets) if x]
            return pa.RecordBatch.from_arrays([pa.array([team] * len(rows), pa.int64()), pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["team", "bucket", "packed"])

        for b in batches:
            b = b.filter(pa.array(in_map(held, np.asarray(b.column(0)))))
            for text in b.column(1):
                own = shingles(text.as_py(), words)
                node = node_of(own)
                if not len(own) or node in have:
                    continue
                have.add(node)
                sets.append(own)
                nodes.append(node)
                n += len(own)
                if n >= TOKENS or len(sets) >= TEXTS:
                    yield batch()
                    sets, nodes, have, n, team = [], [], set(), 0, team + 1
        if sets:
            yield batch()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to ``team, packed``: entries of shingles that several texts hold, and by how many."""

    def answers(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        entries, bulks, counts = [], [], []
        for _, data in rows:
            n = int.from_bytes(data[:4], "little")
            entry = unplaned(data[4 : 4 + 8 * n], np.uint64)
            entries.append(entry)
            bulks.append(entry[(entry & np.uint64(NOBODY)) == NOBODY] >> LOW)
            counts.append(unplaned(data[4 + 8 * n :], np.uint32))
        bulk, n_bulk = np.concatenate(bulks), np.concatenate(counts).astype(np.int64)
        token = np.sort(np.concatenate([*[e >> LOW for e in entries], bulk]))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        n = np.diff(np.r_[starts, len(token)])
        token, n = token[starts[n > 1]], n[n > 1]
        np.add.at(n, np.searchsorted(token, bulk), n_bulk - 2)
        n = np.minimum(n, COUNTED).astype(np.uint16)
        out = []
        for (team, _), entry in zip(rows, entries):
            own = entry >> LOW
            at = np.minimum(np.searchsorted(token, own), max(0, len(token) - 1))
            keep = token[at] == own if len(token) else np.zeros(len(own), bool)
            if keep.any():
                out.append((team, int(keep.sum()).to_bytes(4, "little") + planes(entry[keep]) + planes(n[at[keep]])))
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["team", "packed"])

    rows, now = [], None
    for batch in batches:
        for bucket, team, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket == -1:
                yield pa.RecordBatch.from_arrays([pa.array([team], pa.int64()), pa.array([b"\0\0\0\0" + data], pa.binary())], ["team", "packed"])
                continue
            if bucket != now and rows:
                yield answers(rows)
                rows = []
            now = bucket
            rows.append((team, data))
    if rows:
        yield answers(rows)


def matches(n: np.ndarray, base: int, most: int) -> int:
    """How many shared shingles a prefix asks for: ``n`` counts the texts that hold each shingle, in the common order."""
    choice = MATCHES[MATCHES <= max(1, min(most, len(n) - base + 1))]
    lists = np.cumsum(n.astype(np.float64) - 1)[base + choice - 2]
    # A candidate that shares l shingles is l entries of the lists.
    return int(choice[(lists + VERIFY * lists / choice).argmin()])


def _adapt(percent: int):
    """Rows sorted by team, the note among them, to a row for each set that may have partners."""
    names = ("node", "size", "base", "matches", "held", "wide", "small", "tokens")

    def team_rows(note: bytes, answers: list[bytes]) -> list[tuple]:
        nodes, sizes, distinct, bulk, n_bulk, holders = pickle.loads(note)
        entries, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for data in answers:
            m = int.from_bytes(data[:4], "little")
            entries.append(unplaned(data[4 : 4 + 8 * m], np.uint64))
            ns.append(unplaned(data[4 + 8 * m :], np.uint16))
        entry, n = np.concatenate(entries), np.concatenate(ns)
        wide = (entry & np.uint64(NOBODY)) == NOBODY
        token, text = entry[~wide] >> LOW, (entry[~wide] & np.uint64(NOBODY)).astype(np.int64)
        # Shingles that were sent once, to all that hold them.
        order = np.argsort(entry[wide])
        own, own_n = (entry[wide] >> LOW)[order], n[wide][order]
        at = np.searchsorted(bulk, own)
        first = np.cumsum(n_bulk) - n_bulk
        spread = np.concatenate([np.arange(first[i], first[i] + n_bulk[i]) for i in at]) if len(at) else np.zeros(0, np.int64)
        token = np.concatenate([token, np.repeat(own, n_bulk[at])])
        text = np.concatenate([text, holders[spread].astype(np.int64)])
        n = np.concatenate([n[~wide], np.repeat(own_n, n_bulk[at])])
        order = np.lexsort((token, n, text))
        token, text, n = token[order], text[order], n[order]
        starts = np.searchsorted(text, np.arange(len(nodes) + 1))
        out = []
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            size = int(sizes[i])
            # What a partner must share; less what two hashes of the set may have become one.
            least = -(-size * percent // 100) - (size - int(distinct[i]))
            base = (b - a) - max(1, least) + 1
            if base < 1:
                continue
            out.append((int(nodes[i]), size, base, matches(n[a:b], base, max(1, least)), b - a, np.searchsorted(n[a : a + base], LARGE, side="right"), sketch(token[a:b]), token[a:b].tobytes()))
        return out

    kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, note, answers = None, None, []

        def rows() -> Iterator[pa.RecordBatch]:
            found = team_rows(note, answers)
            for i in range(0, len(found), 1000):
                yield batch(found[i : i + 1000])

        for b in batches:
            for team, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if team != now:
                    if now is not None:
                        yield from rows()
                    now, note, answers = team, None, []
                if data[:4] == b"\0\0\0\0":
                    note = data[4:]
                else:
                    answers.append(data)
        if now is not None:
            yield from rows()

    return run


# -- candidates and links --------------------------------------------------------


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to one row a shingle of the shortest prefix: ``block, node, size, rest, wide``.

    A set's ``wide`` is where, in the common order, shingles begin that many texts hold.
    """
    for batch in batches:
        node, size, base, held, wide, tokens = (batch.column(c) for c in ("node", "size", "base", "held", "wide", "tokens"))
        n = np.asarray(base)
        if not len(n):
            continue
        place = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
        block = np.concatenate([np.frombuffer(t, np.int64, count) for t, count in zip(tokens.to_pylist(), n.tolist())])
        columns = [block, np.repeat(np.asarray(node), n), np.repeat(np.asarray(size), n), np.repeat(np.asarray(held), n) - place, place >= np.repeat(np.asarray(wide), n)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "node", "size", "rest", "wide"])


def _prefix(base: int, asked: int, tokens: bytes) -> np.ndarray:
    return np.frombuffer(tokens, np.uint64, base + asked - 1)


def _verified(percent: int):
    """Pairs with both sides' ``size, base, matches, tokens`` to those that are links."""

    def similar(a: tuple, b: tuple) -> bool:
        (size, base, asked, tokens), (size_b, base_b, asked_b, tokens_b) = a, b
        # Both prefixes at the smaller number of matches: as many shingles must be in common.
        fewest = min(asked, asked_b)
        if len(np.intersect1d(_prefix(base, fewest, tokens), _prefix(base_b, fewest, tokens_b), assume_unique=True)) < fewest:
            return False
        both = len(np.intersect1d(np.frombuffer(tokens, np.uint64), np.frombuffer(tokens_b, np.uint64), assume_unique=True))
        return both >= least_overlap(size + size_b, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(2, 10))))
            ok = [similar(r[:4], r[4:]) for r in rows]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id``, a row for each of ``df``.

    Texts are linked if ``percent`` of a hundred of their different shingles are
    in common; ``component_id`` is the smallest key that links reach, the text's
    own included.  Texts without words, empty and null ones, have no shingles and
    no links.  Null keys are the name of a class only if all its keys are null.
    Repeated rows come back as often, linked to each other; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.xxhash64(body)).alias("at"), body.alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), words) for t in batch.column(2)]
            node = [node_of(x) if len(x) else None for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array([len(x) for x in own], pa.int64())], ["k", "at", "node", "size"])

    rows = durable(docs.mapInArrow(sizes, f"k {kind}, at bigint, node bigint, size bigint"), "sets")
    own = durable(rows.where("node is not null").groupBy("node").agg(F.min("at").alias("at"), F.min("k").alias("least")), "own")
    held, buckets = bit_map(own.select("at")), partitions(spark)
    sent = docs.select("at", "text").mapInArrow(_send(held, words, buckets), "team bigint, bucket int, packed binary")
    dealt = sent.select("bucket", "team", "packed").repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).sortWithinPartitions("bucket", "team")
    answers = dealt.mapInArrow(_answer, "team bigint, packed binary").repartition(buckets, "team").sortWithinPartitions("team")
    # A set that two tasks have sent comes twice, with the same answers.
    sets = answers.mapInArrow(_adapt(percent), "node bigint, size int, base int, matches int, held int, wide int, small binary, tokens binary")
    sets = durable(sets, "prefixes")
    met = in_blocks(sets.drop("small").mapInArrow(_entries, "block bigint, node bigint, size int, rest int, wide boolean"))
    there = met.select("node").distinct()
    once = lambda *names: sets.join(there, "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in names])
    drawn = durable(once("held", "small"), "sketches")
    whole = durable(once("size", "base", "matches", "tokens"), "shared")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda at: whole.select(F.col("node").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in ("size", "base", "matches", "tokens")])
        both = pairs.join(side("u"), "u").join(side("v"), "v")
        return durable(both.select("u", "v", *[f"{at}_{c}" for at in "uv" for c in ("size", "base", "matches", "tokens")]).mapInArrow(_verified(percent), "u bigint, v bigint"), "links")

    found = link(met, drawn, verified, percent)
    labelled = durable(own.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "labelled")
    named = durable(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of_node = durable(meet(labelled.select("node", "root"), named, "root").select("node", "component_id"), "of_node")
    worded = meet(rows.where("node is not null"), of_node, "node").select("k", "size", "component_id")
    bare = rows.where("node is null").select("k", "size", F.col("k").alias("component_id"))
    return worded.unionByName(bare).select(F.col("k").alias(key), F.col("size").alias("n_shingles"), "component_id")
