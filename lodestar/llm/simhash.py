"""SimHash fingerprints and their near-duplicate classes.

Fingerprints are made per text in numpy.  Distinct fingerprints (exact copies
share one) meet in blocks: two that differ in ``radius`` bits agree on at least
one of ``radius + 1`` bit ranges.  A block too large to compare splits the same
way on the bits that its range leaves open, again and again; as ranges shrink,
so do blocks, down to a few thousand possible values.  So no pair is lost and
no task gets an unbounded block.  Inside a block, distances come from bit
planes (:mod:`lodestar.llm.bitslice`) and leave as a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bitslice
from lodestar.llm.common import durable, fresh, meet, partitions, prepare, small
from lodestar.llm.components import connected_components
from lodestar.llm.linking import LARGE, in_blocks, link
from lodestar.llm.linking import sketch as small_sketch
from lodestar.llm.suffix_dedup import _bit_map as bit_map
from lodestar.llm.suffix_dedup import _in_map as in_map

SEED = 42
#: Distinct fingerprints in a block beyond which it splits further.
BLOCK = 2048
#: Shingles counted at once.
SHINGLES = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero if it has no words."""
    parts = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(parts[i:] for i in range(words)))]
    return _majority(np.array(hashes, np.uint64))


def _majority(values: np.ndarray) -> int:
    """The bits that are set in over half the values."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), SHINGLES):
        counts += np.unpackbits(values[at : at + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fp`` (the fingerprint as a signed long), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [key, "fp"])

    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _ranges(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _forest(radius: int):
    """Blocks, sorted, to the edges of their spanning forests; whole blocks are compared a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def compare(fps, masks, keys):
            change = (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])
            groups = np.cumsum(np.r_[0, change])
            a, b = bitslice.spanning_edges(fps.view(np.uint64), groups, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["u", "v"])

        for batch in batches:
            rest.append(tuple(np.asarray(batch.column(i)) for i in range(3)))
            fps, masks, keys = (np.concatenate(x) for x in zip(*rest))
            if not len(fps):
                rest = []
                continue
            last = len(fps) - 1
            same = (masks == masks[last]) & (keys == keys[last])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield compare(fps[:cut], masks[:cut], keys[:cut])
            rest = [(fps[cut:], masks[cut:], keys[cut:])]
        if rest and len(rest[0][0]) > 1:
            yield compare(*rest[0])

    return run


def close_edges(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` that connect all of ``fp`` (distinct longs) at ``radius`` differing bits or fewer."""
    spark = distinct.sparkSession
    prepare(spark)
    edges, level = [], [(0, list(range(64)))]
    # Rows of a level: fp, mask (the bits that its block agrees on).
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        # From a mask to the masks of the next ranges among its open bits.
        wider = {}
        for mask, open_bits in level:
            if len(open_bits) > radius + 8:
                wider[mask] = [(mask | sum(1 << b for b in part), [b for b in open_bits if b not in part]) for part in _ranges(open_bits, radius + 1)]
        if not wider:
            break
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        step = F.create_map(*[x for m, parts in wider.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(p)) for p, _ in parts]))])
        spread = rows.select("fp", F.explode(step[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        # The keys of large blocks are known before rows move, so that no large block meets whole.
        counts = spread.groupBy("mask", "key").agg(F.count("*").alias("n"))
        large = durable(counts.where(F.col("n") > block).select("mask", "key"), "large")
        last = all(len(open_bits) <= radius + 8 for parts in wider.values() for _, open_bits in parts)
        done = last or large.limit(1).count() == 0
        few = None if done else small(large)
        ready = spread if done else spread.join(few, ["mask", "key"], "left_anti")
        dealt = ready.select("fp", "mask", "key").repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp")
        edges.append(dealt.mapInArrow(_forest(radius), "u bigint, v bigint"))
        if done:
            break
        rows = durable(spread.join(few, ["mask", "key"], "left_semi").select("fp", "mask").distinct(), "blocks")
        level = [x for parts in wider.values() for x in parts]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """``key, fp, component_id``: the smallest key reachable over links of ``radius`` bits or fewer.

    One row per input row.  Null texts count as empty: fingerprint zero, which
    links like any other.  Null keys never become a component's name unless all
    its keys are null.  Repeated rows come back as often; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = durable(fingerprints(df.select(F.col(key).alias("k"), F.col(text).alias("text")), "k", "text", words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("k").alias("least"))
    found = connected_components(close_edges(distinct.select("fp"), radius, block))
    labelled = durable(distinct.join(found, distinct.fp == found.node, "left").select(distinct.fp, "least", F.coalesce("root", distinct.fp).alias("root")), "labelled")
    named = durable(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of_fp = durable(meet(labelled, named, "root").select("fp", "component_id"), "of-fp")
    # Many rows may have one fingerprint, many fingerprints one root: neither meets in one task.
    return meet(rows, of_fp, "fp").select(F.col("k").alias(key), F.col("fp").alias("fp" if key.lower() != "fp" else "fingerprint"), "component_id")


# -- classes by similarity ------------------------------------------------------
#
# Exact: two texts are linked if the sets of their shingles (64-bit hashes) have
# the asked Jaccard similarity.  The forest of close SimHash fingerprints of the
# sets, by bit-sliced comparison, gives the first candidates.  A fingerprint may
# differ more than the sets do, so an exact way follows: sets that similar share
# one of their first few shingles in any common order (prefix filtering), so
# candidates meet in blocks of one shingle and none is lost; frequent shingles
# come last in the order, so that blocks are small.  Blocks are linked as
# :mod:`lodestar.llm.linking` says, so that pairs do not grow with the square of a
# group of alike texts, and no block meets whole.  Every link is verified on the
# whole sets.

#: Shingles estimated to be in more texts than this come last in the order.
ORDINARY = 16
#: Bits in which fingerprints of first candidates may differ.
CLOSE = 3
#: Texts, about, whose shingles tell the frequent ones, and how many of those are told apart.
SAMPLE, FREQUENT = 20_000, 200_000
#: Shingles of texts remembered while pairs are verified.
REMEMBERED = 1 << 21
#: Against rounding of products with the similarity.
TINY = 1e-6


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of a text's different word shingles, sorted; one shingle if it has fewer words."""
    parts = (text or "").encode("utf-8").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(b" ".join(parts))], np.uint64)
    each = np.fromiter(map(digest, parts), np.uint64, len(parts))
    n = len(each) - words + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """A bit for each value of a set's low bits: whether an odd number of members has it.

    Sketches of two sets never differ in more bits than the sets in members;
    folding one in halves keeps that.
    """
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def too_different(a: np.ndarray, b: np.ndarray, sizes: int, similarity: float) -> bool:
    """Whether two sketches rule out that their sets, of so many members together, are as similar as asked."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    most = sizes - 2 * math.ceil(sizes * similarity / (1 + similarity) - TINY)
    return int(np.bitwise_count(a ^ b).sum()) > most


def _prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, wide: int, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order: so many that a similar set shares one; and which are in very many texts, from where on."""
    n = len(own) - math.ceil(similarity * len(own) - TINY) + 1
    first_wide = len(own)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = frequent[at] == own
        ranks = np.sort(rank[at[late]])
        own = np.concatenate([own[~late], own[late][np.argsort(rank[at[late]])]])
        first_wide = len(own) - int((ranks >= wide).sum())
    return own[:n], first_wide


def _frequent(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles of a sample, sorted, their ranks from the rarest, and the rank from which texts are very many.  They decide the cost, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], ["shingle"])

    share = max(1, df.count() // SAMPLE)
    body = F.coalesce(F.col(text), F.lit(""))
    some = df.select(body.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).dropDuplicates(["text"])
    counts = some.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, ORDINARY // share))
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    found = np.array([r.shingle for r in reversed(top)], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order, sum(r.n * share <= LARGE for r in top)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, size, prefix, wide`` to one row a shingle of the prefix: ``block, node, size, rest, wide``."""
    for batch in batches:
        held = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if not held:
            continue
        lengths = np.array([len(x) for x in held])
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        size = np.repeat(np.asarray(batch.column(1)), lengths)
        columns = [np.concatenate(held), np.repeat(np.asarray(batch.column(0)), lengths), size, size - place, place >= np.repeat(np.asarray(batch.column(3)), lengths)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "node", "size", "rest", "wide"])


def _possible(similarity: float):
    """Pairs ``u, v`` whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (3, 4))
            sizes = batch.column(2).to_pylist()
            ok = [not too_different(a[i], b[i], sizes[i], similarity) for i in range(len(sizes))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(words: int, similarity: float):
    """``u, v`` and their texts to those pairs whose shingle sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if node not in known:
                own = shingles(text.as_py(), words)
                if held + len(own) > REMEMBERED:
                    known.clear()
                    held = 0
                known[node] = own
                held += len(own)
            return known[node]

        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = [jaccard(of(u[i], batch.column(2)[i]), of(v[i], batch.column(3)[i])) >= similarity - 1e-12 for i in range(len(u))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def similar_classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key, hash, component, keeper``: one row per different (key, text).

    ``hash`` is ``xxhash64`` of the text (null as empty), ``component`` names a
    class of texts that links of Jaccard similarity ``similarity`` or more
    connect, ``keeper`` marks the one with the smallest key (null keys last).
    Texts without words are alike.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[key].dataType.simpleString()
    frequent, rank, wide = _frequent(df, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), words) for t in batch.column(2)]
            node = [xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in own]
            prefix = [_prefix(x, frequent, rank, wide, similarity) for x in own]
            drawn = [sketch(x).tobytes() for x in own]
            fps = pa.array(np.array([_majority(x) for x in own], np.uint64).view(np.int64))
            little = [small_sketch(x) for x in own]
            columns = [pa.array(node, pa.int64()), fps, pa.array([len(x) for x in own], pa.int32()), pa.array([x.tobytes() for x, _ in prefix], pa.binary()), pa.array([n for _, n in prefix], pa.int32()), pa.array(drawn, pa.binary()), pa.array(little, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "hash", "node", "fp", "size", "prefix", "wide", "sketch", "small"])

    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("key"), F.xxhash64(body).alias("hash"), body.alias("text"))
    rows = durable(docs.mapInArrow(run, f"key {kind}, hash bigint, node bigint, fp bigint, size int, prefix binary, wide int, sketch binary, small binary"), "prefixes")
    slim = durable(rows.select("key", "hash", "node").distinct(), "slim")
    distinct = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "wide")])
    met = in_blocks(distinct.mapInArrow(_entries, "block bigint, node bigint, size int, rest int, wide boolean"))

    drawn = rows.select("node", "size", "sketch", "small").join(met.select("node").distinct(), "node", "left_semi")
    drawn = durable(drawn.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "small")]), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = lambda at: drawn.select(F.col("node").alias(at), F.col("size").alias(f"{at}_size"), F.col("sketch").alias(f"{at}_sketch"))
        pairs = pairs.join(ends("u"), "u").join(ends("v"), "v").select("u", "v", (F.col("u_size") + F.col("v_size")).alias("sizes"), "u_sketch", "v_sketch")
        pairs = durable(pairs.mapInArrow(_possible(similarity), "u bigint, v bigint"), "possible")
        nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        order = F.struct(F.col("key").isNull(), "key", "hash")
        asked = rows.select("key", "hash", "node").join(nodes, "node").groupBy("node").agg(F.min(order).alias("first"))
        asked = durable(asked.select("node", F.col("first.key").alias("_ls_key"), F.col("first.hash").alias("_ls_hash")), "asked")
        held = bit_map(asked.select(F.xxhash64("_ls_key", "_ls_hash")))

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_map(held, np.asarray(batch.column(0)))))

        some = docs.select(F.xxhash64("key", "hash").alias("at"), "key", "hash", "text").mapInArrow(likely, f"at bigint, key {kind}, hash bigint, text string")
        some = some.join(asked, some.key.eqNullSafe(asked["_ls_key"]) & (some.hash == asked["_ls_hash"])).select("node", "text")
        texts = durable(some.dropDuplicates(["node"]), "texts")
        of = lambda at, name: texts.select(F.col("node").alias(at), F.col("text").alias(name))
        both = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b")
        return durable(both.mapInArrow(_verified(words, similarity), "u bigint, v bigint"), "links")

    # Sets with close fingerprints first: a star for each fingerprint, a forest over fingerprints.
    of_fp = durable(rows.groupBy("fp").agg(F.min("node").alias("rep")), "fps")
    star = rows.select("node", "fp").distinct().join(of_fp, "fp").where("node != rep").select(F.least("node", "rep").alias("u"), F.greatest("node", "rep").alias("v"))
    ends = lambda at: of_fp.select(F.col("fp").alias(at), F.col("rep").alias(f"{at}_rep"))
    forest = close_edges(of_fp.select("fp"), CLOSE).join(ends("u"), "u").join(ends("v"), "v")
    close = star.unionByName(forest.select(F.least("u_rep", "v_rep").alias("u"), F.greatest("u_rep", "v_rep").alias("v")))
    percent = round(100 * similarity, 9)
    found = link(met, drawn.select("node", F.col("size").alias("held"), "small"), verified, percent, close)
    order = F.struct(F.col("key").isNull(), "key", "hash")
    # Many rows may be copies of one set.
    named = meet(slim, durable(found, "found"), "node", left=True).select("key", "hash", F.coalesce("root", "node").alias("component"))
    named = durable(named, "named")
    # The keepers meet their rows by key and text, which no class makes frequent.
    first = named.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.key").alias("_ls_key"), F.col("first.hash").alias("_ls_hash"))
    marked = named.join(first, named.key.eqNullSafe(first["_ls_key"]) & (named.hash == first["_ls_hash"]), "left")
    return marked.select(F.col("key").alias(key), "hash", "component", F.col("_ls_hash").isNotNull().alias("keeper"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each near-duplicate class: the smallest key's; columns as they are.

    Of rows that repeat key and text one stays, whichever.
    """
    found = similar_classes(df, key, text, words, similarity)
    own, gone_key, gone_hash, twice_key, twice_hash, count = fresh(df, "hash", "gone_key", "gone_hash", "twice_key", "twice_hash", "count")
    marked = df.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    gone = durable(found.where("not keeper").select(F.col(key).alias(gone_key), F.col("hash").alias(gone_hash)), "gone")
    kept = marked.join(gone, F.col(key).eqNullSafe(F.col(gone_key)) & (F.col(own) == F.col(gone_hash)), "left_anti")
    twice = marked.groupBy(F.col(key).alias(twice_key), F.col(own).alias(twice_hash)).agg(F.count("*").alias(count)).where(F.col(count) > 1).drop(count)
    twice = durable(twice, "twice")
    if twice.limit(1).count() == 0:
        return kept.select(*df.columns)
    same = F.col(key).eqNullSafe(F.col(twice_key)) & (F.col(own) == F.col(twice_hash))
    one = kept.join(twice, same, "left_semi").dropDuplicates([key, own])
    return kept.join(twice, same, "left_anti").unionByName(one).select(*df.columns)
