"""Trie of the beginnings that conversations share.

A conversation is the array of its turns, each known by 128 bits of hash.  Arrays
are sorted globally, in ranges that copies of one conversation may cross.  Every
range is swept on its own with a stack: the common prefix of a row and the row
before it says which nodes close and which open, so a range needs as much memory
as its longest conversation.  Nodes that go on over a range's ends leave it open;
their parts, two paths a range at most, are stitched by their prefix.  A last
sweep, backwards, meets every node before its children and tells them its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import durable, partitions, prepare, small

#: Bytes of a turn's hash.
WIDTH = 16
#: Characters of ids that leave a task in one row.
CHUNK = 1 << 18
#: Rows in a batch that leaves a task.
ROWS = 8192
#: Fixed value: the hash of nothing.
NOTHING = hashlib.sha256(b"").hexdigest()
#: What a row of the sweep is: a node, a part of one that crosses a range's end, ids of members that end at one.
NODE, PART, IDS = 0, 1, 2
SWEPT = "kind tinyint, part int, at bigint, depth int, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, prefix binary"
TRIE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_arrays(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` (long), ``turns``: of each conversation its turns in order, an array of ``hash, words``.

    Null turns go first, equal turns by hash; null roles and texts count as
    empty.  Rows with a null key belong to no conversation.  ``words`` counts
    what ASCII white space separates.  A conversation's hashes meet in one row;
    texts stay where they are.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    own = F.md5(F.concat(F.octet_length(said[0]), F.lit(":"), *said))
    words = F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.struct(F.col(turn).isNotNull().alias("given"), F.col(turn).alias("turn"), own.alias("hash"), words.alias("words")).alias("t"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with in common."""
    if a == b:
        return len(a) // WIDTH
    i, n = 0, min(len(a), len(b))
    while i < n and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, last, next``, two sequences, to how many turns they share and whether they are equal; -1 without a next one."""
    for batch in batches:
        pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        shared = [-1 if b is None else common(a, b) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int32()), pa.array([a == b for a, b in pairs], pa.bool_())], ["part", "shared", "equal"])


class _Rows:
    """Rows of a schema, gathered to batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return out


SWEPT_ARROW = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("at", pa.int64()), ("depth", pa.int32()), *[(n, pa.int64()) for n in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.string()), ("prefix", pa.binary())])


class _Open:
    """A node on the stack, as far as this range knows it."""

    __slots__ = ("least", "n", "children", "leaves", "saved", "words", "hash", "ids", "held", "partial")

    def __init__(self, words: int, partial: bool):
        self.least, self.n, self.children, self.leaves, self.saved, self.words = None, 0, 0, 0, 0, words
        self.hash, self.ids, self.held, self.partial = None, None, 0, partial


class _Range:
    """One range's sweep.  ``before``, ``after``: turns that its first and last row share with their neighbours, and whether they are equal to them."""

    def __init__(self, part: int, before: tuple[int, bool], after: tuple[int, bool], out: _Rows, most: int):
        self.part, self.before, self.after, self.out, self.most = part, before, after, out, most
        self.path, self.stack, self.at, self.first = b"", [_Open(0, before[0] >= 0)], 0, True

    def prefixes(self, depth: int) -> bytes:
        return hashlib.blake2b(self.path[: depth * WIDTH], digest_size=WIDTH).digest()

    def chunk(self, node: _Open, depth: int) -> None:
        self.out.rows.append((IDS, self.part, self.at, depth, None, None, None, None, None, ",".join(node.ids), self.prefixes(depth)))
        self.at += 1
        node.ids, node.held = [], 0

    def close(self, ends_here: bool, last: bool) -> None:
        """The deepest node, which goes on in the next range unless ``ends_here``; ``last``: its members are the last rows."""
        depth = len(self.stack) - 1
        node = self.stack.pop()
        crosses = node.hash is not None and (node.ids is not None and ((last and self.after[1]) or node.partial and self.first_run == depth))
        node.saved += node.n * node.words
        if ends_here:
            node.saved -= node.words
            node.leaves += not node.children
        if crosses:
            self.chunk(node, depth)
        ends = None if crosses else node.hash.hexdigest() if node.hash else None
        open_ = node.partial or not ends_here
        self.out.rows.append((PART if open_ else NODE, self.part, self.at, depth, node.least, node.n, node.children, node.leaves, node.saved, ends, self.prefixes(depth) if open_ else None))
        self.at += 1
        if self.stack:
            up = self.stack[-1]
            up.n, up.leaves, up.saved, up.children = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved, up.children + ends_here
            if up.least is None or node.least < up.least:
                up.least = node.least

    def add(self, path: bytes, name: int, words: list[int]) -> None:
        shared, depth = common(self.path, path), len(path) // WIDTH
        while len(self.stack) - 1 > shared:
            self.close(True, False)
        self.path = path
        for d in range(shared, depth):
            self.stack.append(_Open(words[d], self.first and d < self.before[0]))
        if self.first:
            # Only the first row's members may go on from the range before.
            self.first, self.first_run = False, depth if self.before[1] else -1
        top = self.stack[-1]
        top.n += 1
        top.least = name if top.least is None else min(top.least, name)
        if top.hash is None:
            top.hash = hashlib.sha256()
            text = str(name)
            top.ids = [] if self.after[1] or (top.partial and self.first_run == depth) else None
        else:
            text = f",{name}"
        top.hash.update(text.encode())
        if top.ids is not None:
            top.ids.append(str(name))
            top.held += len(text)
            if top.held >= self.most:
                self.chunk(top, depth)

    def end(self) -> None:
        full = len(self.stack) - 1
        while self.stack:
            depth = len(self.stack) - 1
            self.close(depth > self.after[0], depth == full)


def _sweep(borders: dict[int, tuple[int, bool]], previous: dict[int, int], most: int):
    """Rows ``part, path, conv_id, words`` in order to nodes, parts and ids."""
    none = (-1, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Rows(SWEPT_ARROW), None
        for batch in batches:
            for part, path, name, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is None or now.part != part:
                    if now is not None:
                        now.end()
                    now = _Range(part, borders.get(previous.get(part, -1), none), borders.get(part, none), out, most)
                now.add(path, name, words)
                if len(out.rows) >= ROWS:
                    yield out.batch()
        if now is not None:
            now.end()
        yield out.batch()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``prefix, ids`` in order to one hash a prefix: as each piece passes, none is kept."""
    out, prefix, own = _Rows(pa.schema([("prefix", pa.binary()), ("ends", pa.string())])), None, None
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != prefix:
                if own is not None:
                    out.rows.append((prefix, own.hexdigest()))
                prefix, own, between = name, hashlib.sha256(), ""
            if ids:
                own.update(f"{between}{ids}".encode())
                between = ","
    if own is not None:
        out.rows.append((prefix, own.hexdigest()))
    yield out.batch()


TRIE_ARROW = pa.schema([*[(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range from its end, parents before children, to nodes that know their parent's name."""
    out, names, part = _Rows(TRIE_ARROW), [], None
    for batch in batches:
        for own, depth, name, n, children, leaves, saved, ends, gives in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if own != part:
                part, names = own, []
            del names[depth:]
            if gives:
                out.rows.append((name, depth, names[-1] if names else None, n, children, leaves, saved, ends or NOTHING))
            names.append(name)
            if len(out.rows) >= ROWS:
                yield out.batch()
    yield out.batch()


def trie(arrays: DataFrame, key: str = "conv_id", turns: str = "turns", chunk: int = CHUNK) -> DataFrame:
    """Of each node of the trie of ``turns`` (arrays of ``hash, words``; see :func:`turn_arrays`) one row.

    ``conv_id`` the smallest member, ``depth`` (0: the root, which all
    conversations begin with), ``parent_conv_id`` the parent's smallest member
    (null for the root), ``n_convs`` members, ``n_children``, ``n_leaves``
    childless nodes below or itself, ``saved_tokens`` what sharing saves in its
    subtree, and ``ends_sha256`` of the ids, ascending and joined by commas, of
    members that end here.

    Keys are whole numbers that do not repeat; empty and null arrays end at the
    root; without rows there are no nodes.  Other columns are ignored.
    """
    spark = arrays.sparkSession
    prepare(spark)
    held = F.coalesce(F.col(turns), F.array().cast("array<struct<hash:string,words:bigint>>"))
    rows = arrays.select(F.unhex(F.array_join(F.transform(held, lambda t: t["hash"]), "")).alias("path"), F.col(key).cast("long").alias("conv_id"), F.transform(held, lambda t: t["words"]).alias("words"))
    parts = partitions(spark)
    # Written once: borders and sweeps must see the same ranges.
    ranged = durable(rows.repartitionByRange(parts, "path", "conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    beside = ends.select("part", "last", F.lead("first").over(Window.orderBy("part")).alias("next"))  # as many rows as ranges
    seen = sorted((r.part, r.shared, r.equal) for r in beside.mapInArrow(_borders, "part int, shared int, equal boolean").collect())
    borders = {part: (shared, equal) for part, shared, equal in seen}
    previous = {b[0]: a[0] for a, b in zip(seen, seen[1:])}
    most = max(parts, 1 + max(borders, default=0))

    dealt = ranged.select("part", "path", "conv_id", "words").repartitionById(most, "part").sortWithinPartitions("part", "path", "conv_id")
    swept = durable(dealt.mapInArrow(_sweep(borders, previous, chunk), SWEPT), "swept")
    values = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    met = swept.where(f"kind = {PART}").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values[1:]], F.max("ends").alias("ends"), F.max("part").alias("owner"))
    ids = swept.where(f"kind = {IDS}").select("prefix", "ends", "part", "at").repartition(parts, "prefix").sortWithinPartitions("prefix", "part", "at")
    whole = ids.select("prefix", "ends").mapInArrow(_digests, "prefix binary, ends string").withColumnRenamed("ends", "met_ends")
    met = durable(met.join(whole, "prefix", "left").select("prefix", *values, F.coalesce("ends", "met_ends").alias("ends"), "owner"), "stitched")
    crossing = swept.where(f"kind = {PART}").select("prefix", "part", "at", "depth").join(small(met), "prefix")
    crossing = crossing.select("part", "depth", *values, "ends", (F.col("part") == F.col("owner")).alias("gives"), "at")
    nodes = swept.where(f"kind = {NODE}").select("part", "depth", *values, "ends", F.lit(True).alias("gives"), "at").unionByName(crossing)
    back = nodes.repartitionById(most, "part").sortWithinPartitions("part", F.desc("at"))
    return back.drop("at").mapInArrow(_named, TRIE)
