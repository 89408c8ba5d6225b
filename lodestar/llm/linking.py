"""Links between rows that meet in blocks, without the pairs of a group of alike rows.

Rows (``block, node, size, rest``) of one block may be links: ``size`` counts a
node's members, ``rest`` bounds what it can share with others of the block.  A
link needs ``least_overlap`` members in common.  Neighbours by size are verified
first; what they connect is not looked at again.  Then every block that still
holds nodes of different components is compared by sketches, in a task, and each
node's nearest go first, until no pair of different components is left that the
sketches do not rule out.

No block meets whole.  A large one is dealt in slices: nodes of one large
component have slices of their own, which need not meet each other, so a block
whose nodes are mostly connected costs its few others times its rows, not its
square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import durable, partitions, small
from lodestar.llm.components import connected_components

#: Bits of the sketches that blocks are compared by.
BITS = 512
#: Rows of a block beyond which it is dealt out in slices.
LARGE = 2048
#: Tasks that a block which is known to be large is dealt to at first.
PIECES = 64
#: How many of the nearest of each node are verified in a round; the last round takes all that are left.
NEAREST = (4, 64, 1024, None)


def least_overlap(sizes, percent: float):
    """Members that two sets of so many together need in common (numbers, or arrays of them); exact for whole ``percent``."""
    if percent == int(percent):
        return -(-sizes * int(percent) // (100 + int(percent)))
    return np.ceil(sizes * (percent / (100 + percent)) - 1e-6).astype(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """A bit for each value of a set's low bits: whether an odd number of members has it.

    Sketches of two sets never differ in more bits than the sets in members.
    """
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def in_blocks(entries: DataFrame) -> DataFrame:
    """Rows ``block, node, size, rest`` of blocks with more than one node, each once; written.

    ``wide`` says of an entry that its block is known to be large: its rows are
    dealt out by node and kept.
    """
    piece = F.when(F.col("wide"), F.pmod(F.xxhash64("node"), F.lit(PIECES))).otherwise(0)
    dealt = entries.repartition(partitions(entries.sparkSession), "block", piece).sortWithinPartitions("block", "node")
    return durable(dealt.mapInArrow(_shared, "block bigint, node bigint, size int, rest int"), "met")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by block and node, of blocks with more than one node here or known to be large."""
    last, taken = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        block, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        before = (None, None) if last is None else (last.column(0)[0].as_py(), last.column(1)[0].as_py())
        new = np.r_[(int(block[0]), int(node[0])) != before, (block[1:] != block[:-1]) | (node[1:] != node[:-1])]
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            continue
        block = block[new]
        same = block[1:] == block[:-1]
        keep = np.r_[False, same] | np.r_[same, False] | batch.column(4).to_numpy(zero_copy_only=False)
        if before[0] == block[0]:
            keep[0] = True
            if not taken:
                yield last.select(range(4))
        yield batch.filter(pa.array(keep)).select(range(4))
        last, taken = batch.slice(batch.num_rows - 1, 1), bool(keep[-1])


class Group:
    """Rows that meet: a block, or two slices of one."""

    def __init__(self, rows: pa.Table, percent: float):
        of = lambda name: rows.column(name).to_numpy()
        self.node, self.root, self.side, self.percent = of("node"), of("root"), of("side"), percent
        self.size, self.held, self.rest = (of(c).astype(np.int64) for c in ("size", "held", "rest"))
        self.sketch = np.frombuffer(b"".join(rows.column("small").to_pylist()), np.uint64).reshape(-1, BITS // 64)

    def nearest(self, high: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Possible pairs of different components that are among the ``high`` nearest of one side; whether more are left.

        Rows of the commonest component are not compared with each other.
        """
        if self.side.any():
            asks, told = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
            if len(told) < len(asks):
                asks, told = told, asks
        else:
            roots, n = np.unique(self.root, return_counts=True)
            asks, told = np.flatnonzero(self.root != roots[n.argmax()]), np.arange(len(self.node))
        u, v, more = [], [], False
        step = max(1, (1 << 18) // max(1, len(told)))
        for at in range(0, len(asks), step):
            a = asks[at : at + step, None]
            least = least_overlap(self.size[a] + self.size[told], self.percent)
            bits = np.bitwise_count(self.sketch[a] ^ self.sketch[told]).sum(axis=-1, dtype=np.int64)
            ok = (self.root[a] != self.root[told]) & (np.minimum(self.rest[a], self.rest[told]) >= least) & (bits <= self.held[a] + self.held[told] - 2 * least)
            if not ok.any():
                continue
            # Ranks count possible pairs only; equal distances go by node.
            order = np.lexsort((np.broadcast_to(self.node[told], bits.shape), np.where(ok, bits, BITS + 1)), axis=1)
            place = np.empty(bits.shape, np.int32)
            np.put_along_axis(place, order, np.arange(bits.shape[1], dtype=np.int32)[None, :], axis=1)
            i, j = np.nonzero(ok & (place < high) if high is not None else ok)
            u.append(self.node[asks[at + i]])
            v.append(self.node[told[j]])
            more |= bool(high is not None and (ok & (place >= high)).any())
        none = self.node[:0]
        return (np.concatenate(u), np.concatenate(v), more) if u else (none, none, more)


def _near_pairs(percent: float, high: int | None):
    """Rows sorted by ``block, i, j`` to possible pairs ``u, v``; a row of nulls says that more are left."""
    names = ("block", "i", "j")

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        found, left = [], False
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, rows.num_rows].tolist()):
            if b - a > 1:
                u, v, more = Group(rows.slice(a, b - a), percent).nearest(high)
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
                left |= more
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        none = [None] if left else []
        return pa.RecordBatch.from_arrays([pa.array([*both[0].tolist(), *none], pa.int64()), pa.array([*both[1].tolist(), *none], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in names]
            other = np.flatnonzero(np.any([k != k[-1] for k in own], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (rest and any(rest[-1].column(c)[-1].as_py() != k[-1] for c, k in zip(names, own))):
                if cut:
                    rest.append(batch.slice(0, cut))
                yield pairs(pa.Table.from_batches(rest).combine_chunks())
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield pairs(pa.Table.from_batches(rest).combine_chunks())

    return run


def _dealt(spark, rooted: DataFrame, drawn: DataFrame, large: int) -> DataFrame:
    """Rows of blocks with more than one component, dealt to groups ``block, i, j`` of bounded rows."""
    apart = rooted.groupBy("block").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    apart = durable(apart.where("least < most").select("block", "n"), "apart")
    columns = ["node", "root", "size", "held", "rest", "small"]
    few = rooted.join(apart.where(F.col("n") <= large).select("block"), "block").join(drawn, "node")
    zero = F.lit(0).cast("long")
    out = few.select("block", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), *columns)
    wide = small(apart.where(F.col("n") > large))
    if wide.limit(1).count() == 0:
        return out
    # Of the few large blocks: components that are large there have slices of their own.
    rows = durable(rooted.join(wide, "block"), "wide")
    whole = rows.groupBy("block", F.col("root").alias("own")).agg(F.count("*").alias("m")).where(F.col("m") > large // 2)
    whole = small(durable(whole, "whole")).withColumnRenamed("block", "own_block")
    met = rows.join(whole, (F.col("block") == F.col("own_block")) & (F.col("root") == F.col("own")), "left")
    turn = lambda of, n: F.pmod(F.xxhash64(of), F.ceil(F.col(n) / large))
    piece = F.when(F.col("own").isNotNull(), F.xxhash64("own", turn("node", "m"))).otherwise(turn("root", "n"))
    sliced = durable(met.select("block", "node", "root", "size", "rest", "own", piece.alias("slice")), "sliced")
    slices = durable(sliced.select("block", "slice", "own").distinct(), "slices")
    other = slices.select("block", F.col("slice").alias("other"), F.col("own").alias("other_own"))
    # A pair of slices for each two that hold different components.
    pairs = slices.join(other, "block").where((F.col("slice") <= F.col("other")) & ~F.coalesce(F.col("own") == F.col("other_own"), F.lit(False)))
    pairs = durable(pairs.select("block", F.col("slice").alias("i"), F.col("other").alias("j")), "slice_pairs")
    sliced = sliced.join(drawn, "node")
    for side, at in ((0, "i"), (1, "j")):
        own = pairs if side == 0 else pairs.where("i < j")
        met = sliced.withColumnRenamed("block", "own_block").join(own, (F.col("own_block") == F.col("block")) & (F.col("slice") == F.col(at)))
        out = out.unionByName(met.select("block", "i", "j", F.lit(side).alias("side"), *columns))
    return out


def neighbours(met: DataFrame, percent: float, large: int) -> DataFrame:
    """``u, v``: neighbours by size in each block, or in slices of a large one and among the slices' first."""
    counts = met.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > large)
    counts = small(durable(counts.withColumnRenamed("block", "wide"), "wide"))
    piece = F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / large)))
    rows = met.join(counts, F.col("block") == F.col("wide"), "left").withColumn("slice", piece)

    def chain(rows: DataFrame, *by: str) -> DataFrame:
        after = Window.partitionBy(*by).orderBy("size", "node")
        pairs = rows.select("size", "rest", "node", *[F.lead(c).over(after).alias(f"next_{c}") for c in ("size", "rest", "node")]).where("next_node is not null")
        least = F.ceil((F.col("size") + F.col("next_size")) * percent / (100 + percent) - 1e-6)
        pairs = pairs.where(F.least("rest", "next_rest") >= least)
        return pairs.select(F.least("node", "next_node").alias("u"), F.greatest("node", "next_node").alias("v"))

    first = F.min(F.struct("size", "node", "rest")).alias("x")
    heads = rows.where("n is not null").groupBy("block", "slice").agg(first).select("block", "x.*")
    return chain(rows, "block", "slice").unionByName(chain(heads, "block")).distinct()


def link(
    met: DataFrame, drawn: DataFrame, verified: Callable[[DataFrame], DataFrame], percent: float, close: DataFrame | None = None, large: int | None = None, nearest: tuple | None = None
) -> DataFrame:
    """``node, root`` of all nodes that links connect to others; root is the smallest node.

    ``met`` (written already) has the rows of the blocks, ``drawn`` a row for each
    node: ``held`` members that its sketch ``small`` counts, of all that may be in
    common.  ``verified`` keeps those of pairs ``u < v`` that are links; ``close``
    are pairs to be verified with the first ones.
    """
    spark, large, nearest = met.sparkSession, large or LARGE, nearest or NEAREST
    first = neighbours(met, percent, large)
    if close is not None:
        first = first.unionByName(close).distinct()
    first = durable(first, "pairs")
    edges, seen = verified(first), first
    found = connected_components(edges)
    for high in nearest:
        rooted = met.join(found, "node", "left").select("block", "node", "size", "rest", F.coalesce("root", "node").alias("root"))
        group = ["block", "i", "j"]
        dealt = _dealt(spark, durable(rooted, "rooted"), drawn, large).repartition(partitions(spark), *group).sortWithinPartitions(*group, "node")
        near = durable(dealt.mapInArrow(_near_pairs(percent, high), "u bigint, v bigint").distinct(), "near")
        more = near.where("u is null").limit(1).count() > 0
        rest = durable(near.where("u is not null").join(seen, ["u", "v"], "left_anti"), "rest")
        seen = seen.unionByName(rest)
        if rest.limit(1).count():
            links = verified(rest)
            if links.limit(1).count():
                edges = edges.unionByName(links)
                found = connected_components(edges)
        if not more:
            break
    return found
