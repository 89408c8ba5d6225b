"""Merkle manifest of a dataset: one root for all rows, a proof for each of them.

Every row is a leaf, the hash of its fields.  The rows of a group, in order of
their key, are the leaves of a tree whose nodes hash ``arity`` consecutive nodes
each; the groups' subroots, in order, are the leaves of a last tree.

Trees are built by supersteps over an RDD of vertices.  A vertex stands for a run
of ``arity ** STRIDE`` nodes.  Going up, children message their vertex; when all
of them have, it hashes the levels between and forwards its own hash to the
vertex above.  Going down, a vertex sends each child the sibling path from it to
the root, so leaves can be verified where they are.  Every superstep going up is
written to the shared folder: a lost executor costs one superstep at most.  A
vertex holds as many hashes as its run, whatever the size of its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import durable, partitions, prepare, small
from lodestar.sources.vectors import sort_with_position
from lodestar.storage import new_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tree that a vertex climbs in one superstep.
STRIDE = 5
#: Vertices in a partition of the upper supersteps, about.
VERTICES = 64
#: Name of the tree over the groups.
GROUPS = -1


def joined(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(df: DataFrame, fields: tuple[str, ...], replaced: dict[str, Column] | None = None) -> Column:
    """Hash of a row: each field ``-`` if null, else its UTF-8 length, a colon and its value; fields as others if ``replaced``."""
    parts = []
    for name in fields:
        value = (replaced or {}).get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def levels(children: list[str], whole: bool, arity: int, stride: int) -> list[list[str]]:
    """The children and the levels above them: up to one node if they are a whole level, else ``stride`` of them."""
    out = [children]
    while len(out[-1]) > 1 if whole else len(out) <= stride:
        now = out[-1]
        out.append([joined(*now[i : i + arity]) for i in range(0, len(now), arity)])
    return out


def path(tree: list[list[str]], at: int, arity: int) -> list[tuple[str, str]]:
    """Siblings left and right of the node at ``at``, level by level."""
    out = []
    for level in tree[:-1]:
        low = at - at % arity
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + arity])))
        at //= arity
    return out


def folded(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings make."""
    for left, right in proof:
        leaf = joined(left, leaf, right)
    return leaf


def _placed(df: DataFrame, key: str, group: str, leaf: Column, other: Column) -> tuple[DataFrame, int, int, int]:
    """``rank`` of the group, ``n`` rows of it, ``pos`` in it, ``key, leaf, other``; number of groups; rows of the largest; all rows."""
    spark = df.sparkSession
    slim = durable(df.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), leaf.alias("leaf"), other.alias("other")), "leaves")
    order = [F.col("k").asc_nulls_first(), F.col("leaf")]
    ranged = slim.repartitionByRange(partitions(spark), F.col("g").asc_nulls_first(), *order)
    # Written once: counts and places must see the same ranges.
    ranged = durable(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    # At most one row for each range and each group that begins in it.
    counts = durable(ranged.groupBy("part", "g").agg(F.count("*").alias("c")), "counts")
    sizes = durable(counts.groupBy("g").agg(F.sum("c").alias("n")), "sizes")
    most = sizes.agg(F.count("*").alias("groups"), F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if not most.groups:
        return slim.select(F.lit(0).alias("rank"), F.lit(0).alias("n"), F.lit(0).alias("pos"), "k", "leaf", "other"), 0, 0, 0
    ranks = durable(sort_with_position(sizes, [F.col("g").asc_nulls_first()], "rank"), "ranks")
    before = (F.sum("c").over(Window.partitionBy("g").orderBy("part")) - F.col("c")).alias("before")
    starts = counts.select("part", "g", before).join(small(ranks).withColumnRenamed("g", "rg"), F.col("g").eqNullSafe(F.col("rg"))).drop("rg")
    starts = durable(starts.withColumnsRenamed({"part": "s_part", "g": "s_g"}), "starts")
    inside = F.row_number().over(Window.partitionBy("part", "g").orderBy(*order)) - 1
    numbered = ranged.withColumn("inside", inside)
    met = numbered.join(small(starts), (F.col("part") == F.col("s_part")) & F.col("g").eqNullSafe(F.col("s_g")))
    return met.select("rank", "n", (F.col("before") + F.col("inside")).alias("pos"), "k", "leaf", "other"), most.groups, most.most, most.total


def _written(rdd: RDD, df: DataFrame, name: str) -> RDD:
    """Written to the shared folder and read back."""
    at = new_path(df.sparkSession, name)
    rdd.saveAsPickleFile(at)
    return df.sparkSession.sparkContext.pickleFile(at)


class Forest:
    """Trees by group, as RDDs of vertices: one RDD for each superstep going up.

    A message goes to ``(group, number of the vertex)`` and holds ``(place among
    its children, hash, nodes of the level, what else the child brings)``.
    """

    def __init__(self, df: DataFrame, arity: int, stride: int):
        self.df, self.arity, self.stride, self.run = df, arity, stride, arity**stride

    def parts(self, nodes: int) -> int:
        return max(1, min(partitions(self.df.sparkSession), nodes // (self.run * VERTICES) + 1))

    def vertices(self, messages: RDD, parts: int, name: str) -> RDD:
        """One superstep: ``(vertex, (nodes of the level, children in order))`` of vertices that all children have messaged."""
        run = self.run

        def complete(item):
            (group, at), children = item
            children = sorted(children, key=lambda c: c[0])
            nodes = children[0][2]
            if len(children) != min(run, nodes - at * run):
                raise ValueError(f"vertex {at} of tree {group} misses children")
            return (group, at), (nodes, [(c[1], c[3]) for c in children])

        return _written(messages.groupByKey(parts).map(complete), self.df, name)

    def upward(self, vertices: RDD) -> RDD:
        """Vertices' own hashes as messages to those above; of the last one of a tree, to nobody."""
        run, arity, stride = self.run, self.arity, self.stride

        def send(item):
            (group, at), (nodes, children) = item
            own = levels([c[0] for c in children], nodes <= run, arity, stride)[-1][0]
            return (group, at // run), (at % run, own, -(-nodes // run), nodes <= run)

        return vertices.map(send)

    def climb(self, messages: RDD, nodes: int, total: int, name: str) -> tuple[list[RDD], RDD]:
        """All supersteps going up, and the roots as ``(group, (root, superstep that ended it))``."""
        steps, ended = [], None
        while True:
            steps.append(self.vertices(messages, self.parts(total), name))
            sent, step = self.upward(steps[-1]), len(steps) - 1
            done = sent.filter(lambda m: m[1][3]).map(lambda m, step=step: (m[0][0], (m[1][1], step)))
            ended = done if ended is None else ended.union(done)
            if nodes <= self.run:
                return steps, ended
            messages = sent.filter(lambda m: not m[1][3]).mapValues(lambda c: (*c[:3], None))
            nodes, total = -(-nodes // self.run), -(-total // self.run)

    def downward(self, vertices: RDD, news: RDD, parts: int) -> RDD:
        """News ``(vertex, (path to the root, own root, what roots bring))`` to all children: ``(child's place, (path, own root, rest, child))``."""
        run, arity, stride = self.run, self.arity, self.stride

        def send(item) -> Iterator:
            (group, at), ((nodes, children), (above, subroot, root)) = item
            tree = levels([c[0] for c in children], nodes <= run, arity, stride)
            for i, child in enumerate(children):
                yield (group, at * run + i), (path(tree, i, arity) + above, subroot, root, child)

        return vertices.join(news, parts).flatMap(send)


def verify(
    df: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = FIELDS,
    offered: Column | None = None,
    arity: int = 3,
    proofs: bool = False,
    stride: int = STRIDE,
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, hashes as lowercase hex.

    ``offered`` is the leaf (32 bytes) that is checked against the manifest in
    place of the row's own, where not null; see :func:`leaf_of`.  ``proof_sha256``
    is the hash of all siblings up to the root; with ``proofs`` a column ``proof``
    has them, an array of ``left, right`` by level.

    Groups go in order of their text, null first; rows of a group by key, null
    first, then by leaf.  Null fields count as null, empty texts as empty.  Rows
    that repeat are leaves of their own.  Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])
    if proofs:
        schema.add("proof", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))
    rows, groups, largest, total = _placed(df, key, group, leaf_of(df, fields), F.lit(None).cast("binary") if offered is None else offered)
    if not groups:
        return spark.createDataFrame([], schema)
    forest = Forest(df, arity, stride)
    run, parts = forest.run, partitions(spark)
    leaves = rows.rdd.map(lambda r: ((r.rank, r.pos // run), (r.pos % run, r.leaf.hex(), r.n, (r.k, r.other.hex() if r.other is not None else None))))
    steps, subroots = forest.climb(leaves, largest, total, "vertices")
    tops = subroots.map(lambda x: ((GROUPS, x[0] // run), (x[0] % run, x[1][0], groups, (x[0], x[1][1]))))
    high, root = forest.climb(tops, groups, groups, "groups")

    news = root.map(lambda x: ((GROUPS, 0), ([], None, x[1][0])))
    for vertices in reversed(high):
        news = forest.downward(vertices, news, forest.parts(groups)).map(lambda x: (x[0], (x[1][0], x[1][3][0], x[1][2], x[1][3][1])))
        if vertices is not high[0]:
            news = news.mapValues(lambda x: x[:3])
    # Now news of the groups' subroots, each for the last vertex of its tree.
    ends = news.map(lambda x: (x[1][3][1], ((x[1][3][0], 0), x[1][:3])))
    news = None
    for step in reversed(range(len(steps))):
        own = ends.filter(lambda x, step=step: x[0] == step).map(lambda x: x[1])
        news = own if news is None else news.union(own)
        news = forest.downward(steps[step], news, parts if step == 0 else forest.parts(total // run**step))
        if step:
            news = news.mapValues(lambda x: x[:3])

    def result(item):
        proof, subroot, top, (leaf, (k, other)) = item[1]
        found = folded(leaf if other is None else other, proof)
        out = (k, leaf, subroot, top, joined(*[x for pair in proof for x in pair]), found, found == top)
        return (*out, proof) if proofs else out

    return spark.createDataFrame(news.map(result), schema, verifySchema=False)
