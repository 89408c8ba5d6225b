"""Distances between all queries and all points, long form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.metrics import Arrays, arrays
from lodestar.functions.metrics import metric as metric_of
from lodestar.model import positive
from lodestar.operators import kernel
from lodestar.shipping import ship
from lodestar.storage import durable

#: Bytes of queries that are broadcast at once.
MOST_BYTES = 64 * 1024 * 1024


def slices(queries: DataFrame, most_bytes: int = MOST_BYTES, beside: int = 0) -> list[DataFrame]:
    """Queries in slices of checked size, ``beside`` bytes a query included; one slice if all of them fit."""
    size = queries.agg(F.coalesce(F.sum(F.size("q") * 8 + 32 + beside), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // most_bytes)) if size > most_bytes else 1
    if n == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def spread(points: DataFrame) -> DataFrame:
    """Points over at least as many partitions as there are cores: a small file is one split."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return points.repartition(cores) if points.rdd.getNumPartitions() < cores else points


def distances(points: DataFrame, queries: DataFrame, metric: str = "l2", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, point_id, dist``.  Every query slice is broadcast to the points, which never shuffle for the product."""
    return product(points, queries, metric, most_bytes)


def candidates(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", most_bytes: int = MOST_BYTES, largest: bool = False) -> DataFrame:
    """The rows of :func:`distances` without those that k others of their query beat: what any selection of k gives is the same.

    Blocks of points rule rows out before they leave the task.  A k beyond a block
    needs a bound first: see :func:`kth_bound`.
    """
    positive(k=k)
    bounds = None
    if 2 * k > kernel.BLOCK and not largest and points.count() >= 2 * k:
        bounds = kth_bound(points, queries, k, metric, most_bytes)
    return product(points, queries, metric, most_bytes, bounds, kernel.Kept(k, largest))


#: Of a block's distances in order one of so many is counted.
STEP = 128


def kth_bound(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, r``: a distance that k points do not exceed, and not many more than k.

    Of each block's distances in order every ``STEP``-th is a row.  The m-th
    smallest of a query's rows has ``m * STEP`` points at or below it.
    """
    steps = product(points, queries, metric, most_bytes, keep=kernel.Steps(STEP), others=False)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("dist"))
    kth = steps.select("query_id", "dist", place.alias("place")).where(F.col("place") == -(-k // STEP))
    return durable(kth.select("query_id", F.col("dist").alias("r")), "bounds")


def product(
    points: DataFrame,
    queries: DataFrame,
    metric: str = "l2",
    most_bytes: int = MOST_BYTES,
    bounds: DataFrame | None = None,
    keep: kernel.Kept | kernel.Steps | None = None,
    others: bool = True,
) -> DataFrame:
    """``query_id, point_id, dist`` of all pairs, or of those that ``keep`` and ``bounds`` (``query_id, r``) let through.

    Pairs go through the metric's form on arrays where it has one.  The others
    (vectors of other lengths, with nulls or without a key, other types) are
    measured by the Column, without ``keep``; ``others=False`` leaves them out.
    A null bound admits all; not-a-number is larger than any bound.
    """
    measure, form = metric_of(metric), arrays(metric)
    points = points.select("point_id", "p")
    near, out = None, []

    def columns(some: DataFrame, asked: DataFrame) -> None:
        dist = measure(F.col("p"), F.col("q"))
        pairs = some.crossJoin(F.broadcast(asked)) if bounds is None else some.join(F.broadcast(asked), F.coalesce(dist <= F.col("r"), F.lit(True)))
        out.append(pairs.select("query_id", "point_id", dist.alias("dist")))

    for part in slices(queries, most_bytes, 8 if bounds is not None else 0):
        near = spread(points) if near is None else near
        asked = part.select("query_id", "q")
        if bounds is not None:
            asked = asked.join(bounds, "query_id", "left")
        fits = _asked(asked, form) if form is not None and _plain(points, asked) else None
        if fits is None:
            if others:
                columns(near, asked)
            continue
        ids, vectors, limits, dim, regular, odd_queries = fits
        alike = _regular("p", "point_id", form.point) & (F.size("p") == dim)
        odd_points = points.where(~alike).count()
        if others and odd_queries:
            columns(near, asked.where(~regular))
        if others and odd_points:
            columns(near.where(~alike), asked.where(regular))
        some = near.where(alike) if odd_points else near
        some = some.select("point_id", form.prepare(F.col("p")).alias("p") if form.prepare else "p")
        ship(points.sparkSession)
        search = kernel.pairs(ids, vectors, form.block, limits if bounds is not None else None, keep)
        out.append(some.mapInArrow(search, "query_id bigint, point_id bigint, dist double"))
    if not out:
        return points.sparkSession.createDataFrame([], "query_id bigint, point_id bigint, dist double")
    return reduce(DataFrame.unionByName, out)


def _plain(points: DataFrame, asked: DataFrame) -> bool:
    """Whether keys are longs and components doubles, as arrays hold them."""
    kinds = [f.dataType.simpleString() for f in (points.schema["point_id"], points.schema["p"], asked.schema["query_id"], asked.schema["q"])]
    return kinds == ["bigint", "array<double>"] * 2


def _regular(vector: str, key: str, fits: Callable[[Column], Column] | None) -> Column:
    """Whether a vector may go to the metric's form on arrays, its length apart; never null."""
    sound = F.forall(vector, lambda x: x.isNotNull() & fits(x) if fits else x.isNotNull())
    return F.col(key).isNotNull() & F.coalesce(sound & (F.size(vector) > 0), F.lit(False))


def _asked(asked: DataFrame, form: Arrays):
    """Keys, vectors and bounds of a slice's regular queries, their length, what tells them, and how many are not; None without any."""
    sound = _regular("q", "query_id", form.query)
    dims = asked.groupBy(F.when(sound, F.size("q")).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()
    known = [r for r in dims if r.dim is not None]
    if not known:
        return None
    dim = known[0].dim
    regular = sound & (F.size("q") == dim)
    vector = form.prepare(F.col("q")) if form.prepare else F.col("q")
    bound = F.col("r") if "r" in asked.columns else F.lit(None).cast("double")
    found = asked.where(regular).select("query_id", vector.alias("q"), bound.alias("r")).orderBy("query_id").toArrow()  # bounded by most_bytes
    ids = found["query_id"].to_numpy()
    vectors = found["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    limits = found["r"].to_numpy().astype(float)
    return ids, vectors, limits, dim, regular, len(dims) > 1


#: Lengths of queries that are looked at; the most frequent one goes to the form on arrays.
MOST_LENGTHS = 16
