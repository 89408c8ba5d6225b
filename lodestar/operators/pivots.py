"""Exact nearest neighbours through a table of distances to pivots.

For any pivot v, |d(p, v) - d(q, v)| is no more than d(p, q): the largest over
all pivots is a lower bound that needs no vector.  Points are grouped in rings
around their nearest pivot; a ring's smallest and largest distances to every
pivot bound all of its points.  A query joins the rings that its radius reaches,
and there the points whose own bound does; only those are measured.

The index is a table; points are never shuffled by a search.  Rings are few
(pivots times ``rings``) and are broadcast, and so are queries with their rings,
in slices of checked size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.metrics import arrays, squared_l2
from lodestar.model import positive
from lodestar.operators import kernel
from lodestar.operators.distance import MOST_BYTES, slices, spread
from lodestar.operators.topk import top_k
from lodestar.shipping import ship
from lodestar.storage import durable

#: Allowance for rounding, relative: bounds are never used closer than that.
SLACK = 1e-9
#: Pivots and rings at most: rings are broadcast.
MOST_PIVOTS, MOST_RINGS = 64, 1024


@dataclass(frozen=True)
class PivotIndex:
    """``points(point_id, p, pivot, ring, d0, d1, ...)``, ``rings(pivot, ring, n, lo0, hi0, ...)`` and the pivots' vectors."""

    points: DataFrame
    rings: DataFrame
    pivots: list[list[float]]

    @property
    def numbers(self) -> range:
        return range(len(self.pivots))


def choose_pivots(points: DataFrame, count: int, among: int = 64) -> list[list[float]]:
    """Vectors far from each other, of ``among * count`` points that their ids' hash picks: which ones decides the cost only."""
    positive(count=count, among=among)
    some = [r.p for r in points.where("p is not null").orderBy(F.xxhash64("point_id"), "point_id").select("p").limit(among * count).collect()]
    if not some:
        return []
    out, nearest = [], [math.inf] * len(some)
    at = 0
    while len(out) < min(count, len(some)):
        out.append(some[at])
        nearest = [min(d, math.dist(some[at], x)) for d, x in zip(nearest, some)]
        at = max(range(len(some)), key=nearest.__getitem__)
        if nearest[at] == 0:
            break
    return out


def _to_pivots(vector: Column, pivots: list[list[float]]) -> list[Column]:
    return [F.sqrt(squared_l2(vector, F.array(*map(F.lit, v)))).alias(f"d{i}") for i, v in enumerate(pivots)]


def build(points: DataFrame, pivots: list[list[float]], rings: int = 16, path: str | None = None) -> PivotIndex:
    """The index of ``points``, written to ``path`` (or the shared folder) and read from there."""
    positive(rings=rings, pivots=len(pivots))
    if len(pivots) > MOST_PIVOTS or rings > MOST_RINGS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots and {MOST_RINGS} rings")
    names = [f"d{i}" for i in range(len(pivots))]
    measured = spread(points.select("point_id", "p")).select("point_id", "p", *_to_pivots(F.col("p"), pivots))
    near = F.least(*map(F.col, names)) if len(names) > 1 else F.col("d0")
    pivot = F.array_position(F.array(*names), near).cast("int") - 1
    measured = durable(measured.withColumns({"pivot": pivot, "near": near}), "to-pivots")
    widths = {r.pivot: r.width for r in measured.groupBy("pivot").agg(F.max("near").alias("width")).collect()}  # a number for each pivot
    width = F.element_at(F.create_map(*[x for k, v in widths.items() for x in (F.lit(k), F.lit(v))]), F.col("pivot")) if widths else F.lit(0.0)
    ring = F.when(width > 0, F.least(F.floor(F.col("near") / width * rings), F.lit(rings - 1))).otherwise(0).cast("int")
    placed = measured.withColumn("ring", ring).select("point_id", "p", "pivot", "ring", *names)
    if path is None:
        placed = durable(placed, "pivot-index")
    else:
        placed.write.mode("errorifexists").parquet(path)
        placed = points.sparkSession.read.schema(placed.schema).parquet(path)
    ends = [f(n).alias(f"{at}{i}") for i, n in enumerate(names) for f, at in ((F.min, "lo"), (F.max, "hi"))]
    return PivotIndex(placed, durable(placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), *ends), "rings"), pivots)


def _reached(index: PivotIndex, part: DataFrame, k: int) -> DataFrame:
    """``query_id, q, d0.., r, pivot, ring, n``: the rings that may hold one of the k nearest; ``r`` bounds the k-th's distance."""
    asked = durable(part.select("query_id", "q", *_to_pivots(F.col("q"), index.pivots)), "asked")
    met = asked.crossJoin(F.broadcast(index.rings))
    greatest = lambda parts: F.greatest(*parts) if len(parts) > 1 else parts[0]
    least = lambda parts: F.least(*parts) if len(parts) > 1 else parts[0]
    low = greatest([F.greatest(F.col(f"lo{i}") - F.col(f"d{i}"), F.col(f"d{i}") - F.col(f"hi{i}"), F.lit(0.0)) for i in index.numbers])
    high = least([F.col(f"hi{i}") + F.col(f"d{i}") for i in index.numbers])
    rows = durable(met.select("query_id", "q", *[f"d{i}" for i in index.numbers], "pivot", "ring", "n", low.alias("low"), high.alias("high")), "bounds")

    def radius(rows: DataFrame, by: str) -> DataFrame:
        """Of each query the first rings in an order that hold k points, by the largest of ``by`` among them."""
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(by, "pivot", "ring"))
        return rows.withColumn("upto", upto).where(F.col("upto") - F.col("n") < k)

    # Without measuring: so many rings that end within r hold k points.
    first = radius(rows, "high").groupBy("query_id").agg(F.when(F.max("upto") >= k, F.max("high")).alias("r"))
    rows = rows.join(first, "query_id").withColumn("r", F.coalesce("r", F.lit(math.inf)))
    rows = durable(rows.where(F.col("low") <= F.col("r") * (1 + SLACK)), "near-rings")
    # Measured in the nearest rings that hold k points: the radius is that of the k-th there.
    dist = _measured(index, radius(rows, "low"), k, False)
    kth = top_k(dist, ["query_id"], "dist", ["point_id"], k).where(F.col("rank") == k).select("query_id", F.sqrt("dist").alias("own"))
    rows = rows.join(durable(kth, "radius"), "query_id", "left").withColumn("r", F.least("r", F.coalesce("own", F.lit(math.inf))) * (1 + SLACK)).drop("own")
    return durable(rows.where(F.col("low") <= F.col("r")).drop("low", "high"), "reached")


def _near(index: PivotIndex, reached: DataFrame) -> DataFrame:
    """``query_id, point_id, p, q`` of points that neither their ring nor their own distances rule out."""
    bounds = [F.abs(F.col(f"points.d{i}") - F.col(f"asked.d{i}")) <= F.col("asked.r") for i in index.numbers]
    meets = (F.col("points.pivot") == F.col("asked.pivot")) & (F.col("points.ring") == F.col("asked.ring"))
    for b in bounds:
        meets &= b
    met = index.points.alias("points").join(F.broadcast(reached).alias("asked"), meets)
    return met.select("asked.query_id", "points.point_id", "points.p", "asked.q")


def _measured(index: PivotIndex, rows: DataFrame, k: int, bounded: bool) -> DataFrame:
    """``query_id, point_id, dist`` of the queries' points in the rings of ``rows``, without those that k others beat.

    ``bounded``: and without those that the distances to pivots rule out.  Rings
    that no query asks for are dropped by a broadcast join; the others' points meet
    their queries in blocks of arrays (:func:`lodestar.operators.kernel.in_rings`).
    """
    spark, names = rows.sparkSession, [f"d{i}" for i in index.numbers]
    radius = F.col("r") if bounded else F.lit(math.inf)
    # Bounded by the size of a slice of queries.
    asked = rows.groupBy("query_id").agg(*[F.first(c).alias(c) for c in ("q", *names)], F.first(radius).alias("r"), F.collect_list(F.col("pivot") * MOST_RINGS + F.col("ring")).alias("at")).orderBy("query_id").toArrow()
    if not len(asked):
        return spark.createDataFrame([], "query_id bigint, point_id bigint, dist double")
    ids, radii = asked["query_id"].to_numpy(), asked["r"].to_numpy()
    vectors = asked["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    to_pivots = np.stack([asked[n].to_numpy() for n in names], axis=1)
    at = asked["at"].combine_chunks()
    rings: dict[int, list[int]] = {}
    for number, ring in zip(np.repeat(np.arange(len(ids)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()):
        rings.setdefault(int(ring), []).append(int(number))
    places = {ring: np.array(numbers) for ring, numbers in rings.items()}
    ship(spark)
    inside = index.points.join(F.broadcast(rows.select("pivot", "ring").distinct()), ["pivot", "ring"], "left_semi")
    inside = inside.select("point_id", "p", (F.col("pivot") * MOST_RINGS + F.col("ring")).alias("at"), F.array(*names).alias("d"))
    search = kernel.in_rings(ids, vectors, to_pivots, radii, places, arrays("l2").block, kernel.Kept(k))
    return inside.mapInArrow(search, "query_id bigint, point_id bigint, dist double")


def _slices(index: PivotIndex, queries: DataFrame, most_bytes: int) -> list[DataFrame]:
    rings = max(1, index.rings.count())
    dim = len(index.pivots[0])
    return slices(queries, most_bytes, rings * (8 * dim + 8 * len(index.pivots) + 64))


def pivot_join(index: PivotIndex, queries: DataFrame, k: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, rank, point_id, dist`` as the search without an index gives them, distances bit for bit.

    Squared L2 distances between finite vectors of the pivots' length.
    """
    positive(k=k)
    out = None
    for part in _slices(index, queries, most_bytes):
        one = _measured(index, _reached(index, part, k), k, True)
        out = one if out is None else out.unionByName(one)
    return top_k(out, ["query_id"], "dist", ["point_id"], k)


def pivot_work(index: PivotIndex, queries: DataFrame, k: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, points, in_rings, measured``: of all points those in rings that a query reaches, and those that are measured."""
    positive(k=k)
    total, out = index.rings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points")), None
    for part in _slices(index, queries, most_bytes):
        reached = _reached(index, part, k)
        rings = reached.groupBy("query_id").agg(F.sum("n").alias("in_rings"))
        measured = _near(index, reached).groupBy("query_id").agg(F.count("*").alias("measured"))
        one = rings.join(measured, "query_id", "left").crossJoin(F.broadcast(total))
        one = one.select("query_id", "points", "in_rings", F.coalesce("measured", F.lit(0)).cast("long").alias("measured"))
        out = one if out is None else out.unionByName(one)
    return out
