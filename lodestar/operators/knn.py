"""The k nearest points of every query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.model import KnnSpec
from lodestar.operators import kernel
from lodestar.operators.distance import MOST_BYTES, candidates, product, slices, spread
from lodestar.operators.topk import STRATEGIES, top_k
from lodestar.shipping import ship
from lodestar.storage import durable

FUSED_METRICS = ("l2", "l2_partial")


def knn_join(points: DataFrame, queries: DataFrame, spec: KnnSpec, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, rank, point_id, dist``, ascending, equal distances by ``point_id``.

    No strategy keeps the distance matrix: ``fused`` holds k rows a query, the
    others select from :func:`candidates`, ``radius`` from what a first block's
    radius lets through.
    With fewer points than k a query has as many rows, or k
    rows padded by (-1, infinity) if ``spec.pad``.
    """
    if spec.strategy == "radius":
        if spec.precision != "double":
            raise ValueError(f"Unsupported precision {spec.precision!r} with strategy {spec.strategy!r}")
        found = top_k(within_radius(points, queries, spec.k, spec.metric, most_bytes=most_bytes), ["query_id"], "dist", ["point_id"], spec.k)
    elif spec.strategy == "fused":
        if spec.metric in FUSED_METRICS:
            found = _fused(points, queries, spec, most_bytes)
        elif spec.precision != "double":
            raise ValueError(f"Unsupported precision {spec.precision!r} with metric {spec.metric!r}")
        else:
            found = top_k(candidates(points, queries, spec.k, spec.metric, most_bytes), ["query_id"], "dist", ["point_id"], spec.k)
    elif spec.strategy in STRATEGIES:
        if spec.precision != "double":
            raise ValueError(f"Unsupported precision {spec.precision!r} with strategy {spec.strategy!r}")
        rows = candidates(points, queries, spec.k, spec.metric, most_bytes)
        if spec.strategy == "radix":  # reads its rows once a pass
            rows = durable(rows, "product")
        found = top_k(rows, ["query_id"], "dist", ["point_id"], spec.k, strategy=spec.strategy, deg=spec.deg)
    else:
        raise ValueError(f"Unsupported strategy {spec.strategy!r}")
    return _padded(found, queries, spec.k) if spec.pad else found


def _fused(points: DataFrame, queries: DataFrame, spec: KnnSpec, most_bytes: int) -> DataFrame:
    ship(points.sparkSession)
    near, out = spread(points.select("point_id", "p")), None
    search = kernel.certified if spec.certify else kernel.nearest
    # A task holds k rows of 16 bytes a query, so they count as well.
    for part in slices(queries, most_bytes, 16 * spec.k):
        rows = part.select("query_id", "q").orderBy("query_id").collect()  # bounded by most_bytes
        if not rows:
            continue
        ids, vectors = np.array([r.query_id for r in rows], np.int64), np.array([r.q for r in rows], np.float64)
        one = near.mapInArrow(search(ids, vectors, spec.k, spec.metric, spec.precision), "query_id bigint, point_id bigint, dist double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = points.sparkSession.createDataFrame([], "query_id bigint, point_id bigint, dist double")
    return top_k(out, ["query_id"], "dist", ["point_id"], spec.k)


def _padded(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    grid = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    filled = grid.join(found, ["query_id", "rank"], "left")
    return filled.select("query_id", "rank", F.coalesce("point_id", F.lit(-1).cast("long")).alias("point_id"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


#: One point of so many is in the first block, by its id.
FIRST = 16


def first_radius(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", share: int = FIRST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, r``: the distance of the k-th nearest among the first block, which no k-th of all can exceed; none where the block has fewer."""
    block = points.where(F.pmod("point_id", F.lit(share)) == 0)
    kth = top_k(candidates(block, queries, k, metric, most_bytes), ["query_id"], "dist", ["point_id"], k).where(F.col("rank") == k)
    return durable(kth.select("query_id", F.col("dist").alias("r")), "radius")


def within_radius(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", share: int = FIRST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``query_id, point_id, dist`` of the pairs that may be among the k nearest.

    A first block of points bounds every query's k-th distance.  The bound goes
    with the query into the product, so other pairs never leave it; k rows of
    every query do.
    """
    return product(points, queries, metric, most_bytes, first_radius(points, queries, k, metric, share, most_bytes))


def radius_filter(dist: DataFrame, k: int) -> DataFrame:
    """Rows strictly closer than their query's k-th nearest."""
    kth = top_k(dist, ["query_id"], "dist", ["point_id"], k).groupBy("query_id").agg(F.max(F.struct("rank", "dist")).alias("last"))
    return dist.join(kth, "query_id").where((F.col("last.rank") < k) | (F.col("dist") < F.col("last.dist"))).select("query_id", "point_id", "dist")


def checksum(found: DataFrame) -> DataFrame:
    """``query_id, checksum``: sum of neighbours' ids modulo 2^32."""
    return found.groupBy("query_id").agg(F.pmod(F.sum("point_id"), F.lit(1 << 32)).alias("checksum"))


def write_neighbors(found: DataFrame, path: str) -> dict[str, int]:
    """Write neighbours as Parquet; ``rows`` and ``checksum`` are counted in the pass that writes."""
    seen = Observation("neighbors")
    ids = F.coalesce(F.sum("point_id"), F.lit(0))
    found.observe(seen, F.count("*").alias("rows"), F.pmod(ids, F.lit(1 << 32)).alias("checksum")).write.parquet(path)
    return {name: int(value) for name, value in seen.get.items()}


def total_checksum(found: DataFrame) -> int:
    return int(found.agg(F.pmod(F.coalesce(F.sum("point_id"), F.lit(0)), F.lit(1 << 32))).first()[0])
