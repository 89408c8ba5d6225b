"""Phase-timed runs of a named algorithm, logged row by row."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.model import BENCH, PHASES, positive
from lodestar.operators.distance import candidates
from lodestar.operators.topk import top_k
from lodestar.plans.algorithms import ALGORITHMS, run
from lodestar.sources.vectors import generate


def _timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


#: Distances of one problem, at most.
MOST_DISTANCES = 1 << 32


def feasible(points: int, queries: int, k: int) -> bool:
    """Whether a benchmark measures this problem."""
    return points * queries <= MOST_DISTANCES and k <= points


def feasible_rows(points: Column, queries: Column, k: Column) -> Column:
    """The same for columns, without overflow."""
    pairs = points.cast("decimal(38,0)") * queries.cast("decimal(38,0)")
    return (pairs <= F.lit(MOST_DISTANCES)) & (k <= points)


def bench_grid(spark: SparkSession, names: list[str], problems: list[tuple[int, int, int, int]], generator: str = "uniform", repeats: int = 1, seed: int = 1) -> DataFrame:
    """The log of every algorithm on every feasible problem ``(points, queries, dim, k)``."""
    out = spark.createDataFrame([], BENCH)
    for points, queries, dim, k in problems:
        if feasible(points, queries, k):
            p, q = generate(spark, generator, points, queries, dim, seed)
            for name in names:
                out = out.unionByName(bench(spark, name, p, q, k, repeats, generator=generator))
    return out


def bench(
    spark: SparkSession,
    name: str,
    points: DataFrame,
    queries: DataFrame,
    k: int,
    repeats: int = 1,
    deg: int = 8,
    generator: str = "",
    preprocessor: str = "identity",
    block_size: int = 0,
    items_per_thread: str = "1,1,1",
    postprocess: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One log row for each phase and repeat.

    ``postprocess`` is applied to the result, in a phase of its own.  Block size
    and items are logged as given; no plan depends on them.

    Two-phase algorithms time the distances, all of which are computed, and the
    selection from those that are kept, for k others of their block beat the rest;
    fused ones have all of it in ``selection``.  Phases without a
    counterpart in Spark take no time.
    """
    positive(k=k, repeats=repeats, deg=deg)
    if name not in ALGORITHMS:
        raise ValueError(f"Unsupported algorithm {name!r}")
    a = ALGORITHMS[name]
    n, q = points.count(), queries.count()
    positive(points=n, queries=q)
    dim = len(points.first()["p"])
    rows = []
    for i in range(repeats):
        spent = dict.fromkeys(PHASES, 0.0)
        if not a.selects:
            spent["distances"] = _timed(run(name, points, queries, k, deg))
        elif a.strategy in ("fused", "radius", "custom"):
            spent["selection"] = _timed(run(name, points, queries, k, deg))
        else:
            matrix = candidates(points, queries, k, a.metric).persist()
            spent["distances"] = _timed(matrix)
            spent["selection"] = _timed(top_k(matrix, ["query_id"], "dist", ["point_id"], k, strategy=a.strategy, deg=deg))
            matrix.unpersist()
        if postprocess is not None:
            found = run(name, points, queries, k, deg).persist()
            _timed(found)
            spent["postprocessing"] = _timed(postprocess(found))
            found.unpersist()
        rows += [(name, generator, preprocessor, i, n, q, dim, block_size, k, items_per_thread, deg, phase, spent[phase]) for phase in PHASES]
    return spark.createDataFrame(rows, BENCH)
