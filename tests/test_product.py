"""Products through arrays equal those of Columns bit for bit; candidates lose no row that a selection keeps."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import metrics as M
from lodestar.model import KnnSpec
from lodestar.operators import distance, kernel, pivots
from lodestar.operators.distance import candidates, distances, kth_bound
from lodestar.operators.knn import knn_join, within_radius
from lodestar.operators.topk import STRATEGIES, top_k
from lodestar.operators.verify import mismatches
from lodestar.plans import algorithms, queries, runner

METRICS = ["l2", "l2_partial", "dot", "l1", "l3", "linf", "kl"]


def bits(df):
    return sorted((r.query_id, r.point_id, None if r.dist is None else "nan" if math.isnan(r.dist) else struct.pack(">d", r.dist)) for r in df.collect())


def by_column(points, asked, name):
    with M.registered("plain", M.metric(name)):
        return distances(points, asked, "plain")


def vectors(spark, n, q, d, seed=3):
    rng = np.random.default_rng(seed)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.random((n, d)))], "point_id long, p array<double>")
    return p, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.random((q, d)))], "query_id long, q array<double>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", METRICS)
def test_arrays_equal_columns(spark, name):
    points, asked = vectors(spark, 300, 9, 17)
    found = distances(points, asked, name)
    assert "MapInArrow" in plan(found) and "NestedLoop" not in plan(found)
    assert bits(found) == bits(by_column(points, asked, name))


@pytest.mark.parametrize("name", METRICS)
def test_odd_vectors(spark, name):
    """Nulls, other lengths, no components, not-a-number, infinities, zeros, negative numbers, no key."""
    odd = [[1.0, 2.0], [0.0, 3.0], [-0.0, -1.0], [math.nan, 1.0], [math.inf, 1.0], [-math.inf, 0.5], [None, 1.0], [1.0], [1.0, 2.0, 0.0], [], None, [None], [0.25, 0.5]]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "point_id long, p array<double>")
    q = p.select(F.col("point_id").alias("query_id"), F.col("p").alias("q"))
    assert bits(distances(p, q, name)) == bits(by_column(p, q, name))
    keyless = p.where("point_id < 2").select(F.lit(None).cast("long").alias("point_id"), "p")
    assert distances(keyless, q, name).count() == 26
    assert distances(p, q.limit(0), name).count() == 0 and distances(p.limit(0), q, name).count() == 0


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("k", [1, 7, 60])
def test_candidates_keep_what_counts(spark, largest, k):
    """Ties, copies, not-a-number and nulls, smallest and largest."""
    rng = np.random.default_rng(k)
    rows = [[float(x), 1.0] for x in rng.integers(0, 6, 150)] + [[math.nan, 0.0]] * 9 + [[None, 0.0]] * 5 + [[math.inf, 0.0], [1.0]]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "point_id long, p array<double>").repartition(3)
    q = spark.createDataFrame([(0, [2.0, 1.0]), (1, [math.nan, 1.0]), (2, [5.0, 0.0])], "query_id long, q array<double>")
    kept, every = candidates(p, q, k, largest=largest), distances(p, q)
    pick = lambda df: sorted(map(str, top_k(df, ["query_id"], "dist", ["point_id"], k, largest).collect()))
    assert pick(kept) == pick(every) and kept.count() <= every.count()


def test_few_rows_leave_the_product(spark):
    points, asked = vectors(spark, 4000, 5, 4)
    kept = candidates(points.coalesce(1), asked, 10)
    assert 50 <= kept.count() < 2000  # of 20,000
    for strategy in STRATEGIES:
        found = knn_join(points, asked, KnnSpec(10, strategy=strategy))
        assert bits(found) == bits(knn_join(points, asked, KnnSpec(10)))
        assert "NestedLoop" not in plan(found)
    assert "NestedLoop" not in plan(within_radius(points, asked, 10))


def test_large_k_is_bounded_first(spark, monkeypatch):
    monkeypatch.setattr(distance, "STEP", 8)
    monkeypatch.setattr(kernel, "BLOCK", 100)
    points, asked = vectors(spark, 2000, 4, 3)
    bound = {r.query_id: r.r for r in kth_bound(points, asked, 150).collect()}
    for query_id, r in bound.items():
        assert 150 <= distances(points, asked.where(F.col("query_id") == query_id)).where(F.col("dist") <= r).count() < 600
    kept = candidates(points, asked, 150)
    assert kept.count() < 0.4 * 8000
    pick = lambda df: bits(top_k(df, ["query_id"], "dist", ["point_id"], 150))
    assert pick(kept) == pick(distances(points, asked))


def test_names_of_queries_do_not_stay(spark, tmp_path):
    points, _ = vectors(spark, 250, 1, 64)
    points.select(F.col("point_id").alias("vec_id"), F.col("p").cast("array<float>").alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    before = sorted(M._METRICS), sorted(algorithms.ALGORITHMS)
    for f in (queries.knn_own_metric, queries.knn_own_algorithm):
        found = f(spark, str(tmp_path))
        assert found.count() == 30 and "NestedLoop" not in plan(found)
    assert (sorted(M._METRICS), sorted(algorithms.ALGORITHMS)) == before
    assert "NestedLoop" not in plan(queries.radius(spark, str(tmp_path)))


def test_kl_shares_are_linear(spark, tmp_path):
    """The sum of a vector is not taken again for each of its components."""
    points, _ = vectors(spark, 101, 1, 64)
    points.select(F.col("point_id").alias("vec_id"), F.col("p").cast("array<float>").alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = plan(queries.dist_kl(spark, str(tmp_path)))
    assert "NestedLoop" not in found and "MapInArrow" in found
    x = F.col("p")
    plainly = F.transform(x, lambda v: (v + 1) / M.fold(F.transform(x, lambda w: w + 1)))
    assert points.where(queries._share(x) == plainly).count() == 101
    shares = points.select(queries._share(x).alias("s"))
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_bench_keeps_few_rows(spark, monkeypatch):
    points, asked = vectors(spark, 3000, 5, 4)
    seen = []
    timed = runner._timed
    monkeypatch.setattr(runner, "_timed", lambda df: seen.append(df.count()) or timed(df))
    runner.bench(spark, "bits-sq", points, asked, 10)
    assert seen[0] < 0.2 * 15_000 and seen[1] == 50


def test_expected_is_made_once(spark):
    points, asked = vectors(spark, 200, 3, 4)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    found = knn_join(points, asked, KnnSpec(5))
    assert mismatches(found.mapInArrow(count, found.schema), found).count() == 0
    assert made.value == 15


def test_pivot_search_measures_in_blocks(spark):
    """Where nothing is ruled out few rows leave the product; results equal the plain search bit for bit."""
    points, asked = vectors(spark, 3000, 7, 12)
    index = pivots.build(points, pivots.choose_pivots(points, 3), 4)
    found = pivots.pivot_join(index, asked, 5)
    assert "MapInArrow" in plan(found) and "ArrayType" not in plan(found)
    rows = pivots._measured(index, pivots._reached(index, asked, 5), 5, True)
    assert 35 <= rows.count() < 6000  # of 21,000
    assert bits(found) == bits(top_k(by_column(points, asked, "l2"), ["query_id"], "dist", ["point_id"], 5))
