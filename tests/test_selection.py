"""Radix selection, pivots, radius, certified precision, kept states, counters of generated data."""

import datetime
import math
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.model import KnnSpec
from lodestar.operators import kernel, pivots
from lodestar.operators.distance import distances
from lodestar.operators.knn import knn_join, within_radius, write_neighbors
from lodestar.operators.radix import histogram, ordered_key, radix_rows
from lodestar.operators.running import RunningTopK, from_state, merge, to_state
from lodestar.operators.topk import top_k
from lodestar.sources import vectors as V

ODD = [0.0, -0.0, 1.0, -1.0, 2.0**-1022, 2.0**-1074, -(2.0**-1074), 2.0**-1030, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan, None, 0.1, 1 / 3, 2.0**52 + 1, math.nextafter(1, 2), math.nextafter(1, 0), math.nextafter(2, 0)]


def plain(df):
    return sorted(map(str, df.collect()))


def test_keys_order_as_values(spark):
    random.seed(1)
    values = [x for x in ODD if x is not None and not math.isnan(x)] + [random.choice([-1, 1]) * 2.0 ** random.uniform(-1074, 1023) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    rows = df.select("v", ordered_key(F.col("v"), T.DoubleType()).alias("k")).collect()
    bits = lambda x: int(np.array([abs(x) + 0.0]).view(np.int64)[0]) * (-1 if x < 0 else 1)
    assert [r.k for r in rows] == [bits(r.v) for r in rows]
    kinds = [(T.IntegerType(), [3, -5, 0]), (T.DateType(), [datetime.date(1960, 1, 1), datetime.date(2020, 1, 2), datetime.date(2020, 1, 1)]), (T.TimestampType(), [datetime.datetime(2020, 1, 1, 0, 0, 0, 1), datetime.datetime(1969, 1, 1)]), (T.DecimalType(10, 3), [Decimal("1.500"), Decimal("-0.001"), Decimal("0.999")]), (T.FloatType(), [0.5, -2.0, 3.25]), (T.BooleanType(), [True, False])]
    for kind, given in kinds:
        rows = spark.createDataFrame([(x,) for x in given], T.StructType([T.StructField("v", kind)])).select("v", ordered_key(F.col("v"), kind).alias("k")).collect()
        assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(given)
    with pytest.raises(ValueError):
        ordered_key(F.lit("x"), T.StringType())


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("k, bits, most", [(1, 11, 200_000), (7, 8, 200_000), (40, 16, 2), (500, 11, 200_000)])
def test_radix_equals_sort(spark, largest, k, bits, most):
    """Ties, nulls, not-a-number, infinities; groups smaller than k, of nulls only, null themselves; more groups than fit at once."""
    random.seed(k)
    rows = [(random.choice(["a", "a", "b", None]), random.choice(ODD), i) for i in range(300)]
    rows += [("c", None, i) for i in range(5)] + [("d", 1.0, i) for i in range(60)] + [("e", float(i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    kept = radix_rows(df, ["g"], "v", k, largest, bits, most)
    assert plain(top_k(kept, ["g"], "v", ["id"], k, largest)) == plain(top_k(df, ["g"], "v", ["id"], k, largest, "sort"))


def test_radix_shuffles_counts_only(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"), "id")
    key = ordered_key(F.col("v"), T.DoubleType())
    counts = histogram(df.withColumn("_ls_key", key), ["g"], 53, None, 64)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Sort" not in plan
    counts.collect()
    assert counts.count() < 100
    kept = radix_rows(df, ["g"], "v", 5)
    assert kept.count() < 200  # what is ranked at the end
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def _random(spark, n, q, d, seed=3):
    points, queries = V.generate(spark, "uniform:-1,1", n, q, d, seed)
    return points.persist(), queries.persist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double, id long")
    assert top_k(df, ["g"], "v", ["id"], 3, strategy="radix").collect() == []


@pytest.mark.parametrize("n, q, d, k", [(900, 7, 2, 5), (50, 3, 5, 60), (300, 5, 16, 1)])
def test_pivots_equal_search(spark, n, q, d, k):
    points, queries = _random(spark, n, q, d)
    wanted = plain(knn_join(points, queries, KnnSpec(k, strategy="sort")))
    for count, rings in ((1, 1), (4, 8)):
        index = pivots.build(points, pivots.choose_pivots(points, count), rings)
        assert plain(pivots.pivot_join(index, queries, k)) == wanted
    assert plain(pivots.pivot_join(index, queries, k, most_bytes=5000)) == wanted  # queries in slices


def test_pivots_skip(spark, tmp_path):
    """In two dimensions most points are never measured; a point's copies and the queries' own points are found."""
    points, _ = _random(spark, 4000, 1, 2)
    points = points.unionByName(points.where("point_id < 40").select((F.col("point_id") + 10_000).alias("point_id"), "p"))
    queries = points.where("point_id % 1000 = 0").select(F.col("point_id").alias("query_id"), F.col("p").alias("q"))
    index = pivots.build(points, pivots.choose_pivots(points, 6), 12, str(tmp_path / "index"))
    assert plain(pivots.pivot_join(index, queries, 5)) == plain(knn_join(points, queries, KnnSpec(5, strategy="sort")))
    for r in pivots.pivot_work(index, queries, 5).collect():
        assert r.points == 4040 and 5 <= r.measured <= r.in_rings < 2000 and r.measured < 200
    plan = pivots.pivot_join(index, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "point_id long, p array<double>")
    one = pivots.build(same, pivots.choose_pivots(same, 4))
    assert len(one.pivots) == 1 and [r.point_id for r in pivots.pivot_join(one, queries.limit(1), 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        pivots.build(points, [])


def test_radius(spark):
    points, queries = _random(spark, 1500, 6, 3)
    for k in (4, 200):  # 200: more than the first block has
        assert plain(knn_join(points, queries, KnnSpec(k, strategy="radius"))) == plain(knn_join(points, queries, KnnSpec(k, strategy="sort")))
    left = within_radius(points, queries, 4).count()
    assert 24 <= left < 0.2 * 1500 * 6
    odd = spark.createDataFrame([(i, [math.nan if i % 5 == 0 else float(i)]) for i in range(64)], "point_id long, p array<double>")
    asked = spark.createDataFrame([(0, [3.0])], "query_id long, q array<double>")
    for k in (3, 60):
        assert plain(knn_join(odd, asked, KnnSpec(k, strategy="radius"))) == plain(knn_join(odd, asked, KnnSpec(k, strategy="sort")))


@pytest.mark.parametrize("precision", ["half", "bfloat16", "float"])
@pytest.mark.parametrize("metric", ["l2", "l2_partial"])
def test_certified(spark, precision, metric):
    """Equal to full precision where quantised answers are not: crowded, very large, very small values."""
    rng = np.random.default_rng(5)
    for scale, offset in ((1.0, 0.0), (1e-9, 0.0), (1e6, 0.0), (1e-3, 100.0)):
        rows = rng.normal(size=(600, 9)) * scale + offset
        points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "point_id long, p array<double>")
        queries = points.where("point_id < 5").select(F.col("point_id").alias("query_id"), F.col("p").alias("q"))
        wanted = plain(knn_join(points, queries, KnnSpec(8, metric)))
        assert plain(knn_join(points, queries, KnnSpec(8, metric, precision=precision, certify=True))) == wanted


def test_certified_measures_few():
    rng = np.random.default_rng(1)
    points, queries = rng.normal(size=(20_000, 24)), rng.normal(size=(20, 24))
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(list(points[a:b]))], ["point_id", "p"])
    measured = []
    list(kernel.certified(np.arange(20), queries, 10, "l2", "half", measured=measured)([batch(a, a + 4000) for a in range(0, 20_000, 4000)]))
    assert 200 <= sum(measured) < 0.02 * 20_000 * 20


def test_running(spark, tmp_path):
    rows = [(random.Random(i).choice(["a", "b", None]), float(i * 37 % 101), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    parts = [df.where(F.pmod("id", F.lit(3)) == i) for i in range(3)]
    wanted = plain(top_k(df, ["g"], "v", ["id"], 6, largest=True))
    states = [to_state(p, ["g"], "v", ["id"], 6, True) for p in parts]
    assert plain(from_state(merge(states, ["g"], "v", ["id"], 6, True), ["g"], "v", ["id"])) == wanted
    kept = RunningTopK(spark, str(tmp_path / "kept"), ["g"], "v", ["id"], 6, largest=True)
    with pytest.raises(ValueError):
        kept.rows()
    kept.append(parts[0])
    kept.append(parts[1], 1)
    kept.append(parts[1], 1)  # again
    (tmp_path / "kept" / "v2").mkdir()  # an append that was lost
    kept.append(parts[2])
    assert kept.versions() == [0, 1, 2] and plain(kept.rows()) == wanted


def test_observed_while_written(spark, tmp_path):
    points, queries = _random(spark, 100, 3, 2)
    found = knn_join(points, queries, KnnSpec(5))
    seen = write_neighbors(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert seen == {"rows": 15, "checksum": sum(r.point_id for r in back.collect()) % 2**32} and plain(back) == plain(found)


def test_generated_rows_do_not_depend_on_partitions(spark):
    for name in ("uniform:-1,1", "normal"):
        points, queries = V.generate(spark, name, 200, 20, 4, seed=9)
        one = V.GENERATORS[name.partition(":")[0]](spark, 220, 4, name.partition(":")[2], 9).coalesce(1)
        assert plain(points.select("p").unionByName(queries.select(F.col("q").alias("p")))) == plain(one.select("p"))
        ids = spark.createDataFrame([(17,), (3,)], "id long").repartition(7)
        make = V.VECTORS[name.partition(":")[0]]
        again = ids.select("id", make(F.col("id"), 4, name.partition(":")[2], 9).alias("p"))
        assert plain(again.select("p")) == plain(points.where("point_id in (3, 17)").select("p"))
    other = V.uniform(spark, 200, 4, "-1,1", 10)
    assert not set(plain(other.select("p"))) & set(plain(V.uniform(spark, 200, 4, "-1,1", 9).select("p")))
    values = [x for r in V.uniform(spark, 4000, 2, "", 1).collect() for x in r.p]
    assert abs(np.mean(values) - 0.5) < 0.02 and abs(np.var(values) - 1 / 12) < 0.005 and len(set(values)) == 8000
    drawn = [x for r in V.normal(spark, 4000, 2, "1,2", 1).collect() for x in r.p]
    assert abs(np.mean(drawn) - 1) < 0.1 and abs(np.std(drawn) - 2) < 0.1


def test_stub_between(spark):
    points, queries = _random(spark, 50, 4, 1)
    rows = V.stub_between(points, queries, 8).collect()
    assert len(rows) == 200 and {r.dist * 32 for r in rows} == set(map(float, range(8)))
    assert distances(points, queries).count() == 200
