"""Registered queries over the driver's tables, each with its SQL twin.

Queries of the search are the vectors whose id is divisible by 100, against all
vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import metrics as M
from lodestar.functions import scalar
from lodestar.model import KnnSpec
from lodestar.operators.distance import candidates, distances
from lodestar.operators import pivots
from lodestar.operators.knn import FIRST, checksum, knn_join, radius_filter, within_radius, write_neighbors
from lodestar.operators.running import RunningTopK
from lodestar.operators.topk import top_k
from lodestar.operators.verify import mismatches
from lodestar.plans import algorithms, analytics
from lodestar.plans.runner import bench, feasible_rows
from lodestar.sources.benchlog import measured, read_log, write_log
from lodestar.sources.logsource import register
from lodestar.sources.vectors import PREPROCESSORS, as_points, as_queries, from_columnar, normal_vector, sort_with_position, stub_between, to_columnar, uniform_vector
from lodestar.storage import durable, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return as_points(rows, "vec_id", "embedding"), as_queries(rows.where("vec_id % 100 = 0"), "vec_id", "embedding")


# -- SQL pieces ---------------------------------------------------------------


def _fold(term: str) -> str:
    return f"list_sum(list_transform(range(1, len(p.v) + 1), lambda i: {term}))"


E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
METRIC_SQL = {
    "l2": _fold("(p.v[i] - q.v[i]) * (p.v[i] - q.v[i])"),
    "l2_partial": f"{_fold('p.v[i] * p.v[i]')} - 2.0 * {_fold('p.v[i] * q.v[i]')}",
    "dot": _fold("p.v[i] * q.v[i]"),
    "l1": _fold("abs(p.v[i] - q.v[i])"),
    "l3": _fold("abs(p.v[i] - q.v[i]) * abs(p.v[i] - q.v[i]) * abs(p.v[i] - q.v[i])"),
    "linf": "list_max(list_transform(range(1, len(p.v) + 1), lambda i: abs(p.v[i] - q.v[i])))",
}


def pairs_sql(metric: str = "l2") -> str:
    return f"WITH {E_SQL}, d AS (SELECT q.id AS query_id, p.id AS point_id, {METRIC_SQL[metric]} AS dist FROM e p CROSS JOIN e q WHERE q.id % 100 = 0)"


def knn_sql(metric: str = "l2", k: int = K, dist: str = "dist") -> str:
    return (
        f"{pairs_sql(metric)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM d) "
        f"SELECT query_id, rank::INTEGER AS rank, point_id, {dist} AS dist FROM r WHERE rank <= {k}"
    )


def _knn(spark: SparkSession, sf_dir: str, **spec) -> DataFrame:
    points, queries = vectors(spark, sf_dir)
    return knn_join(points, queries, KnnSpec(**{"k": K, **spec}))


# -- nearest neighbours -------------------------------------------------------


@query(knn_sql())
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="group_limit")


@query(knn_sql())
def knn_l2_sort(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="sort")


@query(knn_sql())
def knn_l2_heap(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="heap")


@query(knn_sql())
def knn_l2_radix(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="radix")


@query(knn_sql())
def knn_l2_radius(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="radius")


@query(
    f"{pairs_sql()}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM d WHERE point_id % {FIRST} = 0) "
    f"SELECT d.query_id, count(*) AS points, count(*) FILTER (f.dist IS NULL OR d.dist <= f.dist) AS measured FROM d LEFT JOIN f ON f.query_id = d.query_id AND f.rank = {K} GROUP BY d.query_id"
)
def radius_rows(spark, sf_dir):
    """How many rows of the product a first block's radius lets through."""
    points, queries = vectors(spark, sf_dir)
    left = within_radius(points, queries, K).groupBy("query_id").agg(F.count("*").alias("measured"))
    return left.crossJoin(F.broadcast(points.agg(F.count("*").alias("points"))))


PIVOTS, RINGS = 8, 6


def _pivot_index(spark, sf_dir):
    points, queries = vectors(spark, sf_dir)
    first = points.where(F.col("point_id") < PIVOTS).orderBy("point_id")
    return pivots.build(points, [r.p for r in first.collect()], RINGS), queries


@query(knn_sql())
def knn_pivot(spark, sf_dir):
    return pivots.pivot_join(*_pivot_index(spark, sf_dir), K)


def _pivot_work_sql() -> str:
    ids = range(PIVOTS)
    d = ", ".join(f"max(sqrt(dist)) FILTER (v = {i}) AS d{i}" for i in ids)
    near = f"least({', '.join(f'd{i}' for i in ids)})"
    pivot = "CASE " + " ".join(f"WHEN d{i} = near THEN {i}" for i in ids) + " END"
    ends = ", ".join(f"min(d{i}) AS lo{i}, max(d{i}) AS hi{i}" for i in ids)
    low = f"greatest({', '.join(f'lo{i} - d{i}, d{i} - hi{i}' for i in ids)}, 0.0::DOUBLE)"
    high = f"least({', '.join(f'hi{i} + d{i}' for i in ids)})"
    own = " AND ".join(f"abs(p.d{i} - o.d{i}) <= o.r" for i in ids)
    slack = f"(1 + {pivots.SLACK!r}::DOUBLE)"
    upto = "sum(n) OVER (PARTITION BY query_id ORDER BY {}, home, ring)"
    return f"""WITH {E_SQL}, vp AS (SELECT q.id AS v, p.id, {METRIC_SQL["l2"]} AS dist FROM e p CROSS JOIN e q WHERE q.id < {PIVOTS}),
t AS (SELECT *, {near} AS near FROM (SELECT id, {d} FROM vp GROUP BY id)), u AS (SELECT *, {pivot} AS home FROM t), w AS (SELECT home, max(near) AS width FROM u GROUP BY home),
p AS (SELECT u.*, CASE WHEN width > 0 THEN least(floor(near / width * {RINGS}), {RINGS - 1}) ELSE 0 END::INTEGER AS ring FROM u JOIN w USING (home)),
r AS (SELECT home, ring, count(*)::BIGINT AS n, {ends} FROM p GROUP BY ALL),
b AS (SELECT a.id AS query_id, {", ".join(f"a.d{i}" for i in ids)}, r.home, r.ring, n, {low} AS low, {high} AS high FROM t a CROSS JOIN r WHERE a.id % 100 = 0),
f AS (SELECT query_id, CASE WHEN max(upto) >= {K} THEN max(high) ELSE 'inf'::DOUBLE END AS r FROM (SELECT *, {upto.format("high")} AS upto FROM b) WHERE upto - n < {K} GROUP BY query_id),
c AS (SELECT b.*, f.r FROM b JOIN f USING (query_id) WHERE low <= f.r * {slack}),
h AS (SELECT * FROM (SELECT *, {upto.format("low")} AS upto FROM c) WHERE upto - n < {K}),
m AS (SELECT h.query_id, pt.id AS point_id, {METRIC_SQL["l2"].replace("p.v", "pv.v").replace("q.v", "qv.v")} AS dist FROM h JOIN p pt ON pt.home = h.home AND pt.ring = h.ring JOIN e pv ON pv.id = pt.id JOIN e qv ON qv.id = h.query_id),
k AS (SELECT query_id, sqrt(dist) AS own FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM m) WHERE rank = {K}),
o AS (SELECT * FROM (SELECT c.* EXCLUDE (r), least(c.r, coalesce(k.own, 'inf'::DOUBLE)) * {slack} AS r FROM c LEFT JOIN k USING (query_id)) WHERE low <= r)
SELECT query_id, (SELECT count(*) FROM e) AS points, any_value(s) AS in_rings, count(pid) AS measured FROM (SELECT o.query_id, o.home, o.ring, p.id AS pid FROM o LEFT JOIN p ON p.home = o.home AND p.ring = o.ring AND {own}) JOIN (SELECT query_id, sum(n)::BIGINT AS s FROM o GROUP BY 1) USING (query_id) GROUP BY query_id"""


@query(_pivot_work_sql())
def pivot_work(spark, sf_dir):
    """Of all points those in rings that a query reaches, and those whose distance is computed."""
    return pivots.pivot_work(*_pivot_index(spark, sf_dir), K)


@query(knn_sql(dist="round(dist, 6)"))
def knn_certified_half(spark, sf_dir):
    return _knn(spark, sf_dir, precision="half", certify=True).withColumn("dist", F.round("dist", 6))


@query(knn_sql(dist="round(dist, 6)"))
def knn_certified_bfloat16(spark, sf_dir):
    return _knn(spark, sf_dir, precision="bfloat16", certify=True).withColumn("dist", F.round("dist", 6))


@query(knn_sql())
def knn_l2_two_level(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="two_level", deg=7)


@query(knn_sql(dist="round(dist, 6)"))
def knn_l2_arrow(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="fused").withColumn("dist", F.round("dist", 6))


@query(knn_sql("l2_partial"))
def knn_l2_partial(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="group_limit", metric="l2_partial")


@query(knn_sql("l2_partial", dist="round(dist, 6)"))
def knn_l2_partial_arrow(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="fused", metric="l2_partial").withColumn("dist", F.round("dist", 6))


@query(knn_sql("l1"))
def knn_l1(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="group_limit", metric="l1")


@query(knn_sql(k=1))
def knn_k1(spark, sf_dir):
    return _knn(spark, sf_dir, k=1)


@query(knn_sql(k=100_000))
def knn_k_gt_n(spark, sf_dir):
    return _knn(spark, sf_dir, k=100_000, strategy="group_limit")


def rounded_sql(bits: int, least: int | None) -> str:
    """Neighbours of vectors whose values have ``bits`` bits behind the first, ties to even, no exponent below ``least``."""
    power = "floor(log2(abs(x)))" if least is None else f"greatest(floor(log2(abs(x))), {least})"
    unit = f"pow(2, {power} - {bits})"
    value = f"list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN x ELSE round_even(x / {unit}, 0) * {unit} END)"
    return knn_sql(dist="round(dist, 6)").replace("embedding::DOUBLE[] AS v", f"{value} AS v")


@query(rounded_sql(10, -14))
def knn_half(spark, sf_dir):
    return _knn(spark, sf_dir, precision="half").withColumn("dist", F.round("dist", 6))


@query(rounded_sql(7, None))
def knn_bfloat16(spark, sf_dir):
    return _knn(spark, sf_dir, precision="bfloat16").withColumn("dist", F.round("dist", 6))


def _distance_query(name: str) -> None:
    def run(spark, sf_dir):
        return distances(*vectors(spark, sf_dir), name)

    run.__name__ = f"dist_{name}"
    query(f"{pairs_sql(name)} SELECT * FROM d")(run)


for _name in ("l2", "l2_partial", "dot", "l1", "l3", "linf"):
    _distance_query(_name)


def _share(x):
    """Components as shares; the sum is passed on, for inside the transform it would be taken again for each of them."""
    return F.aggregate(F.transform(x, lambda w: w + 1), F.lit(0.0), lambda total, w: total + w, lambda total: F.transform(x, lambda v: (v + 1) / total))


@query(
    "WITH e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: (x + 1) / list_sum(list_transform(embedding::DOUBLE[], lambda y: y + 1))) AS v FROM embeddings) "
    f"SELECT q.id AS query_id, p.id AS point_id, round({_fold('p.v[i] * (ln(p.v[i]) - ln(q.v[i]))')}, 6) AS dist FROM e p CROSS JOIN e q WHERE q.id % 100 = 0"
)
def dist_kl(spark, sf_dir):
    points, queries = vectors(spark, sf_dir)
    found = distances(points.withColumn("p", _share(F.col("p"))), queries.withColumn("q", _share(F.col("q"))), "kl")
    return found.withColumn("dist", F.round("dist", 6))


@query(f"WITH {E_SQL} SELECT p.id AS point_id, {_fold('p.v[i] * p.v[i]')} AS norm FROM e p")
def sq_norm(spark, sf_dir):
    return vectors(spark, sf_dir)[0].select("point_id", M.squared_norm(F.col("p")).alias("norm"))


# -- selection, order, verification -------------------------------------------

LINES_SQL = "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice{}, l_orderkey, l_linenumber) AS rank FROM lineitem"


def _lines_sql(direction: str = "") -> str:
    return f"SELECT l_returnflag, rank::INTEGER AS rank, l_orderkey, l_linenumber, l_extendedprice FROM ({LINES_SQL.format(direction)}) WHERE rank <= {K}"


def _lines(spark, sf_dir, **given):
    return top_k(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], K, **given)


@query(_lines_sql())
def topk_per_group(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(_lines_sql(" DESC"))
def topk_per_group_largest(spark, sf_dir):
    return _lines(spark, sf_dir, largest=True)


@query(_lines_sql())
def topk_per_group_two_level(spark, sf_dir):
    return _lines(spark, sf_dir, strategy="two_level", deg=7)


@query(_lines_sql())
def topk_two_appends(spark, sf_dir):
    """Two halves that arrive one after the other, the second one again after a failure."""
    rows = table(spark, sf_dir, "lineitem")
    kept = RunningTopK(spark, new_path(spark, "running"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], K)
    for number, part in enumerate((0, 1, 1)):
        kept.append(rows.where(F.col("l_orderkey") % 2 == part), min(number, 1))
    return kept.rows().select("l_returnflag", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


SKEW_SQL = "CASE WHEN l_orderkey % 10 < 8 THEN -1 ELSE l_suppkey END"


@query(
    f"SELECT supplier, rank::INTEGER AS rank, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank "
    f"FROM (SELECT {SKEW_SQL} AS supplier, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)) WHERE rank <= 3"
)
def topk_skewed(spark, sf_dir):
    """One group with most rows and many small ones; their sizes decide what is cut."""
    supplier = F.when(F.col("l_orderkey") % 10 < 8, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("supplier", supplier)
    return top_k(rows, ["supplier"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 3, strategy="two_level", deg=0)


@query(
    "SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * 1024) AS x, CASE WHEN l_linenumber > 1 THEN l_linenumber::BIGINT ELSE 1 END AS y, CASE WHEN l_linenumber > 2 THEN l_suppkey * 1048576 ELSE 1 END AS z FROM lineitem"
)
def parse_dims(spark, sf_dir):
    """Up to three numbers with suffixes, written from the table and read again."""
    rows = table(spark, sf_dir, "lineitem")
    parts = [F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("k")), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")), F.when(F.col("l_linenumber") > 2, F.concat(F.col("l_suppkey").cast("string"), F.lit("M")))]
    found = rows.select("l_orderkey", "l_linenumber", scalar.dim3(F.concat_ws(",", *parts)).alias("d"))
    return found.select("l_orderkey", "l_linenumber", "d.*")


@query(
    "SELECT o_orderkey, n, q, k, n::HUGEINT * q <= 4294967296 AND k <= n AS feasible FROM (SELECT o_orderkey, o_orderkey * 1024 AS n, o_custkey * 16 AS q, (o_orderkey * o_custkey) % 4096 + 1 AS k FROM orders)"
)
def feasible_problems(spark, sf_dir):
    """Which problems a benchmark measures."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1024).alias("n"), (F.col("o_custkey") * 16).alias("q"), ((F.col("o_orderkey") * F.col("o_custkey")) % 4096 + 1).alias("k"))
    return rows.withColumn("feasible", feasible_rows(F.col("n"), F.col("q"), F.col("k")))


def _canberra(p, q):
    share = lambda a, b: F.when(F.abs(a) + F.abs(b) > 0, F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(0.0)
    return M.fold(F.zip_with(p, q, share))


def _canberra_terms(p, q, out):
    size = np.abs(p) + np.abs(q)
    np.abs(np.subtract(p, q, out=out), out=out)
    return np.divide(out, size, out=np.zeros_like(out), where=size != 0)


CANBERRA_SQL = _fold("CASE WHEN abs(p.v[i]) + abs(q.v[i]) > 0 THEN abs(p.v[i] - q.v[i]) / (abs(p.v[i]) + abs(q.v[i])) ELSE 0.0 END")


@query(knn_sql().replace(METRIC_SQL["l2"], CANBERRA_SQL))
def knn_own_metric(spark, sf_dir):
    """A metric that the user registers."""
    with M.registered("canberra", _canberra, M.Arrays(M.terms(_canberra_terms))):
        return _knn(spark, sf_dir, strategy="group_limit", metric="canberra")


@query(
    f"{pairs_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist DESC, point_id) AS rank FROM d) "
    f"SELECT query_id, rank::INTEGER AS rank, point_id, dist FROM r WHERE rank <= {K}"
)
def knn_own_algorithm(spark, sf_dir):
    """A plan that the user registers: the farthest points."""
    farthest = lambda points, queries, k: top_k(candidates(points, queries, k, largest=True), ["query_id"], "dist", ["point_id"], k, largest=True)
    with algorithms.registered("farthest", farthest):
        return algorithms.run("farthest", *vectors(spark, sf_dir), K)


@query(
    "SELECT a.algorithm, p.phase, i.range::INTEGER AS iteration, n.points AS point_count, n.queries AS query_count, 64::INTEGER AS dim, 10::INTEGER AS k, true AS measured "
    "FROM (VALUES ('bits-sq'), ('fused-cache')) a(algorithm), (VALUES ('prepare'), ('transfer-in'), ('distances'), ('selection'), ('postprocessing'), ('finish'), ('transfer-out')) p(phase), range(2) i, "
    "(SELECT count(*) AS points, count(*) FILTER (vec_id % 100 = 0) AS queries FROM embeddings) n"
)
def phase_log(spark, sf_dir):
    """The log of two algorithms over the table's vectors; of times only that they were taken where a phase has work."""
    log = None
    for name in ("bits-sq", "fused-cache"):
        one = bench(spark, name, *vectors(spark, sf_dir), K, repeats=2)
        log = one if log is None else log.unionByName(one)
    works = F.col("phase").isin("selection") | ((F.col("phase") == "distances") & (F.col("algorithm") == "bits-sq"))
    return log.select("algorithm", "phase", "iteration", "point_count", "query_count", "dim", "k", F.when(works, F.col("time") > 0).otherwise(F.col("time") == 0).alias("measured"))


TIES_SQL = "SELECT l_linestatus, l_orderkey, l_linenumber, CASE WHEN l_quantity < 50 THEN floor(l_quantity / 10) * 10 - 20 END AS amount FROM lineitem"


def _ties(spark, sf_dir, **given):
    """Groups with few different values, some of them null."""
    amount = F.when(F.col("l_quantity") < 50, F.floor(F.col("l_quantity") / 10) * 10.0 - 20.0).alias("amount")
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", amount)
    return top_k(rows, ["l_linestatus"], "amount", ["l_orderkey", "l_linenumber"], **given)


@query(f"SELECT l_linestatus, rank::INTEGER AS rank, l_orderkey, l_linenumber, amount::DOUBLE AS amount FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY amount DESC NULLS LAST, l_orderkey, l_linenumber) AS rank FROM ({TIES_SQL})) WHERE rank <= 50")
def topk_radix_ties(spark, sf_dir):
    return _ties(spark, sf_dir, k=50, largest=True, strategy="radix")


@query(_lines_sql())
def topk_radix(spark, sf_dir):
    return _lines(spark, sf_dir, strategy="radix")


@query(
    "SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber)::INTEGER AS rank, l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
    f"ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT {K}"
)
def topk_global(spark, sf_dir):
    return top_k(table(spark, sf_dir, "lineitem"), [], "l_extendedprice", ["l_orderkey", "l_linenumber"], K)


@query(
    "SELECT label, rank::INTEGER AS rank, vec_id, dist FROM (SELECT label, vec_id, floor(vec_id / 7) / 32 AS dist, "
    f"row_number() OVER (PARTITION BY label ORDER BY floor(vec_id / 7) / 32, vec_id) AS rank FROM embeddings) WHERE rank <= {K}"
)
def topk_ties(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.floor(F.col("vec_id") / 7) / 32.0).alias("dist"))
    return top_k(rows, ["label"], "dist", ["vec_id"], K)


def _order_sql(direction: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice {direction}, l_orderkey, l_linenumber) - 1 AS position FROM lineitem"


def _ordered(spark, sf_dir, value):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sort_with_position(rows, [value, F.col("l_orderkey"), F.col("l_linenumber")], "position").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("position").cast("long").alias("position"))


@query(_order_sql("ASC"))
def sort_asc(spark, sf_dir):
    return _ordered(spark, sf_dir, F.asc("l_extendedprice"))


@query(_order_sql("DESC"))
def sort_desc(spark, sf_dir):
    return _ordered(spark, sf_dir, F.desc("l_extendedprice"))


@query("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, 0::BIGINT AS mismatches FROM embeddings")
def verify_strategies(spark, sf_dir):
    points, queries = vectors(spark, sf_dir)
    wrong = mismatches(algorithms.run("serial", points, queries, K), algorithms.run("fused-regs", points, queries, K))
    return queries.agg(F.count("*").alias("queries")).crossJoin(wrong.agg(F.count("*").alias("mismatches")))


@query(f"SELECT query_id, (sum(point_id) % 4294967296)::BIGINT AS checksum FROM ({knn_sql()}) GROUP BY query_id")
def checksum_per_query(spark, sf_dir):
    return checksum(_knn(spark, sf_dir))


@query(f"SELECT count(*) AS rows, (sum(point_id) % 4294967296)::BIGINT AS checksum FROM ({knn_sql()})")
def checksum_observed(spark, sf_dir):
    """Counted while the neighbours are written."""
    seen = write_neighbors(_knn(spark, sf_dir), new_path(spark, "neighbors"))
    return spark.createDataFrame([(seen["rows"], seen["checksum"])], "rows bigint, checksum bigint")


@query(
    f"{pairs_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM d) "
    f"SELECT d.query_id, d.point_id, d.dist FROM d JOIN r ON r.query_id = d.query_id AND r.rank = {K} WHERE d.dist < r.dist"
)
def radius(spark, sf_dir):
    # What is closer than the k-th is among the candidates; they are read twice.
    return radius_filter(durable(candidates(*vectors(spark, sf_dir), K), "product"), K)


@query(f"WITH {E_SQL} SELECT id AS point_id, v AS p FROM e")
def columnar_round_trip(spark, sf_dir):
    points, _ = vectors(spark, sf_dir)
    return from_columnar(to_columnar(points, "point_id", "p"), "point_id", "p")


def _drawn_sql(seed: int, at: str, first: int) -> str:
    """A number from [0, 1) by the hash of (seed, id, dimension)."""
    return f"(('0x' || substring(md5(concat({seed}, ':', {at}, ':', i)), {first}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"SELECT vec_id AS point_id, list_transform(range(0, 8), lambda i: -1.0::DOUBLE + {_drawn_sql(1, 'vec_id', 1)} * 2.0) AS p FROM embeddings")
def generate_uniform(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"))
    return ids.withColumn("p", uniform_vector(F.col("point_id"), 8, "-1,1", 1))


@query(
    f"SELECT vec_id AS query_id, list_transform(range(0, 6), lambda i: round(0.5 + 2.0 * sqrt(-2 * ln(1 - {_drawn_sql(7, '(vec_id + 1000)', 1)})) * cos(2 * pi() * {_drawn_sql(7, '(vec_id + 1000)', 14)}), 6)) AS q FROM embeddings"
)
def generate_normal(spark, sf_dir):
    """Queries go on where a thousand points have ended."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    drawn = normal_vector(F.col("query_id") + 1000, 6, "0.5,2", 7)
    return ids.withColumn("q", F.transform(drawn, lambda x: F.round(x, 6)))


def _stub_sql(unique: int) -> str:
    return f"SELECT q.vec_id AS query_id, p.vec_id AS point_id, ((p.vec_id * 7919 + q.vec_id * 104729) % {unique}) / 32.0::DOUBLE AS dist FROM embeddings p CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0"


def _stub(spark, sf_dir, unique: int) -> DataFrame:
    points, queries = vectors(spark, sf_dir)
    return stub_between(points, queries, unique)


@query(f"SELECT query_id, rank::INTEGER AS rank, point_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM ({_stub_sql(7)})) WHERE rank <= 32")
def stub_ties(spark, sf_dir):
    return top_k(_stub(spark, sf_dir, 7), ["query_id"], "dist", ["point_id"], 32)


@query(f"SELECT query_id, count(*) AS points, count(DISTINCT dist) AS different, max(dist) AS farthest FROM ({_stub_sql(128)}) GROUP BY query_id")
def stub_dist(spark, sf_dir):
    return _stub(spark, sf_dir, 128).groupBy("query_id").agg(F.count("*").alias("points"), F.count_distinct("dist").alias("different"), F.max("dist").alias("farthest"))


def _order_points_sql(direction: str) -> str:
    return (
        f"WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS v FROM embeddings) SELECT 'point' AS side, row_number() OVER (ORDER BY v {direction}, vec_id) - 1 AS id, v AS value FROM e "
        "UNION ALL SELECT 'query', vec_id, 0.0 FROM e WHERE vec_id % 100 = 0"
    )


def _order_points(spark, sf_dir, name: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 1).alias("v"))
    points, queries = PREPROCESSORS[name](as_points(rows, "vec_id", "v"), as_queries(rows.where("vec_id % 100 = 0"), "vec_id", "v"))
    first = points.select(F.lit("point").alias("side"), F.col("point_id").cast("long").alias("id"), F.element_at("p", 1).alias("value"))
    return first.unionByName(queries.select(F.lit("query").alias("side"), F.col("query_id").alias("id"), F.element_at("q", 1).alias("value")))


@query(_order_points_sql("ASC"))
def preprocess_ascending(spark, sf_dir):
    return _order_points(spark, sf_dir, "ascending")


@query(_order_points_sql("DESC"))
def preprocess_descending(spark, sf_dir):
    return _order_points(spark, sf_dir, "descending")


@query(f"WITH {E_SQL} SELECT id AS point_id, v AS p FROM e")
def preprocess_identity(spark, sf_dir):
    return PREPROCESSORS["identity"](*vectors(spark, sf_dir))[0]


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 9)::VARCHAR || CASE WHEN l_suppkey % 3 = 0 THEN '' WHEN l_suppkey % 3 = 1 THEN ',' || (l_suppkey % 7)::VARCHAR ELSE ',2,3' END AS items, "
    "(l_partkey % 50)::VARCHAR || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'M' ELSE 'g' END AS size FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, coalesce(nullif(split_part(items, ',', 1), ''), '1')::INTEGER AS item1, coalesce(nullif(split_part(items, ',', 2), ''), '1')::INTEGER AS item2, coalesce(nullif(split_part(items, ',', 3), ''), '1')::INTEGER AS item3, "
    "regexp_extract(size, '[0-9]+')::BIGINT * CASE lower(right(size, 1)) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END AS number FROM t"
)
def parse_items(spark, sf_dir):
    items = F.concat(
        (F.col("l_partkey") % 9).cast("string"),
        F.when(F.col("l_suppkey") % 3 == 0, "").when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit(","), (F.col("l_suppkey") % 7).cast("string"))).otherwise(",2,3"),
    )
    suffix = F.when(F.col("l_linenumber") % 4 == 0, "").when(F.col("l_linenumber") % 4 == 1, "k").when(F.col("l_linenumber") % 4 == 2, "M").otherwise("g")
    size = F.concat((F.col("l_partkey") % 50).cast("string"), suffix)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *[scalar.item(items, n).alias(f"item{n + 1}") for n in range(3)], scalar.number(size).alias("number"))


# -- benchmark log ------------------------------------------------------------

LOG_SQL = """SELECT l_returnflag AS hostname, l_linestatus AS algorithm, 1024 * (1 + l_partkey % 3) AS point_count, 64 * (1 + l_suppkey % 2) AS query_count,
32 AS k, 1 AS dim, 128 * (1 + l_linenumber % 3) AS block_size, 1 + l_orderkey % 4 AS items_per_thread, l_orderkey % 20 AS iteration, l_extendedprice / 1000000.0 AS time FROM lineitem"""
KEYS = ", ".join(analytics.PARAMETERS)
TUNED = ", ".join(analytics.TUNABLES)
CATEGORY_SQL = "CASE WHEN algorithm = 'F' AND query_count = 64 THEN 'q == 64' WHEN algorithm = 'F' AND query_count >= 128 THEN 'q >= 128' ELSE 'other' END"
MEAN_SQL = f"log AS ({LOG_SQL}), mean AS (SELECT {KEYS}, {TUNED}, avg(time) AS time FROM log WHERE iteration >= 10 GROUP BY ALL)"
BEST_SQL = f"best AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY time, {TUNED}) AS r FROM mean) WHERE r = 1)"
SLOW_SQL = f"slow AS (SELECT mean.*, mean.time / best.time AS slowdown, {CATEGORY_SQL.replace('algorithm', 'mean.algorithm').replace('query_count', 'mean.query_count')} AS category FROM mean JOIN best USING ({KEYS}))"


def proxy_log(spark, sf_dir) -> DataFrame:
    """A benchmark log derived from lineitem: the same text in both engines."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_returnflag").alias("hostname"),
        F.col("l_linestatus").alias("algorithm"),
        (1024 * (1 + F.col("l_partkey") % 3)).alias("point_count"),
        (64 * (1 + F.col("l_suppkey") % 2)).alias("query_count"),
        F.lit(32).alias("k"),
        F.lit(1).alias("dim"),
        (128 * (1 + F.col("l_linenumber") % 3)).alias("block_size"),
        (1 + F.col("l_orderkey") % 4).alias("items_per_thread"),
        (F.col("l_orderkey") % 20).alias("iteration"),
        (F.col("l_extendedprice") / 1000000.0).alias("time"),
    )


def _means(spark, sf_dir):
    return analytics.mean_time(proxy_log(spark, sf_dir).where("iteration >= 10"))


def _category():
    own = F.col("algorithm") == "F"
    return scalar.category([(own & (F.col("query_count") == 64), "q == 64"), (own & (F.col("query_count") >= 128), "q >= 128")])


def _slow(spark, sf_dir):
    means = _means(spark, sf_dir)
    return analytics.slowdown(means, analytics.optima(means)).withColumn("category", _category())


@query(f"WITH {MEAN_SQL} SELECT * REPLACE (round(time, 6) AS time) FROM mean")
def bench_mean(spark, sf_dir):
    return _means(spark, sf_dir).withColumn("time", F.round("time", 6))


@query(f"WITH {MEAN_SQL}, {BEST_SQL} SELECT * REPLACE (round(time, 6) AS time) FROM best")
def bench_optima(spark, sf_dir):
    return analytics.optima(_means(spark, sf_dir)).withColumn("time", F.round("time", 6))


@query(f"WITH {MEAN_SQL}, {BEST_SQL}, {SLOW_SQL} SELECT {KEYS}, {TUNED}, category, round(slowdown, 6) AS slowdown FROM slow")
def bench_slowdown(spark, sf_dir):
    return _slow(spark, sf_dir).select(*analytics.PARAMETERS, *analytics.TUNABLES, "category", F.round("slowdown", 6).alias("slowdown"))


@query(
    f"WITH {MEAN_SQL}, {BEST_SQL}, {SLOW_SQL}, gross AS (SELECT hostname, algorithm, category, {TUNED}, min(slowdown) AS min_slowdown, max(slowdown) AS max_slowdown, count(*) AS total_count FROM slow GROUP BY ALL), "
    "covering AS (SELECT *, max(total_count) OVER (PARTITION BY hostname, algorithm, category) AS most FROM gross), "
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY hostname, algorithm, category ORDER BY max_slowdown, {TUNED}) AS r FROM covering WHERE total_count = most) "
    f"SELECT hostname, algorithm, category, {TUNED}, round(min_slowdown, 6) AS min_slowdown, round(max_slowdown, 6) AS max_slowdown, total_count FROM ranked WHERE r = 1"
)
def bench_fixed_optima(spark, sf_dir):
    found = analytics.fixed_optima(_slow(spark, sf_dir), ["hostname", "algorithm", "category"])
    return found.withColumns({c: F.round(c, 6) for c in ("min_slowdown", "max_slowdown")})


@query(f"WITH {MEAN_SQL}, {BEST_SQL}, {SLOW_SQL} SELECT algorithm, category, CASE algorithm WHEN 'F' THEN 'proposed' WHEN 'O' THEN 'baseline' ELSE algorithm END AS label, count(*) AS n FROM slow GROUP BY ALL")
def bench_category(spark, sf_dir):
    slow = _slow(spark, sf_dir).withColumn("label", scalar.relabel(F.col("algorithm"), {"F": "proposed", "O": "baseline"}))
    return slow.groupBy("algorithm", "category", "label").agg(F.count("*").alias("n"))


@query(
    f"WITH log AS ({LOG_SQL}) SELECT hostname, algorithm, round(count(time) / sum(1 / time), 6) AS harmonic_mean, "
    "round(sqrt(var_pop(1 / time) / pow(avg(1 / time), 4) / count(time)), 6) AS harmonic_std FROM log WHERE iteration >= 10 GROUP BY ALL"
)
def bench_harmonic(spark, sf_dir):
    time = F.col("time")
    return (
        proxy_log(spark, sf_dir)
        .where("iteration >= 10")
        .groupBy("hostname", "algorithm")
        .agg(F.round(analytics.harmonic_mean(time), 6).alias("harmonic_mean"), F.round(analytics.harmonic_std(time), 6).alias("harmonic_std"))
    )


@query(f"WITH log AS ({LOG_SQL}), t AS (SELECT {KEYS}, iteration, sum(time) AS time FROM log GROUP BY ALL) SELECT {KEYS}, iteration, round(time, 6) AS time FROM t")
def bench_phase_sum(spark, sf_dir):
    return analytics.phase_sum(proxy_log(spark, sf_dir), analytics.PARAMETERS).withColumn("time", F.round("time", 6))


@query(
    f"WITH {MEAN_SQL}, {BEST_SQL}, base AS (SELECT hostname, point_count, query_count, k, min(time) AS base FROM best WHERE algorithm = 'O' GROUP BY ALL) "
    f"SELECT {KEYS}, {TUNED}, round(time, 6) AS time, round(base / time, 6) AS speedup FROM best LEFT JOIN base USING (hostname, point_count, query_count, k)"
)
def bench_speedup(spark, sf_dir):
    best = analytics.optima(_means(spark, sf_dir))
    found = analytics.baseline_speedup(best, F.col("algorithm") == "O", ["hostname", "point_count", "query_count", "k"])
    return found.select(*analytics.PARAMETERS, *analytics.TUNABLES, F.round("time", 6).alias("time"), F.round("speedup", 6).alias("speedup"))


BOUND = 1e7
SPEED_SQL = (
    "speed AS (SELECT hostname, dim, k, query_count, point_count, max(point_count::DOUBLE * query_count / time) FILTER (algorithm <> 'F') AS sota, "
    "max(point_count::DOUBLE * query_count / time) FILTER (algorithm = 'F') AS proposed FROM best GROUP BY ALL), "
    "s AS (SELECT *, proposed / sota AS speedup FROM speed WHERE proposed IS NOT NULL AND sota IS NOT NULL)"
)


@query(
    f"WITH {MEAN_SQL}, {BEST_SQL}, {SPEED_SQL} SELECT hostname, dim, query_count, point_count, round(max(speedup), 6) AS max_speedup, round(min(speedup), 6) AS min_speedup, round(avg(speedup), 6) AS avg_speedup, count(*) AS n "
    "FROM s GROUP BY GROUPING SETS ((hostname, dim, query_count, point_count), (hostname, dim))"
)
def bench_stats(spark, sf_dir):
    best = analytics.optima(_means(spark, sf_dir))
    speed = analytics.speedups(best, "F", ["hostname", "dim", "k", "query_count", "point_count"])
    keys = ["hostname", "dim", "query_count", "point_count"]
    return speed.groupingSets([keys, keys[:2]], *keys).agg(
        F.round(F.max("speedup"), 6).alias("max_speedup"), F.round(F.min("speedup"), 6).alias("min_speedup"), F.round(F.avg("speedup"), 6).alias("avg_speedup"), F.count("*").alias("n")
    )


def _situations_sql() -> str:
    parts = []
    for group, prefix in (("hostname, dim, query_count, point_count", ""), ("hostname, dim", "global_")):
        here = "query_count, point_count" if not prefix else "0::BIGINT AS query_count, 0::BIGINT AS point_count"
        order = "k, query_count, point_count"
        for situation, by in (("max_speedup", "speedup DESC"), ("min_speedup", "speedup")):
            parts.append(
                f"SELECT hostname, dim, '{prefix}{situation}' AS situation, k::BIGINT AS k, query_count, point_count, sota, proposed, speedup FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {by}, {order}) AS r FROM s) WHERE r = 1"
            )
        for situation, by in (("max_relative_throughput", "proposed DESC"), ("min_relative_throughput", "proposed")):
            parts.append(
                f"SELECT hostname, dim, '{prefix}{situation}', k::BIGINT, query_count, point_count, {BOUND:.1f}, proposed, proposed / {BOUND:.1f} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {by}, {order}) AS r FROM s) WHERE r = 1"
            )
        parts.append(f"SELECT hostname, dim, '{prefix}avg_speedup', 0, {here}, 0.0, 0.0, avg(speedup) FROM s GROUP BY {group}")
        parts.append(f"SELECT hostname, dim, '{prefix}avg_relative_throughput', 0, {here}, {BOUND:.1f}, avg(proposed / {BOUND:.1f}) * {BOUND:.1f}, avg(proposed / {BOUND:.1f}) FROM s GROUP BY {group}")
    return " UNION ALL ".join(parts)


@query(
    f"WITH {MEAN_SQL}, {BEST_SQL}, {SPEED_SQL}, t AS ({_situations_sql()}) "
    "SELECT hostname, dim, situation, k, query_count, point_count, round(sota, 3) AS sota, round(proposed, 3) AS proposed, round(speedup, 6) AS speedup FROM t"
)
def bench_situations(spark, sf_dir):
    best = analytics.optima(_means(spark, sf_dir))
    speed = analytics.speedups(best, "F", ["hostname", "dim", "k", "query_count", "point_count"])
    found = analytics.statistics(speed, ["hostname", "dim"], ["query_count", "point_count"], F.lit(BOUND))
    return found.withColumns({"sota": F.round("sota", 3), "proposed": F.round("proposed", 3), "speedup": F.round("speedup", 6)})


@query(
    f"WITH {MEAN_SQL}, {BEST_SQL}, b AS (SELECT DISTINCT hostname, 'bound' AS algorithm, point_count, query_count, k, dim, ((point_count + query_count)::DOUBLE * dim + point_count::DOUBLE * query_count) / {BOUND:.1f} AS time FROM best) "
    "SELECT hostname, algorithm, point_count, query_count, k, dim, round(time, 6) AS time, round(point_count::DOUBLE * query_count / time, 3) AS throughput FROM (SELECT hostname, algorithm, point_count, query_count, k, dim, time FROM best UNION ALL SELECT * FROM b)"
)
def bench_roofline(spark, sf_dir):
    rows = analytics.with_bound(analytics.optima(_means(spark, sf_dir)), "bound", F.lit(BOUND))
    rate = scalar.throughput(F.col("point_count"), F.col("query_count"), F.col("time"))
    return rows.select(*analytics.PARAMETERS, F.round("time", 6).alias("time"), F.round(rate, 3).alias("throughput"))


CSV_SQL = """SELECT l_linestatus AS algorithm, 'uniform' AS generator, 'identity' AS preprocessor, (l_orderkey % 20)::INTEGER AS iteration, 1024 * (1 + l_partkey % 3) AS point_count, 64::BIGINT AS query_count,
1::INTEGER AS dim, 128::INTEGER AS block_size, 32::BIGINT AS k, l_linenumber AS a, l_orderkey % 4 AS b, 1::INTEGER AS deg, 'selection' AS phase, l_quantity / 64.0::DOUBLE AS time FROM lineitem"""


def scanned_log(spark, sf_dir, source: bool = False) -> DataFrame:
    """A log written as CSV under a name that tells host and job, and scanned again."""
    rows = table(spark, sf_dir, "lineitem")
    log = rows.select(
        F.col("l_linestatus").alias("algorithm"), F.lit("uniform").alias("generator"), F.lit("identity").alias("preprocessor"), (F.col("l_orderkey") % 20).cast("int").alias("iteration"),
        (1024 * (1 + F.col("l_partkey") % 3)).cast("long").alias("point_count"), F.lit(64).cast("long").alias("query_count"), F.lit(1).alias("dim"), F.lit(128).alias("block_size"), F.lit(32).cast("long").alias("k"),
        F.concat_ws(",", F.col("l_linenumber").cast("string"), (F.col("l_orderkey") % 4).cast("string")).alias("items_per_thread"), F.lit(1).alias("deg"), F.lit("selection").alias("phase"), (F.col("l_quantity") / 64.0).alias("time"),
    )
    path = f"{new_path(spark, 'log')}/bench-ampere02-108416.csv"
    if source:
        register(spark)
        log.withColumns({"k": F.col("k").cast("int"), "point_count": F.col("point_count").cast("long")}).write.format("benchlog").mode("append").save(path)
        return spark.read.format("benchlog").option("hostname", "ampere02").load(path)
    write_log(log, path)
    return read_log(spark, path)


@query(
    f"WITH t AS ({CSV_SQL}) SELECT algorithm, iteration, point_count, 'ampere02' AS hostname, 108416::BIGINT AS jobid, 'A100' AS \"GPU\", a::INTEGER AS items_per_thread, b::INTEGER AS items_per_thread2, "
    "1::INTEGER AS items_per_thread3, count(*) AS n, round(sum(time), 6) AS time FROM t WHERE iteration >= 10 AND phase IN ('selection', 'distances') GROUP BY ALL"
)
def csv_scan(spark, sf_dir):
    rows = measured(scanned_log(spark, sf_dir), "selection", "distances")
    keys = ["algorithm", "iteration", "point_count", "hostname", "jobid", "GPU", "items_per_thread", "items_per_thread2", "items_per_thread3"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("time"), 6).alias("time"))


@query(
    f"WITH t AS ({CSV_SQL}) SELECT algorithm, iteration, 'ampere02' AS hostname, 108416::BIGINT AS jobid, concat(a, ',', b) AS items, count(*) AS n, round(sum(time), 6) AS time "
    "FROM t WHERE phase = 'selection' GROUP BY ALL"
)
def csv_source(spark, sf_dir):
    """The log written and read by the data source of its own."""
    rows = scanned_log(spark, sf_dir, source=True)
    keys = ["algorithm", "iteration", "hostname", "jobid", F.col("items_per_thread").alias("items")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("time"), 6).alias("time"))


HOLES_SQL = f"holes AS (SELECT * REPLACE (CASE WHEN block_size = 384 THEN NULL ELSE block_size END AS block_size, CASE WHEN point_count = 2048 AND items_per_thread = 1 THEN NULL ELSE k END AS k) FROM ({LOG_SQL}))"


def _holes(spark, sf_dir):
    hole = (F.col("point_count") == 2048) & (F.col("items_per_thread") == 1)
    return proxy_log(spark, sf_dir).withColumns({"block_size": F.when(F.col("block_size") != 384, F.col("block_size")), "k": F.when(~hole, F.col("k"))})


@query(f"WITH {HOLES_SQL} SELECT {KEYS}, {TUNED}, round(avg(time), 6) AS time FROM holes WHERE block_size IS NOT NULL AND k IS NOT NULL GROUP BY ALL")
def bench_mean_no_null_keys(spark, sf_dir):
    return analytics.mean_time(_holes(spark, sf_dir), drop_null_keys=True).withColumn("time", F.round("time", 6))


@query(f"WITH {HOLES_SQL} SELECT {KEYS}, {TUNED}, round(avg(time), 6) AS time FROM holes GROUP BY ALL")
def bench_mean_null_keys(spark, sf_dir):
    return analytics.mean_time(_holes(spark, sf_dir)).withColumn("time", F.round("time", 6))


@query(f"WITH {MEAN_SQL} SELECT {KEYS}, {TUNED}, round(time, 6) AS time FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, block_size ORDER BY time, items_per_thread) AS r FROM mean) WHERE r = 1")
def bench_first_best(spark, sf_dir):
    found = analytics.first_best(_means(spark, sf_dir), [*analytics.PARAMETERS, "block_size"], "items_per_thread")
    return found.withColumn("time", F.round("time", 6))


@query(
    "WITH t AS (SELECT CASE l_linenumber % 6 WHEN 0 THEN 'volta05' WHEN 1 THEN 'ampere01' WHEN 2 THEN 'ampere02' WHEN 3 THEN 'hopper01' WHEN 4 THEN 'laptop' END AS host, 1024 * (1 + l_partkey % 5) AS points, "
    "CASE WHEN l_returnflag = 'A' THEN l_returnflag ELSE 'x' END AS flag FROM lineitem) SELECT host, points, flag, (CASE WHEN starts_with(host, 'volta') THEN 900 WHEN starts_with(host, 'ampere01') THEN 864 WHEN starts_with(host, 'ampere02') THEN 1935 WHEN starts_with(host, 'hopper') THEN 2039 ELSE 0 END "
    "* 268435456.0)::DOUBLE AS floats, round(log2(points))::INTEGER AS label, count(*) AS n FROM t WHERE flag IN ('A', 'x') AND (host IS NULL OR host NOT IN ('laptop')) GROUP BY ALL"
)
def host_rates(spark, sf_dir):
    names = ["volta05", "ampere01", "ampere02", "hopper01", "laptop"]
    host = F.get(F.array(*map(F.lit, names)), (F.col("l_linenumber") % 6).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(host.alias("host"), (1024 * (1 + F.col("l_partkey") % 5)).alias("points"), F.when(F.col("l_returnflag") == "A", "A").otherwise("x").alias("flag"))
    kept = rows.where(F.col("flag").isin("A", "x") & (F.col("host").isNull() | ~F.col("host").isin("laptop")))
    return kept.groupBy("host", "points", "flag").agg(F.count("*").alias("n")).select("*", scalar.floats_per_second(F.col("host")).alias("floats"), scalar.log2_label(F.col("points")).alias("label"))


@query(f"WITH log AS ({LOG_SQL}) SELECT count(DISTINCT (hostname, algorithm))::BIGINT AS datasets, count(DISTINCT point_count)::BIGINT AS point_counts, max(time) AS slowest, min(time) AS fastest FROM log")
def bench_datasets(spark, sf_dir):
    return proxy_log(spark, sf_dir).agg(
        F.countDistinct("hostname", "algorithm").alias("datasets"), F.countDistinct("point_count").alias("point_counts"), F.max("time").alias("slowest"), F.min("time").alias("fastest")
    )


@query(
    f"WITH RECURSIVE {MEAN_SQL}, {BEST_SQL}, rows AS (SELECT row_number() OVER (ORDER BY {KEYS}) AS n, block_size, items_per_thread, (query_count >= 100)::INTEGER + (k >= 32)::INTEGER + (dim >= 1)::INTEGER AS score, "
    "(CASE WHEN query_count >= 100 THEN query_count / 100.0::DOUBLE ELSE 100.0::DOUBLE / query_count END) * (CASE WHEN k >= 32 THEN k / 32.0::DOUBLE ELSE 32.0::DOUBLE / k END) * (CASE WHEN dim >= 1 THEN dim / 1.0::DOUBLE ELSE 1.0::DOUBLE / dim END) AS slack "
    "FROM best WHERE algorithm = 'F'), fold AS (SELECT 0::BIGINT AS n, 0 AS score, 0.0::DOUBLE AS slack, 256::BIGINT AS block_size, 1::BIGINT AS items UNION ALL "
    "SELECT r.n, CASE WHEN r.score >= f.score AND (f.slack = 0 OR r.slack < f.slack) THEN r.score ELSE f.score END, CASE WHEN r.score >= f.score AND (f.slack = 0 OR r.slack < f.slack) THEN r.slack ELSE f.slack END, "
    "CASE WHEN r.score >= f.score AND (f.slack = 0 OR r.slack < f.slack) THEN r.block_size ELSE f.block_size END, CASE WHEN r.score >= f.score AND (f.slack = 0 OR r.slack < f.slack) THEN r.items_per_thread ELSE f.items END "
    "FROM fold f JOIN rows r ON r.n = f.n + 1) SELECT block_size::INTEGER AS block_size, items::INTEGER AS items_per_thread, 1 AS deg, 1 AS items_per_thread2, 1 AS items_per_thread3 FROM fold ORDER BY n DESC LIMIT 1"
)
def config_lookup(spark, sf_dir):
    best = analytics.optima(_means(spark, sf_dir))
    best = best.withColumn("line", F.struct(*analytics.PARAMETERS))
    return analytics.lookup_config(best, "F", "line", query_count=100, k=32, dim=1)
