"""Analytics of the benchmark log: optima, slow-downs, speed-ups, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import roofline_seconds

PARAMETERS = ["hostname", "algorithm", "point_count", "query_count", "k", "dim"]
TUNABLES = ["block_size", "items_per_thread"]


def mean_time(log: DataFrame, parameters: list[str] = PARAMETERS, tunables: list[str] = TUNABLES, drop_null_keys: bool = False) -> DataFrame:
    """Mean time of each configuration; rows with null keys form groups unless dropped."""
    if drop_null_keys:
        log = log.dropna(subset=[*parameters, *tunables])
    return log.groupBy(*parameters, *tunables).agg(F.avg("time").alias("time"))


def single_dataset(log: DataFrame, columns: tuple[str, ...] = ("generator", "preprocessor")) -> str:
    """The one dataset of a log, as ``generator-preprocessor``; an error if there are others."""
    rows = log.select(*columns).distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the log must hold exactly one dataset")
    return "-".join(str(x) for x in rows[0])


def first_best(means: DataFrame, groups: list[str], order: str) -> DataFrame:
    """The fastest row of each group; of equal ones the first by ``order``."""
    window = Window.partitionBy(*groups).orderBy("time", order)
    return means.withColumn("_ls_rank", F.row_number().over(window)).where("_ls_rank = 1").drop("_ls_rank")


def phase_sum(log: DataFrame, keys: list[str]) -> DataFrame:
    """Total time over the phases of each iteration."""
    return log.groupBy(*keys, "iteration").agg(F.sum("time").alias("time"))


def optima(means: DataFrame, parameters: list[str] = PARAMETERS, tunables: list[str] = TUNABLES, smallest: bool = True) -> DataFrame:
    """The best configuration of each problem; equal times in order of the tunables."""
    time = F.asc("time") if smallest else F.desc("time")
    window = Window.partitionBy(*parameters).orderBy(time, *tunables)
    return means.withColumn("_ls_rank", F.row_number().over(window)).where("_ls_rank = 1").drop("_ls_rank")


def slowdown(means: DataFrame, best: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """``means`` with ``slowdown`` against the problem's best; problems without a best are left out. Null keys match."""
    renamed = best.select(*[F.col(c).alias(f"_ls_{c}") for c in parameters], F.col("time").alias("_ls_best"))
    on = [means[c].eqNullSafe(renamed[f"_ls_{c}"]) for c in parameters]
    joined = means.join(renamed, on, "left").where(F.col("_ls_best").isNotNull())
    return joined.withColumn("slowdown", F.col("time") / F.col("_ls_best")).select(*means.columns, "slowdown")


def fixed_optima(slow: DataFrame, groups: list[str], tunables: list[str] = TUNABLES) -> DataFrame:
    """The configuration with the smallest greatest slow-down, among those measured on most of the group's problems."""
    gross = slow.groupBy(*groups, *tunables).agg(F.min("slowdown").alias("min_slowdown"), F.max("slowdown").alias("max_slowdown"), F.count("*").alias("total_count"))
    whole = Window.partitionBy(*groups)
    covering = gross.withColumn("_ls_most", F.max("total_count").over(whole)).where("total_count = _ls_most")
    first = F.row_number().over(whole.orderBy("max_slowdown", *tunables))
    return covering.withColumn("_ls_rank", first).where("_ls_rank = 1").drop("_ls_rank", "_ls_most")


def harmonic_mean(value: Column) -> Column:
    return F.count(value) / F.sum(1.0 / value)


def harmonic_std(value: Column) -> Column:
    """Standard deviation of the harmonic mean."""
    return F.sqrt(F.var_pop(1.0 / value) / F.pow(F.avg(1.0 / value), F.lit(4)) / F.count(value))


def baseline_speedup(means: DataFrame, is_baseline: Column, keys: list[str]) -> DataFrame:
    """``means`` with the speed-up over the baseline of equal keys; null without one."""
    base = means.where(is_baseline).groupBy(*keys).agg(F.min("time").alias("_ls_base"))
    return means.join(base, keys, "left").withColumn("speedup", F.col("_ls_base") / F.col("time")).drop("_ls_base")


def with_bound(means: DataFrame, label: str, rate: Column, store_only: bool = False) -> DataFrame:
    """``means`` and one row for each problem whose time is the roofline's."""
    problems = means.select("hostname", "point_count", "query_count", "k", "dim").distinct()
    bound = problems.withColumns({"algorithm": F.lit(label), "time": roofline_seconds(F.col("point_count"), F.col("query_count"), F.col("dim"), rate, store_only)})
    return means.unionByName(bound, allowMissingColumns=True)


def speedups(means: DataFrame, proposed: str, keys: list[str]) -> DataFrame:
    """For each problem the best other algorithm's throughput, the proposed one's, and their ratio."""
    rate = F.col("point_count").cast("double") * F.col("query_count") / F.col("time")
    seen = means.withColumn("_ls_rate", rate)
    sota = seen.where(F.col("algorithm") != proposed).groupBy(*keys).agg(F.max("_ls_rate").alias("sota"))
    own = seen.where(F.col("algorithm") == proposed).groupBy(*keys).agg(F.max("_ls_rate").alias("proposed"))
    return sota.join(own, keys).withColumn("speedup", F.col("proposed") / F.col("sota"))


def statistics(speed: DataFrame, dataset: list[str], problem: list[str], bound: Column) -> DataFrame:
    """Rows ``situation, k, sota, proposed, speedup`` for each problem and, as ``global_*``, for each dataset.

    Problems group by ``problem`` over their ``k``; the first of equal extremes
    counts, in order of k, then of the problem.
    """
    seen = speed.withColumn("relative", F.col("proposed") / bound).withColumn("_ls_bound", bound)
    order = F.struct(-F.col("k"), *[-F.col(c) for c in problem])
    at = F.struct("k", *problem, "sota", "proposed", "speedup", "relative", F.col("_ls_bound").alias("bound"))
    grouped = (
        seen.groupingSets([[*dataset, *problem], [*dataset]], *dataset, *problem)
        .agg(
            F.grouping(problem[0]).alias("_ls_total"),
            F.max_by(at, F.struct(F.col("speedup"), order)).alias("max_speedup"),
            F.max_by(at, F.struct(-F.col("speedup"), order)).alias("min_speedup"),
            F.avg("speedup").alias("avg_speedup"),
            F.max_by(at, F.struct(F.col("relative"), order)).alias("max_relative_throughput"),
            F.max_by(at, F.struct(-F.col("relative"), order)).alias("min_relative_throughput"),
            F.avg("relative").alias("avg_relative_throughput"),
            F.max("_ls_bound").alias("_ls_most"),
        )
    )
    name = lambda s: F.concat(F.when(F.col("_ls_total") == 1, "global_").otherwise(""), F.lit(s))
    zero, rows = F.lit(0.0), []

    def row(situation: str, k: Column, where: list[Column], sota: Column, own: Column, value: Column) -> Column:
        return F.struct(name(situation).alias("situation"), k.cast("long").alias("k"), *[w.cast("long").alias(c) for c, w in zip(problem, where)], sota.alias("sota"), own.alias("proposed"), value.alias("speedup"))

    here = [F.coalesce(c, F.lit(0)) for c in problem]
    for s in ("max_speedup", "min_speedup"):
        x = F.col(s)
        rows.append(row(s, x["k"], [x[c] for c in problem], x["sota"], x["proposed"], x["speedup"]))
    rows.append(row("avg_speedup", F.lit(0), here, zero, zero, F.col("avg_speedup")))
    for s in ("max_relative_throughput", "min_relative_throughput"):
        x = F.col(s)
        rows.append(row(s, x["k"], [x[c] for c in problem], x["bound"], x["proposed"], x["relative"]))
    most = F.col("_ls_most")
    rows.append(row("avg_relative_throughput", F.lit(0), here, most, F.col("avg_relative_throughput") * most, F.col("avg_relative_throughput")))
    return grouped.select(*dataset, F.explode(F.array(*rows)).alias("x")).select(*dataset, "x.situation", "x.k", *[f"x.{c}" for c in problem], "x.sota", "x.proposed", "x.speedup")


#: Rows that a lookup folds, at most.
MOST_FOLDED = 1_000_000
#: The configuration without any fitting row.
DEFAULTS = {"block_size": 256, "deg": 1, "items_per_thread": 1, "items_per_thread2": 1, "items_per_thread3": 1}


def lookup_config(optima: DataFrame, algorithm: str, row: str, hostname: str | None = None, **request: int) -> DataFrame:
    """One row: the configuration for a request (``query_count``, ``k``, ``dim``), folded over rows in the order of ``row``.

    A row scores one for each requested size it reaches; its slack is the
    product of how far it is off.  It replaces the current choice if its score
    is no smaller and its slack is smaller; the first row always does.  An
    empty cell keeps the value of the row before.  The fold is sequential, so
    fitting rows meet in one row; more than ``MOST_FOLDED`` are an error.
    """
    fits = F.col("algorithm") == algorithm
    rows = optima.where(fits & (F.col("hostname") == hostname) if hostname is not None else fits)
    if rows.limit(MOST_FOLDED + 1).count() > MOST_FOLDED:
        raise ValueError(f"more than {MOST_FOLDED} rows to look up in")
    asked = [(c, v) for c, v in request.items() if v is not None and c in optima.columns]
    score, slack = F.lit(0), F.lit(1.0)
    for c, v in asked:
        score = score + F.when(F.col(c) >= v, 1).otherwise(0)
        slack = slack * F.coalesce(F.when(F.col(c) >= v, F.col(c) / float(v)).otherwise(float(v) / F.col(c)), F.lit(1.0))
    cells = [c for c in DEFAULTS if c in optima.columns]
    item = F.struct(F.col(row).alias("row"), score.alias("score"), slack.alias("slack"), *[F.col(c).cast("int").alias(c) for c in cells])
    ordered = rows.agg(F.array_sort(F.collect_list(item)).alias("rows"))
    value = lambda x: F.struct(*[x[c].alias(c) for c in cells])
    start = F.struct(F.lit(0).alias("score"), F.lit(0.0).alias("slack"), F.struct(*[F.lit(DEFAULTS[c]).alias(c) for c in cells]).alias("now"), F.struct(*[F.lit(DEFAULTS[c]).alias(c) for c in cells]).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = F.struct(*[F.coalesce(x[c], acc["last"][c]).alias(c) for c in cells])
        better = (x["score"] >= acc["score"]) & ((acc["slack"] == 0) | (x["slack"] < acc["slack"]))
        return F.struct(F.when(better, x["score"]).otherwise(acc["score"]).alias("score"), F.when(better, x["slack"]).otherwise(acc["slack"]).alias("slack"), F.when(better, last).otherwise(acc["now"]).alias("now"), last.alias("last"))

    found = ordered.select(F.aggregate("rows", start, step).alias("x"))
    return found.select(*[F.col(f"x.now.{c}").alias(c) for c in cells], *[F.lit(v).alias(c) for c, v in DEFAULTS.items() if c not in cells])
