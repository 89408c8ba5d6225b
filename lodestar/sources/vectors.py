"""Vector tables, generators and preprocessors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scalar import parse_floats
from lodestar.model import positive
from lodestar.storage import durable


def as_points(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("point_id"), F.col(vector).cast("array<double>").alias("p"))


def as_queries(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))


#: Hexadecimal digits of a number that is drawn, and how many numbers they can be.
DIGITS, NUMBERS = 13, float(1 << 52)


def drawn(seed: int, counter: Column, dim: Column, nth: int = 0) -> Column:
    """A number from [0, 1) that depends on (seed, counter, dimension) alone, ``nth`` of two.

    Not on partitions, order or cores: any task can draw any component again.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), counter.cast("string"), dim.cast("string")))
    return F.conv(F.substring(digest, 1 + DIGITS * nth, DIGITS), 16, 10).cast("long") / NUMBERS


def _vector(dim: int, component: Callable[[Column], Column]) -> Column:
    positive(dim=dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component)


def uniform_vector(counter: Column, dim: int, params: str = "", seed: int = 0) -> Column:
    """Components from [low, high); ``params`` is "", "high" or "low,high"."""
    given = parse_floats(params)
    low, high = (0.0, 1.0) if not given else (0.0, given[0]) if len(given) == 1 else (given[0], given[1])
    if len(given) > 2 or low >= high:
        raise ValueError(f"uniform needs low < high, not {params!r}")
    return _vector(dim, lambda i: F.lit(low) + drawn(seed, counter, i) * (high - low))


def normal_vector(counter: Column, dim: int, params: str = "", seed: int = 0) -> Column:
    """Normally distributed components; ``params`` is "", "std" or "mean,std"."""
    given = parse_floats(params)
    mean, std = (0.0, 1.0) if not given else (0.0, given[0]) if len(given) == 1 else (given[0], given[1])
    if len(given) > 2 or std <= 0:
        raise ValueError(f"normal needs std > 0, not {params!r}")

    def component(i: Column) -> Column:
        radius = F.sqrt(-2 * F.ln(1 - drawn(seed, counter, i)))
        return F.lit(mean) + std * radius * F.cos(2 * F.pi() * drawn(seed, counter, i, 1))

    return _vector(dim, component)


#: Vectors of a column of counters.
VECTORS: dict[str, Callable[..., Column]] = {"uniform": uniform_vector, "normal": normal_vector}


def _generate(spark: SparkSession, count: int, dim: int, make: Callable[..., Column], params: str, seed: int, name: str, start: int) -> DataFrame:
    positive(count=count, dim=dim)
    key, vector = ("point_id", "p") if name == "points" else ("query_id", "q")
    return spark.range(count).select(F.col("id").alias(key), make(F.col("id") + start, dim, params, seed).alias(vector))


def uniform(spark: SparkSession, count: int, dim: int, params: str = "", seed: int = 0, name: str = "points", start: int = 0) -> DataFrame:
    """Vectors of the counters from ``start``; see :func:`uniform_vector`."""
    return _generate(spark, count, dim, uniform_vector, params, seed, name, start)


def normal(spark: SparkSession, count: int, dim: int, params: str = "", seed: int = 0, name: str = "points", start: int = 0) -> DataFrame:
    """Vectors of the counters from ``start``; see :func:`normal_vector`."""
    return _generate(spark, count, dim, normal_vector, params, seed, name, start)


GENERATORS = {"uniform": uniform, "normal": normal}


def generate(spark: SparkSession, generator: str, points: int, queries: int, dim: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Points and queries of ``name`` or ``name:params``; the queries' counters go on where the points' end."""
    name, _, params = generator.partition(":")
    if name not in GENERATORS:
        raise ValueError(f"Unsupported generator {name!r}")
    make = GENERATORS[name]
    return make(spark, points, dim, params, seed), make(spark, queries, dim, params, seed, "queries", points)


def stub_between(points: DataFrame, queries: DataFrame, unique: int) -> DataFrame:
    """Distances without a metric: multiples of 1/32 in an order of each query's own, ``unique`` different ones."""
    positive(unique=unique)
    pairs = points.select("point_id").crossJoin(F.broadcast(queries.select("query_id")))
    place = F.pmod(F.col("point_id") * 7919 + F.col("query_id") * 104729, F.lit(unique))
    return pairs.select("query_id", "point_id", (place / 32.0).alias("dist"))


def stub_steps(points: int, unique: int = 0) -> tuple[int, int]:
    """(points to a distance, step from point to point): a step that is coprime to ``points`` shuffles 0 .. points - 1."""
    return 1 if unique <= 0 else -(-points // unique), next(s for s in range(max(2, points * 5 // 8), 2 * points + 3) if _coprime(s, points))


def stub_distances(spark: SparkSession, queries: int, points: int, unique: int = 0, seed: int = 0) -> DataFrame:
    """Distances that are multiples of 1/32 in an order of their own for each query; ``unique`` different ones (0: all)."""
    positive(queries=queries, points=points)
    stride, step = stub_steps(points, unique)
    grid = spark.range(queries).select(F.col("id").alias("query_id")).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point_id"))
    place = F.pmod(F.col("point_id") * step + F.col("query_id") * 7919 + seed, F.lit(points))
    return grid.select("query_id", F.col("point_id").cast("long").alias("point_id"), (F.floor(place / stride) / 32.0).alias("dist"))


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def identity(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points, queries


def ordering(ascending: bool) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Of one-dimensional data: queries become zero, points are numbered in order of value.

    Numbers are global ranks: rows are sorted over all partitions and each
    partition's offset is the count of those before it.
    """

    def run(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        value = F.element_at("p", 1)
        order = value.asc() if ascending else value.desc()
        ranked = sort_with_position(points, [order, F.col("point_id")], "position")
        return ranked.select(F.col("position").alias("point_id"), "p"), queries.select("query_id", F.transform("q", lambda _: F.lit(0.0)).alias("q"))

    return run


def sort_with_position(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the position, from 0, of each row in a total order, without a single-partition window."""
    from pyspark.sql import Window

    part = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Written once: both uses must see the same ranges.
    placed = durable(df.repartitionByRange(int(part), *order).withColumn("_ls_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_ls_part").agg(F.count("*").alias("_ls_n"))
    before = counts.select("_ls_part", (F.sum("_ls_n").over(Window.orderBy("_ls_part")) - F.col("_ls_n")).alias("_ls_before"))
    inside = F.row_number().over(Window.partitionBy("_ls_part").orderBy(*order)) - 1
    return placed.withColumn("_ls_inside", inside).join(F.broadcast(before), "_ls_part").withColumn(name, F.col("_ls_before") + F.col("_ls_inside")).drop("_ls_part", "_ls_inside", "_ls_before")


PREPROCESSORS = {"identity": identity, "ascending": ordering(True), "descending": ordering(False)}


#: Vectors in a columnar block.
BLOCK = 65_536


def to_columnar(df: DataFrame, key: str, vector: str, rows: int = BLOCK) -> DataFrame:
    """Row vectors to one row a block and dimension: ``block, dim, keys, values`` ordered by key.

    A block holds about ``rows`` vectors, so no row grows with the table.
    """
    blocks = max(1, -(-df.count() // rows))
    long = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), key, F.posexplode(vector).alias("dim", "value"))
    lists = long.groupBy("block", "dim").agg(F.array_sort(F.collect_list(F.struct(key, "value"))).alias("r"))
    return lists.select("block", "dim", F.col(f"r.{key}").alias("keys"), F.col("r.value").alias("values"))


def from_columnar(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The inverse of :func:`to_columnar`; a key's components meet, no more."""
    long = df.select("dim", F.explode(F.arrays_zip("keys", "values")).alias("x"))
    lists = long.groupBy(F.col("x.keys").alias(key)).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("x.values").alias("value")))).alias("r"))
    return lists.select(key, F.col("r.value").alias(vector))
