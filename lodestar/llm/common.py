"""Helpers shared by the operators: table access, durable intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.shipping import ship
from lodestar.storage import durable, release  # noqa: F401  (operators take them from here)

#: Texts go to Python in batches of so many rows at most: with texts of many KB the default's are large.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: The ASCII letters that contracts ask to be lower-cased.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """What operators that run Python need of a session: this package, and batches of bounded rows."""
    ship(spark)
    if int(spark.conf.get(BATCH)) > ROWS:
        spark.conf.set(BATCH, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark's own reader."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that are broadcast, at most.
FEW = 400_000


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` (written already, rows of a few numbers) with a broadcast hint if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_ls_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _below(bounds: list[int], value: Column, inclusive: bool) -> Column:
    """How many of the sorted bounds are below ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    held, steps = F.array(*map(F.lit, bounds)), [1 << b for b in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, by: Column) -> Column:
        bound = F.get(held, at + by - 1)
        return F.when((at + by <= len(bounds)) & ((bound <= value) if inclusive else (bound < value)), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def range_buckets(df: DataFrame, key: str, tie: Column, buckets: int) -> Column:
    """A bucket number, never falling in the order of (key, tie), that deals rows evenly.

    ``key`` is a column of any ordered type, ``tie`` a hash (long, used unsigned
    by its top bits) that orders rows of one key.  Bounds are approximate
    quantiles; a key so frequent that it is several bounds at once is spread
    over the buckets between them by ``tie``.  Null keys come first.  Only the
    bounds, fewer numbers than ``buckets``, come to the driver.
    """
    if buckets < 2:
        bounds = []
    elif isinstance(df.schema[key].dataType, T.IntegralType):
        probabilities = [i / buckets for i in range(1, buckets)]
        bounds = sorted(map(int, df.approxQuantile(key, probabilities, 0.25 / buckets)))
    else:  # no quantiles: the first keys of as many ranges, sorted with the ties
        slim = df.select(F.col(key).alias("key"), tie.alias("tie")).where("key is not null")
        least = slim.repartitionByRange(buckets, "key", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
        bounds = [r.key for r in least.orderBy("part").collect()[1:]]
    low, high = _below(bounds, F.col(key), False), _below(bounds, F.col(key), True)
    part = F.shiftrightunsigned(tie, 33)  # 31 bits
    spread = F.shiftright(part * (high - low + 1), 31)
    return F.when(F.col(key).isNull(), F.lit(0)).when(high == low, low).otherwise((low + spread).cast("int"))


def meet(rows: DataFrame, names: DataFrame, key: str | list[str], left: bool = False, often: int = 1 << 14) -> DataFrame:
    """Join, inner or left, of many rows with a table (both written already) that has each ``key`` once.

    Broadcast if the table is small.  Else keys of more than ``often`` rows, of
    which there are few, are broadcast and only the others are shuffled, so that no
    key's rows meet in one task.
    """
    how, keys = "left" if left else "inner", [key] if isinstance(key, str) else key
    if names.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(names), key, how)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_ls_n")).where(F.col("_ls_n") > often).select(*keys)
    hot = durable(hot, "often")
    few, wide = small(hot), small(durable(names.join(hot, key, "left_semi"), "hot"))
    return rows.join(few, key, "left_semi").join(wide, key, how).unionByName(rows.join(few, key, "left_anti").join(names, key, how))
