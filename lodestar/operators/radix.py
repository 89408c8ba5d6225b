"""Selection by radix: the k-th smallest of every group without sorting, and without moving rows.

A value becomes a whole number of the same order, by the bits of its type.  A
pass counts, for each group, how many of its candidates begin with which bits;
tasks send counts, never rows.  Of these the one that holds the k-th smallest is
the group's new prefix, and the next pass looks at candidates with that prefix
only.  As soon as few rows are left they are written once and the other passes
read those.  What the last prefix lets through, ties included, is ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.model import positive
from lodestar.storage import durable

#: Bits that a pass looks at; rows of a scan of which so large a share is still in question are not written.
BITS, SHARE = 11, 0.25
#: Groups whose prefixes are broadcast at once; more make more scans.
MOST_GROUPS = 200_000


def ordered_key(value: Column, kind: T.DataType) -> Column:
    """A long that orders as the value does; not-a-number is the largest, null stays null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("long")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("decimal(18,0)").cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _double_key(value.cast("double"))
    raise ValueError(f"no radix of {kind.simpleString()}")


def _double_key(value: Column) -> Column:
    """Exponent and mantissa of a double, by exact divisions with powers of two, with its sign."""
    x = F.abs(value)
    least, two = 2.0**-1022, F.lit(2.0)
    safe = F.when((x >= least) & (x < float("inf")), x).otherwise(F.lit(1.0))
    near = F.greatest(F.least(F.floor(F.log2(safe)), F.lit(1023)), F.lit(-1022))
    exponent = F.when(F.pow(two, near) > safe, near - 1).when((near < 1023) & (F.pow(two, near) * 2 <= safe), near + 1).otherwise(near)
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + ((safe / F.pow(two, exponent) - 1) * 2.0**52).cast("long")
    small = F.when(x < least, x).otherwise(F.lit(0.0)) * 2.0**537 * 2.0**537
    bits = (
        F.when(F.isnan(value), F.lit(0x7FF8 << 48))
        .when(x == float("inf"), F.lit(0x7FF0 << 48))
        .when(x >= least, normal)
        .when(x < least, small.cast("long"))
    )
    return F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits)


def _same(groups: list[str]) -> Column:
    """A row's group is that of the prefixes' row; groups may be null."""
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_ls_{i}")) for i, g in enumerate(groups)])


def histogram(rows: DataFrame, groups: list[str], shift: int, state: DataFrame | None, before: int) -> DataFrame:
    """``groups, _ls_prefix, _ls_n``: how many candidates of a group begin with which bits."""
    key = F.col("_ls_key")
    if state is None:
        some = rows.where(key.isNotNull())
    else:
        some = rows.join(F.broadcast(state), _same(groups) & (F.shiftright(key, before) == F.col("_ls_at")))
    return some.groupBy(*groups, F.shiftright(key, shift).alias("_ls_prefix")).agg(F.count("*").alias("_ls_n"))


def _narrowed(counts: DataFrame, groups: list[str], need: Column) -> DataFrame:
    """Of each group the prefix of its k-th smallest: what is below it, and what is still needed at it."""
    by = Window.partitionBy(*groups)
    upto = counts.withColumn("_ls_upto", F.sum("_ls_n").over(by.orderBy("_ls_prefix"))).withColumn("_ls_all", F.sum("_ls_n").over(by))
    asked = upto.withColumn("_ls_asked", F.least(need, F.col("_ls_all")))
    return asked.where((F.col("_ls_upto") >= F.col("_ls_asked")) & (F.col("_ls_upto") - F.col("_ls_n") < F.col("_ls_asked")))


def radix_rows(df: DataFrame, groups: list[str], value: str, k: int, largest: bool = False, bits: int = BITS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """The rows of ``df`` among which each group's k smallest are: those up to the k-th, all ties of it included."""
    positive(k=k, bits=bits, most_groups=most_groups)
    key = ordered_key(F.col(value), df.schema[value].dataType)
    rows = df.withColumn("_ls_key", F.bitwise_not(key) if largest else key)
    return _selected(rows, groups, k, bits, most_groups).drop("_ls_key")


def _selected(rows: DataFrame, groups: list[str], k: int, bits: int, most_groups: int) -> DataFrame:
    state, before, written = None, 64, False
    names = [F.col(g).alias(f"_ls_{i}") for i, g in enumerate(groups)]
    while before:
        shift = max(0, before - bits)
        counts = histogram(rows, groups, shift, state, before)
        if state is None:
            found = _narrowed(counts, groups, F.lit(k)).withColumn("_ls_below", F.lit(0).cast("long"))
            total = F.col("_ls_all")
        else:
            met = counts.join(F.broadcast(state), _same(groups)).select(*groups, "_ls_prefix", "_ls_n", "_ls_need", "_ls_below", "_ls_total")
            found, total = _narrowed(met, groups, F.col("_ls_need")), F.col("_ls_total")
        low = F.col("_ls_upto") - F.col("_ls_n")
        found = found.select(
            *names,
            F.col("_ls_prefix").alias("_ls_at"),
            (F.col("_ls_asked") - low).alias("_ls_need"),
            F.col("_ls_n").alias("_ls_here"),
            (F.col("_ls_below") + low).alias("_ls_below"),
            total.alias("_ls_total"),
        )
        first, state, before = state is None, durable(found, "prefixes"), shift
        seen = state.agg(F.count("*").alias("groups"), F.sum(F.col("_ls_below") + F.col("_ls_here")).alias("left"), F.sum("_ls_total").alias("all"), F.max(F.col("_ls_here") - F.col("_ls_need")).alias("spare")).first()
        if first and seen.groups > most_groups:
            n = -(-2 * seen.groups // most_groups)
            piece = F.pmod(F.xxhash64(*groups), F.lit(n))
            return reduce(DataFrame.unionByName, [_selected(rows.where(piece == i), groups, k, bits, most_groups) for i in range(n)])
        if not written and seen.groups and seen.left <= SHARE * seen.all:
            rows, written = durable(_up_to(rows, groups, state, shift, k), "candidates"), True
        if not seen.groups or seen.spare == 0 or (written and seen.left <= 4 * k * seen.groups):
            break
    return _up_to(rows, groups, state, before, k)


def _up_to(rows: DataFrame, groups: list[str], state: DataFrame, shift: int, k: int) -> DataFrame:
    """Rows up to their group's prefix; null values where a group has fewer than k others."""
    met = rows.join(F.broadcast(state), _same(groups), "left")
    short = F.col("_ls_total").isNull() | (F.col("_ls_total") < k)
    key = F.col("_ls_key")
    return met.where(F.when(key.isNull(), short).otherwise(F.shiftright(key, shift) <= F.col("_ls_at"))).select(*rows.columns)
