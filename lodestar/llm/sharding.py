"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

A row's 64-bit address is 32 bits hashed from its key and text, then 32 bits of
salt, which is hashed from the number of the row among equal rows.  So it
depends on the table alone, not on how it is read.  A directory is indexed by address prefixes: the root bucket holds all
rows, and only a bucket over the byte limit splits on its next bit, until every
bucket fits.  Content bits come first, so rows go by content; the salt bits
matter only for a bucket of rows with one and the same content, which would
never split otherwise.

The splitting runs on a histogram of prefixes, not on rows: prefixes of
``base`` bits are summed once (map-side combined) and rolled up to every
shorter prefix.  ``base`` follows from total bytes and limit, so the histogram
has a few cells for each shard at any size.  Cells that are still over the
limit at ``base`` bits go on alone with eight more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import durable, partitions, small

#: Bytes of text in a shard at most.
SHARD_BYTES = 1024 * 1024
#: Equal rows numbered by one task at once.
EQUAL = 100_000
#: Address bits beyond those that even splitting would need.
SPARE_BITS = 4
STEP_BITS = 8


def _prefix(address: str, bits: int):
    return F.expr(f"shiftrightunsigned({address}, {64 - bits})") if bits else F.lit(0).cast("long")


def _addresses(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_bytes, address``: equal rows are counted, then written out again with their numbers."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), body)).alias("content"),
    )
    counts = rows.groupBy("key", "n_bytes", "content").agg(F.count("*").alias("n"))
    one = counts.where("n = 1").withColumn("number", F.lit(0).cast("long"))
    # Many equal rows are dealt out in runs before each run is numbered.
    runs = counts.where("n > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {EQUAL}"))))
    runs = runs.repartition(partitions(df.sparkSession), "content", "run")
    more = runs.withColumn("number", F.explode(F.sequence(F.col("run") * EQUAL, F.least(F.col("n"), (F.col("run") + 1) * EQUAL) - 1)))
    hex32 = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long")
    salt = F.md5(F.concat(F.col("content"), F.lit(":"), F.col("number").cast("string")))
    names = ["key", "n_bytes", "content", "number"]
    return one.select(*names).unionByName(more.select(*names)).select("key", "n_bytes", F.shiftleft(hex32(F.col("content")), 32).bitwiseOR(hex32(salt)).alias("address"))


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: ``key, n_bytes, shard, depth, shard_bytes, shard_rows, fits``.

    ``shard`` is the bucket's address prefix as bits ("" if one bucket holds
    all), ``depth`` its length.  Null texts count zero bytes, null keys hash
    like any value, repeated rows are rows of their own and may land in
    different shards.  A single row larger than the limit gets a bucket of its
    own with ``fits`` false; all other buckets have ``shard_bytes <= limit``.
    An empty table gives an empty result.  Other columns are ignored.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = durable(_addresses(df, key, text), "addresses")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, low, parts = min(60, max(SPARE_BITS, math.ceil(math.log2(max(1.0, total / limit))) + SPARE_BITS)), 0, []
    while True:
        celled = rows.withColumn("cell", _prefix("address", base))
        cells = celled.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        at = (
            cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(base))).alias("depth"))
            .withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {base} - depth)"))
        )
        buckets = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        # In one pass over the roll-up: a cell's leaf is its shallowest bucket that fits.
        leaves = (
            at.select("cell", "depth", "prefix")
            .join(buckets.where((F.col("shard_bytes") <= limit) | ((F.col("depth") == 64) | (F.col("shard_rows") == 1))), ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
        )
        # Rows of one cell may be many: its leaf comes to them while leaves are few.
        placed = celled.join(small(durable(leaves, "leaves")), "cell", "left")
        parts.append(
            placed.where(F.col("leaf").isNotNull()).select(
                F.col("key").alias(key),
                "n_bytes",
                F.expr("if(leaf.depth = 0, '', lpad(bin(leaf.prefix), leaf.depth, '0'))").alias("shard"),
                F.col("leaf.depth").alias("depth"),
                F.col("leaf.shard_bytes").alias("shard_bytes"),
                F.col("leaf.shard_rows").alias("shard_rows"),
                (F.col("leaf.shard_bytes") <= limit).alias("fits"),
            )
        )
        over = cells.where((F.col("bytes") > limit) & (F.col("rows") > 1))
        if base >= 64 or over.limit(1).count() == 0:
            break
        # So do the cells of equal rows.
        over = small(durable(over.select("cell"), "over"))
        rows = durable(celled.join(over, "cell", "left_semi").select("key", "n_bytes", "address"), "oversized")
        low, base = base + 1, min(64, base + STEP_BITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def directory(assigned: DataFrame) -> DataFrame:
    """The leaf buckets of an assignment: ``shard, depth, shard_bytes, shard_rows``."""
    return assigned.groupBy("shard", "depth").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_rows").alias("shard_rows"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``df`` as Parquet folders, one for each shard; ``key`` must be unique."""
    df.join(assigned.select(key, "shard"), key).repartition("shard").write.partitionBy("shard").parquet(path)
