"""Comparison of two neighbour tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalar import approx_equal
from lodestar.storage import durable


def mismatches(expected: DataFrame, actual: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """Ranks at which two results differ: ``query_id, rank, reason`` and both sides.

    A label may differ if the distances agree and the expected distance is that
    of the rank's ties: the label is one of them, or the ties go on to the last
    rank and may go on beyond it.  What is expected is used three times, so it is
    written once.
    """
    expected = durable(expected, "expected")
    e = expected.select("query_id", "rank", F.col("point_id").alias("expected_id"), F.col("dist").alias("expected_dist"))
    a = actual.select("query_id", "rank", F.col("point_id").alias("actual_id"), F.col("dist").alias("actual_dist"))
    both = e.join(a, ["query_id", "rank"], "full")
    last = e.groupBy("query_id").agg(F.max("rank").alias("k"), F.max_by("expected_dist", "rank").alias("last_dist"))
    held = e.select(F.col("query_id").alias("h_query"), F.col("expected_id").alias("h_id"), F.col("expected_dist").alias("h_dist"))
    seen = both.join(last, "query_id", "left").join(held, (F.col("query_id") == F.col("h_query")) & (F.col("actual_id") == F.col("h_id")), "left")
    near = F.coalesce(approx_equal(F.col("expected_dist"), F.col("actual_dist"), epsilon), F.lit(False))
    tied = approx_equal(F.col("expected_dist"), F.col("h_dist"), epsilon)
    open_end = F.col("h_id").isNull() & approx_equal(F.col("expected_dist"), F.col("last_dist"), epsilon)
    reason = (
        F.when(F.col("expected_id").isNull() | F.col("actual_id").isNull(), "missing")
        .when(~near, "distance")
        .when(F.col("expected_id") == F.col("actual_id"), None)
        .when(F.coalesce(tied, F.lit(False)) | open_end, None)
        .otherwise("label")
    )
    return seen.withColumn("reason", reason).where("reason is not null").select("query_id", "rank", "reason", "expected_id", "expected_dist", "actual_id", "actual_dist")


def verify(expected: DataFrame, actual: DataFrame, epsilon: float = 1e-3) -> bool:
    return mismatches(expected, actual, epsilon).isEmpty()
