"""Schemas and the query configuration of nearest-neighbour search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
QUERIES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
DISTANCES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("point_id", T.LongType()), T.StructField("dist", T.DoubleType())])
NEIGHBORS = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("point_id", T.LongType()), T.StructField("dist", T.DoubleType())]
)
BENCH = T.StructType(
    [
        T.StructField("algorithm", T.StringType()),
        T.StructField("generator", T.StringType()),
        T.StructField("preprocessor", T.StringType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("point_count", T.LongType()),
        T.StructField("query_count", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("block_size", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("items_per_thread", T.StringType()),
        T.StructField("deg", T.IntegerType()),
        T.StructField("phase", T.StringType()),
        T.StructField("time", T.DoubleType()),
    ]
)
PHASES = ("prepare", "transfer-in", "distances", "selection", "postprocessing", "finish", "transfer-out")


def positive(**values: int) -> None:
    """Every value must be a positive whole number."""
    for name, value in values.items():
        if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
            raise ValueError(f"{name} must be a positive integer, not {value!r}")


@dataclass(frozen=True)
class KnnSpec:
    """What to search and how: the result depends on ``k``, ``metric``, ``precision`` and ``pad`` only."""

    k: int
    metric: str = "l2"
    strategy: str = "fused"
    deg: int = 8
    precision: str = "double"
    pad: bool = False
    #: ``precision`` only finds candidates, with a proven bound; distances and results are those of doubles.
    certify: bool = False

    def __post_init__(self):
        positive(k=self.k, deg=self.deg)
