"""A top-k that is kept: arrays of k rows a group, merged with what arrives.

The state is a table with one row a group.  Appending reads the state and the
new rows only, never what came before.  Each append writes a new version; the
last one that was written to its end is the state, so a lost driver or executor
costs the append and nothing else, and an append that is repeated under its
number changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.topk import top_k


def to_state(df: DataFrame, groups: list[str], value: str, labels: list[str], k: int, largest: bool = False) -> DataFrame:
    """``groups, top``: the first k rows of each group as an array of ``rank, labels, value`` in order."""
    ranked = top_k(df, groups, value, labels, k, largest)
    return ranked.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("rank", *labels, value))).alias("top"))


def from_state(state: DataFrame, groups: list[str], value: str, labels: list[str]) -> DataFrame:
    """The state's rows: ``groups, rank, labels, value``."""
    return state.select(*groups, F.explode("top").alias("_ls_x")).select(*groups, *[F.col(f"_ls_x.{c}").alias(c) for c in ("rank", *labels, value)])


def merge(states: list[DataFrame], groups: list[str], value: str, labels: list[str], k: int, largest: bool = False) -> DataFrame:
    """One state of several: k rows of each are enough to know the first k of all."""
    rows = None
    for state in states:
        one = from_state(state, groups, value, labels).drop("rank")
        rows = one if rows is None else rows.unionByName(one)
    return to_state(rows, groups, value, labels, k, largest)


class RunningTopK:
    """The state of a folder, a version for each append."""

    def __init__(self, spark: SparkSession, path: str, groups: list[str], value: str, labels: list[str], k: int, largest: bool = False):
        self.spark, self.path, self.k, self.largest = spark, path.rstrip("/"), k, largest
        self.names = (list(groups), value, list(labels))

    def versions(self) -> list[int]:
        """Numbers of the versions that were written to their end."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")) or []
        return sorted(int(re.search(r"/v(\d+)/_SUCCESS$", f.getPath().toString()).group(1)) for f in found)

    def state(self) -> DataFrame | None:
        have = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{have[-1]}") if have else None

    def append(self, df: DataFrame, number: int | None = None) -> int:
        """Merge new rows; the version's number.  A number that has been appended is skipped."""
        have = self.versions()
        number = (have[-1] + 1 if have else 0) if number is None else number
        if have and number <= have[-1]:
            return have[-1]
        groups, value, labels = self.names
        new = to_state(df, groups, value, labels, self.k, self.largest)
        old = self.state()
        whole = new if old is None else merge([old, new], groups, value, labels, self.k, self.largest)
        whole.write.mode("overwrite").parquet(f"{self.path}/v{number}")  # what a lost append has left goes
        return number

    def rows(self) -> DataFrame:
        """``groups, rank, labels, value`` of all that was appended."""
        groups, value, labels = self.names
        state = self.state()
        if state is None:
            raise ValueError("nothing has been appended")
        return from_state(state, groups, value, labels)

    def batch(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` of a stream: every batch counts once, however often it is tried."""
        return lambda df, number: self.append(df, number) and None
