"""Selection of the k smallest (or largest) rows of each group.

One operator, several physical strategies with equal results:

``group_limit``
    ``row_number() <= k``; Spark drops rows beyond the k-th before and after
    the shuffle (WindowGroupLimit), so k rows a group leave each task.
``sort``
    The same window over whole groups, hidden from that optimisation.
``heap``
    Each task keeps the k best of every group while batches pass; rows that the
    group's k-th rules out are dropped before anything is sorted.  Then the window
    merges tasks.  Never more than k rows of a group in memory.
``radix``
    Histograms of the ordered bits of the value find the k-th smallest, pass by
    pass; only counts and what is selected shuffle (:mod:`lodestar.operators.radix`).
``two_level``
    Groups are cut into ``deg`` parts by the label's hash, k of each part are
    merged: for one group that is large by itself.  With ``deg=0`` a count of
    every group decides which ones are cut, and into how many parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.model import positive
from lodestar.operators.radix import radix_rows
from lodestar.shipping import ship
from lodestar.storage import durable

STRATEGIES = ("group_limit", "sort", "heap", "two_level", "radix")


def _order(value: str, labels: list[str], largest: bool) -> list[Column]:
    return [F.desc_nulls_last(value) if largest else F.asc_nulls_last(value), *[F.asc(c) for c in labels]]


def _ranked(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def top_k(df: DataFrame, groups: list[str], value: str, labels: list[str], k: int, largest: bool = False, strategy: str = "group_limit", deg: int = 8) -> DataFrame:
    """``groups, rank, labels, value``: ranks 1 to k of each group, ties in order of the labels.

    Groups of fewer rows give as many; nulls come last, after not-a-number.
    """
    positive(k=k, **({"deg": deg} if deg or strategy != "two_level" else {}))
    if strategy not in STRATEGIES:
        raise ValueError(f"Unsupported strategy {strategy!r}")
    if not labels:
        raise ValueError("labels are needed to order equal values")
    if not groups:
        return _whole(df, value, labels, k, largest)
    order, out = _order(value, labels, largest), [*groups, "rank", *labels, value]
    slim = df.select(*groups, *labels, value)
    if strategy == "group_limit":
        return _ranked(slim, groups, order, k).select(*out)
    if strategy == "sort":
        window = Window.partitionBy(*groups).orderBy(*order)
        return slim.withColumns({"rank": F.row_number().over(window), "_ls_all": F.max(F.lit(1)).over(Window.partitionBy(*groups))}).where(F.col("rank") * F.col("_ls_all") <= k).select(*out)
    if strategy == "radix":
        return _ranked(radix_rows(slim, groups, value, k, largest), groups, order, k).select(*out)
    if strategy == "two_level":
        part = slim.withColumn("_ls_part", F.pmod(F.xxhash64(*labels), F.lit(deg))) if deg else cut_by_size(slim, groups, labels)
        return _ranked(_ranked(part, [*groups, "_ls_part"], order, k).drop("rank"), groups, order, k).select(*out)
    ship(df.sparkSession)
    odd = F.isnan(value) if slim.schema[value].dataType.simpleString() in ("double", "float") else F.lit(False)
    # Not-a-number is larger than any number, null is last: an order that pandas does not have.
    place = F.when(F.col(value).isNull(), 2).when(odd, -1 if largest else 1).otherwise(0)
    marked = slim.withColumn("_ls_place", place)
    kept = marked.mapInPandas(_running(groups, ["_ls_place", value, *labels], [True, not largest, *[True] * len(labels)], k), marked.schema)
    return _ranked(kept.drop("_ls_place"), groups, order, k).select(*out)


#: Rows of a part, about, where groups are cut by their size; groups that are cut, at most: others stay whole.
PART_ROWS, MOST_CUT = 1 << 20, 100_000


def cut_by_size(df: DataFrame, groups: list[str], labels: list[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``_ls_part``: groups of more than ``rows`` rows are dealt to parts of about so many by the labels' hash.

    Groups are counted first.  Those that are cut are the largest ones, a bounded
    number, and are broadcast; what a part gains in rows beyond is the same to
    the result.
    """
    most = rows or PART_ROWS
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_ls_n")).where(F.col("_ls_n") > most)
    large = durable(sizes.orderBy(F.desc("_ls_n"), *groups).limit(MOST_CUT).select(*[F.col(g).alias(f"_ls_{i}") for i, g in enumerate(groups)], F.ceil(F.col("_ls_n") / most).alias("_ls_deg")), "cut")
    met = df.join(F.broadcast(large), reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_ls_{i}")) for i, g in enumerate(groups)]), "left")
    part = F.when(F.col("_ls_deg").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*labels), F.col("_ls_deg")))
    return met.withColumn("_ls_part", part).select(*df.columns, "_ls_part")


def _running(groups: list[str], by: list[str], ascending: list[bool], k: int):
    place, value = by[:2]

    def hopeful(batch: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        """Rows that are no worse than the k-th of their group, where it has k."""
        last = best.groupby(groups, dropna=False, sort=False).nth(k - 1)
        if not len(last):
            return batch
        limit = last[[*groups, place, value]].rename(columns={place: "_ls_last_place", value: "_ls_last"})
        met = batch.merge(limit, "left", groups)  # null groups meet
        better = (met[value] <= met["_ls_last"]) if ascending[1] else (met[value] >= met["_ls_last"])
        same = (met[place] == met["_ls_last_place"]) & (better.fillna(False) | met["_ls_last"].isna() | met[value].isna())
        return batch[(met["_ls_last_place"].isna() | (met[place] < met["_ls_last_place"]) | same).to_numpy(bool)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if best is not None and not best.empty:
                batch = hopeful(batch, best)
                if batch.empty:
                    continue
                batch = pd.concat([best, batch], ignore_index=True)
            best = batch.sort_values(by, ascending=ascending).groupby(groups, dropna=False, sort=False).head(k)
        if best is not None:
            yield best

    return run


def _whole(df: DataFrame, value: str, labels: list[str], k: int, largest: bool) -> DataFrame:
    """Of one group that is the table: a top-k of each task, then of those rows."""
    order = _order(value, labels, largest)
    first = df.select(*labels, value).orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", *labels, value)
