"""Scalar helpers: number parsers, comparisons, throughput and roofline figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary suffixes of numbers.
SUFFIXES = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
#: Memory bandwidth by host prefix, GB/s.
BANDWIDTH = {"volta": 900, "ampere01": 864, "ampere02": 1935, "hopper": 2039}
FLOAT_BYTES, GB = 4, 1024**3


def parse_number(text: str) -> int:
    """``"4k"`` is 4096; suffixes k, m, g in either case; an empty string is 0."""
    text = text.strip()
    if not text:
        return 0
    scale = SUFFIXES.get(text[-1].lower(), 1)
    digits = text if scale == 1 else text[:-1]
    if not digits.isdigit():
        raise ValueError(f"not a number: {text!r}")
    return int(digits) * scale


def number(text: Column) -> Column:
    """:func:`parse_number` of a string column; null for junk."""
    last = F.lower(F.right(text, F.lit(1)))
    scale = F.lit(1)
    for suffix, value in SUFFIXES.items():
        scale = F.when(last == suffix, value).otherwise(scale)
    return F.when(F.length(F.trim(text)) == 0, F.lit(0).cast("long")).otherwise(F.regexp_extract(text, r"^\s*(\d+)[kKmMgG]?\s*$", 1).try_cast("long") * scale)


def _numbers(text: str, kind: type) -> list:
    try:
        return [kind(x) for x in text.split(",")] if text else []
    except ValueError:
        raise ValueError(f"not a list of numbers: {text!r}") from None


def parse_floats(text: str) -> list[float]:
    return _numbers(text, float)


def parse_ints(text: str) -> list[int]:
    return _numbers(text, int)


def parse_dim3(text: str) -> tuple[int, int, int]:
    """Up to three numbers; missing ones are 1, more are ignored."""
    given = [parse_number(x) for x in text.split(",")] if text else []
    return tuple((given + [1, 1, 1])[:3])


def dim3(text: Column) -> Column:
    """Struct ``x, y, z`` of up to three comma-separated numbers with suffixes; missing and empty ones are 1 and 0, as :func:`parse_dim3` has it."""
    parts = F.when(text != "", F.split(text, ","))
    at = lambda i: F.when(F.get(parts, F.lit(i)).isNull(), F.lit(1).cast("long")).otherwise(number(F.get(parts, F.lit(i))))
    return F.when(text.isNotNull(), F.struct(*[at(i).alias(name) for i, name in enumerate("xyz")]))


def item(text: Column, n: int) -> Column:
    """The n-th number, from 0, of a comma-separated column; 1 if there is none."""
    return F.coalesce(F.get(F.split(text, ","), F.lit(n)).try_cast("int"), F.lit(1))


def approx_equal(a: Column, b: Column, epsilon: float = 1e-3) -> Column:
    """Equal, or relatively closer than ``epsilon``."""
    off, scale = F.abs(a - b), F.abs(a) + F.abs(b)
    return (a == b) | ((scale > 0) & (off < epsilon * scale))


def relabel(column: Column, labels: Mapping[str, str]) -> Column:
    """Values found in ``labels`` replaced, others as they are."""
    if not labels:
        return column
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def category(cases: list[tuple[Column, str]], default: str = "other") -> Column:
    """The label of the first predicate that holds."""
    out = F.lit(default)
    for condition, label in reversed(cases):
        out = F.when(condition, label).otherwise(out)
    return out


def floats_per_second(host: Column) -> Column:
    """Memory bandwidth of a host in floats a second, 0 if unknown."""
    out = F.lit(0.0)
    for prefix, gb in BANDWIDTH.items():
        out = F.when(host.startswith(prefix), float(gb * GB / FLOAT_BYTES)).otherwise(out)
    return out


def throughput(points: Column, queries: Column, seconds: Column) -> Column:
    """Distances a second."""
    return points.cast("double") * queries / seconds


def roofline_seconds(points: Column, queries: Column, dim: Column, rate: Column, store_only: bool = False) -> Column:
    """Least time to store all distances (and to load all vectors) at ``rate`` floats a second."""
    stored = points.cast("double") * queries
    return (stored if store_only else (points + queries).cast("double") * dim + stored) / rate


def log2_label(column: Column) -> Column:
    """Rounded binary logarithm, for axes."""
    return F.round(F.log2(column)).cast("int")
