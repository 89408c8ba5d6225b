"""Metrics between dense vectors, as Column expressions.

A metric is a function of two array columns (point, query).  Sums run left to
right in double precision, so results do not depend on the plan.  Register
others with :func:`register_metric`.

A metric may have a second form, on arrays of many vectors, for products of
many points and queries.  It gives the same distances bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]
_METRICS: dict[str, Metric] = {}


@dataclass(frozen=True)
class Arrays:
    """``block(p, q)``: distances, a row a query, of points ``p`` (a row a component) and queries ``q`` (a row a query).

    It is asked for vectors of one length without nulls whose components satisfy
    ``point`` and ``query``; other pairs are measured by the Column.  ``prepare``
    is applied to both sides' vectors first.
    """

    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    point: Callable[[Column], Column] | None = None
    query: Callable[[Column], Column] | None = None
    prepare: Callable[[Column], Column] | None = None


_ARRAYS: dict[str, Arrays] = {}


def register_metric(name: str, metric: Metric, arrays: Arrays | None = None) -> None:
    if not name:
        raise ValueError("a metric needs a name")
    _METRICS[name] = metric
    _ARRAYS.pop(name, None)
    if arrays is not None:
        _ARRAYS[name] = arrays


@contextmanager
def registered(name: str, metric: Metric, arrays: Arrays | None = None) -> Iterator[None]:
    """The metric has its name while plans are made, and not longer."""
    before = _METRICS.get(name), _ARRAYS.get(name)
    register_metric(name, metric, arrays)
    try:
        yield
    finally:
        del _METRICS[name]
        _ARRAYS.pop(name, None)
        if before[0] is not None:
            register_metric(name, *before)


def arrays(name: str) -> Arrays | None:
    """The metric's form on arrays, if it has one."""
    metric(name)
    return _ARRAYS.get(name)


def metric(name: str) -> Metric:
    try:
        return _METRICS[name]
    except KeyError:
        raise ValueError(f"Unsupported metric {name!r}; known are {', '.join(sorted(_METRICS))}") from None


def metrics() -> list[str]:
    return sorted(_METRICS)


def fold(values: Column) -> Column:
    """Left-to-right sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def squared_norm(x: Column) -> Column:
    return fold(F.transform(x, lambda v: v * v))


def dot(p: Column, q: Column) -> Column:
    return fold(F.zip_with(p, q, lambda a, b: a * b))


def squared_l2(p: Column, q: Column) -> Column:
    return fold(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)))


def partial_l2(p: Column, q: Column) -> Column:
    """Squared L2 less the query's norm: ranks alike, may be negative."""
    return squared_norm(p) - 2.0 * dot(p, q)


def lp(power: int) -> Metric:
    """Sum of absolute differences to the power, without root."""
    if power <= 0:
        raise ValueError("power must be positive")

    def run(p: Column, q: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            off = F.abs(a - b)
            out = off
            for _ in range(power - 1):
                out = out * off
            return out

        return fold(F.zip_with(p, q, term))

    return run


def chebyshev(p: Column, q: Column) -> Column:
    return F.array_max(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of the point from the query; components of zero in the point add nothing."""
    return fold(F.zip_with(p, q, lambda a, b: F.when(a == 0, 0.0).otherwise(a * (F.ln(a) - F.ln(b)))))


# -- forms on arrays -----------------------------------------------------------


def terms(term: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], combine: np.ufunc = np.add) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A block form from ``term(p, q, out)`` of one component, combined left to right from zero; ``out`` may be used for the result."""

    def run(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), p.shape[1]))
        out = np.empty_like(total)
        for a, b in zip(p, q.T):
            combine(total, term(a, b[:, None], out), out=total)
        return total

    return run


def _off(p: np.ndarray, q: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.abs(np.subtract(p, q, out=out), out=out)


def _square(p: np.ndarray, q: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.subtract(p, q, out=out)
    return np.multiply(out, out, out=out)


def _cube(p: np.ndarray, q: np.ndarray, out: np.ndarray) -> np.ndarray:
    off = _off(p, q, out)
    return off * off * off


def _product(p: np.ndarray, q: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.multiply(p, q, out=out)


_dots = terms(_product)


def _partial(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    norm = np.zeros(p.shape[1])
    for a in p:
        norm += a * a
    return norm - 2.0 * _dots(p, q)


def _kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of components with their logarithms behind them."""
    dim = len(p) // 2
    total = np.zeros((len(q), p.shape[1]))
    out = np.empty_like(total)
    for a, log_a, log_b in zip(p[:dim], p[dim:], q[:, dim:].T):
        np.subtract(log_a, log_b[:, None], out=out)
        np.multiply(a, out, out=out)
        total += out
    return total


def _with_logs(x: Column) -> Column:
    return F.concat(x, F.transform(x, lambda v: F.when(v == 0, 0.0).otherwise(F.ln(v))))


_FORMS = {
    "l2": Arrays(terms(_square)),
    "l2_partial": Arrays(_partial),
    "dot": Arrays(_dots),
    "l1": Arrays(terms(_off)),
    "l3": Arrays(terms(_cube)),
    "linf": Arrays(terms(_off, np.maximum)),
    "kl": Arrays(_kl, lambda a: (a >= 0) & (a < float("inf")), lambda b: (b > 0) & (b < float("inf")), _with_logs),
}

for _name, _metric in {
    "l2": squared_l2,
    "l2_partial": partial_l2,
    "dot": dot,
    "l1": lp(1),
    "l3": lp(3),
    "linf": chebyshev,
    "kl": kl,
}.items():
    register_metric(_name, _metric, _FORMS[_name])
