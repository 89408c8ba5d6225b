"""Algorithm names of the benchmark, each a plan of this engine.

All selections give one result; a name picks metric, physical strategy and
input precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestar.model import KnnSpec
from lodestar.operators.distance import distances
from lodestar.operators.knn import knn_join


@dataclass(frozen=True)
class Algorithm:
    strategy: str
    metric: str = "l2"
    precision: str = "double"
    selects: bool = True


_WINDOW, _FUSED, _RADIUS = Algorithm("group_limit"), Algorithm("fused"), Algorithm("radius")
#: The names.
ALGORITHMS: dict[str, Algorithm] = {
    "serial": Algorithm("sort"),
    "parallel": Algorithm("heap", "l2_partial"),
    "partial-bitonic": _WINDOW,
    "partial-bitonic-warp": _WINDOW,
    "partial-bitonic-warp-static": _WINDOW,
    "partial-bitonic-soa": _WINDOW,
    "partial-bitonic-regs": _WINDOW,
    "partial-bitonic-buffered": _RADIUS,
    "partial-bitonic-buffered-static": _RADIUS,
    "bits": _RADIUS,
    "bits-prefetch": _RADIUS,
    "bits-sq": Algorithm("two_level"),
    "warp-select": _WINDOW,
    "warp-select-tunable": _WINDOW,
    "block-select": _WINDOW,
    "block-select-tunable": _WINDOW,
    "air-topk": Algorithm("radix"),
    "radik": Algorithm("radix"),
    "grid-select": _WINDOW,
    "warpsort": _WINDOW,
    "fused-regs": _FUSED,
    "fused-regs-tunable": _FUSED,
    "fused-cache": Algorithm("fused", "l2_partial"),
    "fused-tc-half": Algorithm("fused", precision="half"),
    "fused-tc-bfloat16": Algorithm("fused", precision="bfloat16"),
    "fused-tc-double": _FUSED,
    "rapidsai-fused": _FUSED,
    "baseline-dist": Algorithm("", selects=False),
    "tiled-dist": Algorithm("", selects=False),
    "cublas-dist": Algorithm("", "l2_partial", selects=False),
    "magma-dist": Algorithm("", selects=False),
    "magma-part-dist": Algorithm("", "l2_partial", selects=False),
    "magma-kl-dist": Algorithm("", "kl", selects=False),
    "cutlass-dist": Algorithm("", selects=False),
}


#: Plans that users added: (points, queries, k) to neighbours, or to distances if it does not select.
CUSTOM: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}


def register_algorithm(name: str, plan: Callable[[DataFrame, DataFrame, int], DataFrame], selects: bool = True) -> None:
    """Make ``plan(points, queries, k)`` available under a name, to :func:`run`, the runner and the command line."""
    if name in ALGORITHMS and name not in CUSTOM:
        raise ValueError(f"algorithm {name!r} is built in")
    CUSTOM[name] = plan
    ALGORITHMS[name] = Algorithm("custom", selects=selects)


@contextmanager
def registered(name: str, plan: Callable[[DataFrame, DataFrame, int], DataFrame], selects: bool = True) -> Iterator[None]:
    """The plan has its name while others are made from it, and not longer."""
    before = CUSTOM.get(name), ALGORITHMS.get(name)
    register_algorithm(name, plan, selects)
    try:
        yield
    finally:
        del CUSTOM[name], ALGORITHMS[name]
        if before[0] is not None:
            CUSTOM[name], ALGORITHMS[name] = before


def run(name: str, points: DataFrame, queries: DataFrame, k: int, deg: int = 8) -> DataFrame:
    """Neighbours, or all distances for a distance-only name."""
    if name not in ALGORITHMS:
        raise ValueError(f"Unsupported algorithm {name!r}")
    if name in CUSTOM:
        return CUSTOM[name](points, queries, k)
    a = ALGORITHMS[name]
    if not a.selects:
        return distances(points, queries, a.metric)
    return knn_join(points, queries, KnnSpec(k, a.metric, a.strategy, deg, a.precision))
