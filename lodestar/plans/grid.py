"""Legal parameters of the named algorithms, for those who want the limits of the original kernels.

No plan here needs them: any positive value works.  :func:`check` raises the
errors that callers of those kernels handle; :func:`legal_at_least` rounds up.
"""

from __future__ import annotations

from dataclasses import dataclass

from lodestar.plans.algorithms import ALGORITHMS


def _doubling(low: int, high: int) -> tuple[int, ...]:
    out = [low]
    while out[-1] < high:
        out.append(2 * out[-1])
    return tuple(out)


@dataclass(frozen=True)
class Grid:
    """Legal values of a family; empty: any.

    ``items`` has (values, what an error calls them) for each of the three items
    a thread, ``deg`` the same for the degree.  ``dim_multiple``: vectors need as
    many dimensions as the third item times the degree.
    """

    k: tuple[int, ...] = ()
    most_k: int | None = None
    block_size: tuple[int, ...] = ()
    block_name: str = "block size"
    items: tuple[tuple[tuple[int, ...], str], ...] = ()
    deg: tuple[tuple[int, ...], str] = ((), "")
    dim_multiple: bool = False


_K, _FUSED_K = _doubling(16, 2048), _doubling(4, 256)
_QUEUES = ((tuple(range(2, 11)), "thread queue size"),)
_BATCHES = ((tuple(range(1, 17)), "batch size"),)
_BITONIC = (64, 128, 256, 512)
#: The grid of each family, by the beginning of its names (longest first).
GRIDS = {
    "bits": Grid(_K, block_size=(128, 256, 512), items=_BATCHES),
    "partial-bitonic": Grid(_K),
    "partial-bitonic-warp-static": Grid(_K, block_size=_BITONIC),
    "partial-bitonic-soa": Grid(_K, block_size=_BITONIC),
    "partial-bitonic-regs": Grid(_K, block_size=_BITONIC),
    "partial-bitonic-buffered-static": Grid(_K, block_size=(128, 256, 512)),
    "warp-select": Grid(_K, block_size=(64, 128), items=_QUEUES),
    "block-select": Grid(_K, block_size=(64, 128), items=_QUEUES),
    "fused-regs": Grid(_doubling(4, 128)),
    "fused-regs-tunable": Grid(_FUSED_K, block_size=(4, 8, 16), items=(((2, 4, 8), "query register count"), ((4,), "point register count"))),
    "fused-cache": Grid(
        _FUSED_K,
        block_size=(1, 2, 4),
        block_name="query_block_size value",
        items=(((2, 4, 8, 16), "queries_reg value"), ((4, 8, 16), "db_reg value"), ((1, 2, 4), "dim_reg value")),
        deg=((1, 2, 4), "dim_mult value"),
        dim_multiple=True,
    ),
    "fused-tc": Grid(_FUSED_K, block_size=(128, 256, 512)),
    "rapidsai-fused": Grid(most_k=64),
    "tiled-dist": Grid(block_size=(8, 16, 32), block_name="tile size"),
}


def grid_of(name: str) -> Grid:
    if name not in ALGORITHMS:
        raise ValueError(f"Unsupported algorithm {name!r}")
    found = [f for f in GRIDS if name.startswith(f)]
    return GRIDS[max(found, key=len)] if found else Grid()


def check(name: str, k: int, block_size: int | None = None, items: int | tuple[int, ...] | None = None, deg: int | None = None, dim: int | None = None) -> None:
    """An error for a value that the algorithm's kernel does not have; parameters left out are not checked."""
    grid = grid_of(name)
    if (grid.k and k not in grid.k) or (grid.most_k is not None and k > grid.most_k):
        raise ValueError(f"Unsupported k value: {k}")
    if block_size is not None and grid.block_size and block_size not in grid.block_size:
        raise ValueError(f"Unsupported {grid.block_name}: {block_size}")
    given = () if items is None else (items,) if isinstance(items, int) else items
    for value, (legal, what) in zip(given, grid.items):
        if value not in legal:
            raise ValueError(f"Unsupported {what}: {value}")
    if deg is not None and grid.deg[0] and deg not in grid.deg[0]:
        raise ValueError(f"Unsupported {grid.deg[1]}: {deg}")
    if grid.dim_multiple and None not in (dim, deg) and len(given) == 3 and dim < given[2] * deg:
        raise ValueError(f"Dimension of vectors must not be lower than {given[2] * deg}, but is {dim}")


def legal_at_least(value: int, legal: tuple[int, ...]) -> int:
    """The smallest legal value that is no smaller; an error if there is none."""
    for x in sorted(legal):
        if value <= x:
            return x
    raise ValueError(f"Unsupported value: {value}")
