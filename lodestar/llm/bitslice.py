"""Hamming distances on vertically stored bit planes.

64 fingerprints share one machine word per bit position (a bit plane).  XORing
planes of two sides gives, plane by plane, the differing bits of 64 pairs at
once; carry-save counters, themselves bit planes, add them up without leaving
bitwise operations.  A counter that passes its top bit is stuck in ``over``.
Every few planes the words whose 64 pairs are all beyond the radius are
abandoned.
"""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes between two looks for words to abandon.
LOOK_EVERY = 8
#: Blocks up to this size are compared at once with many others.
SMALL = 64
#: Words compared at once in a larger block, about; and queries at least.
WORDS, QUERIES = 8192, 32


def to_planes(values: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words; bit i of word w of plane p is bit p of value 64 w + i."""
    n = len(values)
    padded = np.zeros(-(-max(n, 1) // 64) * 64, np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _beyond(ones: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius: a bitwise comparison from the top bit."""
    greater, equal = over.copy(), ~over
    for b in reversed(range(len(ones))):
        if radius >> b & 1:
            equal &= ones[b]
        else:
            greater |= equal & ones[b]
            equal &= ~ones[b]
    return greater


def close_lanes(plane, words: int, radius: int) -> np.ndarray:
    """Words whose set bits are the pairs at ``radius`` differing bits or fewer.

    ``plane(p, active)`` gives plane p of the XOR of both sides for the words
    ``active``.
    """
    bits = max(1, radius.bit_length())
    active = np.arange(words)
    counter = [np.zeros(words, np.uint64) for _ in range(bits)]
    over = np.zeros(words, np.uint64)
    for p in range(64):
        carry = plane(p, active)
        for b in range(bits):
            carry, counter[b] = counter[b] & carry, counter[b] ^ carry
        over |= carry
        if p % LOOK_EVERY == LOOK_EVERY - 1 and p < 63:
            alive = _beyond(counter, over, radius) != ALL
            kept = int(alive.sum())
            if not kept:
                return np.zeros(words, np.uint64)
            if kept < 0.8 * len(active):
                active, over, counter = active[alive], over[alive], [c[alive] for c in counter]
    out = np.zeros(words, np.uint64)
    out[active] = ~_beyond(counter, over, radius)
    return out


def lanes_of(words: np.ndarray, n: int) -> np.ndarray:
    """Indices below n whose bit is set."""
    hit = np.flatnonzero(words)
    if not len(hit):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(words[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, i = np.nonzero(bits)
    found = hit[w] * 64 + i
    return found[found < n]


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int):
    """Yield arrays (i, j) of all pairs within a group that differ in ``radius`` bits at most.

    ``groups`` must be sorted.  Small groups are compared together, each value
    with the one ``shift`` places on; larger ones query by query against the
    group's planes.
    """
    if len(values) < 2:
        return
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
    if len(small):
        v, g, s = values[small], groups[small], size_of[small]
        for shift in range(1, int(s.max())):
            left = np.flatnonzero(g[:-shift] == g[shift:]) if shift < len(g) else np.zeros(0, np.int64)
            if not len(left):
                break
            planes = to_planes(v[left] ^ v[left + shift])
            hit = left[lanes_of(close_lanes(lambda p, a: planes[p][a], planes.shape[1], radius), len(left))]
            if len(hit):
                yield small[hit], small[hit + shift]
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        block = values[start : start + size]
        planes = to_planes(block)
        words = planes.shape[1]
        some = max(QUERIES, WORDS // words)
        for at in range(0, size, some):
            queries = block[at : at + some]
            first = at // 64  # earlier words were compared when they were queries
            span = words - first
            row = np.repeat(np.arange(len(queries)), span)
            column = np.tile(np.arange(first, words), len(queries))

            def plane(p, active, row=row, column=column, queries=queries):
                flip = np.uint64(0) - (queries >> np.uint64(p) & np.uint64(1))
                return planes[p][column[active]] ^ flip[row[active]]

            found = close_lanes(plane, len(row), radius)
            for q in np.unique(row[np.flatnonzero(found)]).tolist():
                other = first * 64 + lanes_of(found[q * span : (q + 1) * span], size - first * 64)
                other = other[other > at + q]
                if len(other):
                    yield np.full(len(other), start + at + q), start + other


def spanning_edges(values: np.ndarray, groups: np.ndarray, radius: int, also=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places) of a spanning forest of the graph of close pairs: as connected, fewer than values.

    ``also(i, j)`` may test found pairs further; it returns which of them count.
    """
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    a, b = [], []
    # Roots as of the last look: pairs within one component need not be looked at again.
    label, joined = parent.copy(), 0
    for left, right in close_pairs(values, groups, radius):
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        if also is not None and len(left):
            ok = also(left, right)
            left, right = left[ok], right[ok]
        if len(left) > 1 and left[0] == left[-1]:  # one query: one partner of each component is enough
            _, one = np.unique(label[right], return_index=True)
            left, right = left[one], right[one]
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
        if len(a) - joined > 64 + len(values) // 256:
            joined = len(a)
            while (label := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = label
            label = parent.copy()
    return np.array(a, np.int64), np.array(b, np.int64)
