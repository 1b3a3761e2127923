"""Merging Burrows-Wheeler transforms of string collections by iterative interleave refinement.

A collection is a flat array of 16-bit symbols in which every string ends with 0. Its
transform holds, for every rotation of a string in sorted order, the symbol before it. Two or more
transforms are merged without sorting their rotations again: a vector says from
which transform the next rotation comes, and one round of refinement, a stable sort of that
vector by the symbols it points at, makes it right for one symbol more. Where two neighbours
first differ in round r, their common prefix has r - 1 symbols.
"""

from __future__ import annotations

import numpy as np


def shard_transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations (as positions) of one shard of different strings, and the symbol before each."""
    ends = np.flatnonzero(symbols == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.arange(-1, len(symbols) - 1)
    before[starts] = ends
    order = np.arange(len(symbols))
    for _ in range(2 * int((ends - starts).max(initial=0)) + 3):
        moved = before[order]
        moved = moved[np.argsort(symbols[moved], kind="stable")]
        if np.array_equal(moved, order):
            break
        order = moved
    return order, symbols[before[order]]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the rotations of several transforms, by their first ``depth`` symbols.

    Gives the transform each rotation comes from, and the length of the prefix it has in
    common with the rotation before it, ``depth`` where that is at least as long.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    n = len(source)
    common = np.full(n, depth, dtype=np.int32)
    block = np.zeros(n, dtype=np.int64)
    common[:1] = 0
    for done in range(depth):
        laid = np.empty_like(symbols)
        laid[np.argsort(source, kind="stable")] = symbols
        moved = np.argsort(laid, kind="stable")
        source, laid, block = source[moved], laid[moved], block[moved]
        differs = np.ones(n, dtype=bool)
        differs[1:] = (laid[1:] != laid[:-1]) | (block[1:] != block[:-1])
        # A border between neighbours stays in its place: blocks are only ever divided from within.
        common[differs & (common == depth)] = done
        common[:1] = 0
        block = np.cumsum(differs)
    return source, common


def repeated(strings: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """For each shard, whether the ``depth`` symbols from each of its positions on occur elsewhere too,
    in any of the shards. Only positions ``depth`` or more before their string's end count."""
    sorted_shards = [shard_transform(s) for s in strings]
    source, common = merge([t for _, t in sorted_shards], depth)
    alike = common >= depth
    alike[1:] |= False
    twice = alike.copy()
    twice[:-1] |= alike[1:]
    out = []
    for k, (order, _) in enumerate(sorted_shards):
        found = np.zeros(len(order), dtype=bool)
        found[order] = twice[source == k]
        out.append(found)
    return out
