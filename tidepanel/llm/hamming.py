"""Vantage-point trees over blocks of a fingerprint; links within a Hamming radius inside one shard or leaf."""

from __future__ import annotations

import numpy as np

#: Vantage points of a block's tree: level k splits by the distance to the k-th.
VANTAGES = (0x000, 0x7FF, 0x0F3, 0x555, 0x1E9, 0x26B, 0x39C, 0x4B5)


def leaf_numbers(width: int) -> np.ndarray:
    """The leaf of each block of ``width`` bits in the vantage-point tree: blocks that branch alike at each level."""
    blocks, mask = np.arange(1 << width), (1 << width) - 1
    away = np.stack([np.bitwise_count(blocks ^ (v & mask)) for v in VANTAGES], axis=1)
    return np.unique(away, axis=0, return_inverse=True)[1].reshape(-1)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Differing bits of each row (n x words, uint64) and one point."""
    return np.bitwise_count(rows ^ point).sum(axis=1, dtype=np.int64)


def near_roots(rows: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints (n x words), the index of the first of its linked set.

    Vantage points are taken one after the other from the rows not yet covered;
    each covers all rows within ``radius``, which are linked to it. Two covers
    can hold a link only if their balls, widened by ``radius``, overlap (triangle
    bound); only those boundary-overlapping covers are compared, and only until
    one link joins them. A tight group of g rows so costs g comparisons for each
    of its covers, not g squared, and no pair is emitted.
    """
    n = len(rows)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)

    left = np.arange(n)
    centres: list[int] = []
    members: list[np.ndarray] = []
    reach: list[int] = []
    while len(left):
        away = distances(rows[left], rows[left[0]])
        inside = away <= radius
        own = left[inside]
        centres.append(int(left[0]))
        members.append(own)
        reach.append(int(away[inside].max()))
        parent[own] = left[0]
        left = left[~inside]
    at, wide = rows[centres], np.array(reach)
    for k in np.flatnonzero(wide > 0):
        gap = distances(at, at[k]) - wide
        for other in np.flatnonzero(gap <= radius + wide[k]):
            if other == k or (wide[other] > 0 and other < k):
                continue
            if find(centres[k]) == find(centres[other]):
                continue
            if _touch(rows, members[k], members[other], at[other], radius, int(wide[other])):
                join(centres[k], centres[other])
    return np.array([find(i) for i in range(n)])


def star_within(rows: np.ndarray, radius: int, part: np.ndarray, asks: np.ndarray,
                sizes: np.ndarray, ratio: tuple[int, int]) -> list[tuple[int, int]]:
    """Index pairs that join the parts of one leaf (n x words) which hold rows within the radius.

    A row that asks is held against every other; rows whose sizes are further apart than ``ratio``
    don't link. A row sends on one pair for each part it joins to its own, so there are fewer pairs than rows.
    """
    part, found = part.copy(), []
    asking = np.flatnonzero(asks)
    step = max(1, (1 << 15) // len(rows))
    for start in range(0, len(asking), step):
        block = asking[start:start + step]
        near = np.bitwise_count(rows[block][:, None] ^ rows[None]).sum(axis=2, dtype=np.uint16) <= radius
        near[np.arange(len(block)), block] = False
        for k in np.flatnonzero(near.any(axis=1)):
            i = block[k]
            there = np.flatnonzero(near[k] & (part != part[i]) & (
                ratio[1] * np.minimum(sizes, sizes[i]) >= ratio[0] * np.maximum(sizes, sizes[i])))
            if len(there):
                joined, first = np.unique(part[there], return_index=True)
                found += [(int(i), int(there[f])) for f in first]
                part[np.isin(part, joined)] = part[i]
    return found


def _touch(rows: np.ndarray, some: np.ndarray, others: np.ndarray, centre: np.ndarray,
           radius: int, reach: int) -> bool:
    """Whether any of ``some`` is within the radius of any of ``others``."""
    some = some[distances(rows[some], centre) <= radius + reach]
    step = max(1, (1 << 22) // max(1, len(others)))
    for start in range(0, len(some), step):
        block = rows[some[start:start + step], None, :] ^ rows[None, others, :]
        if (np.bitwise_count(block).sum(axis=2, dtype=np.int64) <= radius).any():
            return True
    return False
