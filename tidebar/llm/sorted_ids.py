"""Set operations on sorted arrays of distinct ids by galloping, in blocks.

A search that gallops looks ahead from where the last one ended, in steps that double, and then halves the stretch it has
found; so a short list is placed in a long one in time that follows the short one and the logarithm of its gaps. Here a
block of ids gallops at once: its last id bounds the stretch of the other list, its ids are placed inside by binary search.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096


def gallop(ids: np.ndarray, value: int, start: int = 0) -> int:
    """The first place at or after ``start`` whose id is at least ``value``, found with steps that double."""
    step, low, n = 1, start, len(ids)
    while start < n and ids[start] < value:
        low, start, step = start + 1, start + step, 2 * step
    return low + int(np.searchsorted(ids[low:min(start, n)], value))


def places(some: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per id of ``some`` the first place in ``ids`` whose id is at least as large; both are sorted."""
    out, at = np.empty(len(some), np.int64), 0
    for i in range(0, len(some), BLOCK):
        block = some[i:i + BLOCK]
        at = gallop(ids, block[0], at)
        end = gallop(ids, block[-1], at)
        out[i:i + BLOCK] = at + np.searchsorted(ids[at:end], block)
        at = end
    return out


def shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ids that both have; the shorter list gallops through the longer."""
    if len(a) > len(b):
        y, x = shared(b, a)
        return x, y
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = places(a, b)
    x = np.flatnonzero(at < len(b))
    x = x[b[at[x]] == a[x]]
    return x, at[x]


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of a that b does not have."""
    keep = np.ones(len(a), bool)
    keep[shared(a, b)[0]] = False
    return a[keep]


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """The union of k sorted lists: all gallop to the smallest id at which some list has given a block, and what lies
    before it is put in order."""
    lists = [x for x in lists if len(x)]
    if len(lists) < 2:
        return lists[0] if lists else np.zeros(0, np.int64)
    at, out = [0] * len(lists), []
    while lists:
        limit = min(x[min(i + BLOCK, len(x)) - 1] for x, i in zip(lists, at))
        ends = [gallop(x, limit + 1, i) for x, i in zip(lists, at)]
        out.append(np.unique(np.concatenate([x[i:j] for x, i, j in zip(lists, at, ends)])))
        left = [k for k, (x, j) in enumerate(zip(lists, ends)) if j < len(x)]
        lists, at = [lists[k] for k in left], [ends[k] for k in left]
    return np.concatenate(out)
