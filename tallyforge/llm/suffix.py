"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of integers.

Suffixes are classified as smaller or larger than the next one; the leftmost-smaller (LMS) substrings are sorted by one
induction, named, and, if names repeat, sorted by the same algorithm on the names; a second induction gives the array.
Every step is linear.  Shards are small (see the callers), so plain lists do.
"""

from __future__ import annotations

import numpy as np


def _induce(values: np.ndarray, smaller: np.ndarray, ends: np.ndarray, lms: list[int]) -> list[int]:
    """The array that ``lms``, in this order within its buckets, induces."""
    n = len(values)
    before = np.concatenate([[-1], values[:-1], [-1]])  # index -1 and 0: nothing before
    small_before = np.concatenate([[False], smaller[:-1], [False]])
    as_large = np.where(small_before, -1, before).tolist()
    as_small = np.where(small_before, before, -1).tolist()
    found = [-1] * n
    symbol = values[lms].tolist()
    tail = ends.tolist()
    for p, c in zip(reversed(lms), reversed(symbol), strict=True):
        tail[c] = at = tail[c] - 1
        found[at] = p
    head = np.concatenate([[0], ends[:-1]]).tolist()
    for j in found:  # grows ahead of the loop
        c = as_large[j]
        if c >= 0:
            at = head[c]
            found[at] = j - 1
            head[c] = at + 1
    tail = ends.tolist()
    for j in reversed(found):
        c = as_small[j]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            found[at] = j - 1
    return found


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``values`` in order.  The last value must be 0, the only one and the smallest."""
    n = len(values)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    step = np.sign(np.diff(values))
    following = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n - 2)[::-1])[::-1]
    smaller = np.concatenate([step[following] > 0, [True]])
    is_lms = np.concatenate([[False], smaller[1:] & ~smaller[:-1]])
    lms = np.flatnonzero(is_lms)
    ends = np.cumsum(np.bincount(values))
    found = np.array(_induce(values, smaller, ends, lms.tolist()))
    order = found[is_lms[found]]
    # Names: equal substrings, from one LMS place up to the next, get equal numbers.
    upto = np.full(n, n)
    upto[lms] = np.append(lms[1:], n - 1) + 1
    raw = values.astype(np.int32).tobytes()
    name, names, last = -1, [], None
    for p, q in zip((4 * order).tolist(), (4 * upto[order]).tolist(), strict=True):
        piece = raw[p:q]
        if piece != last:
            name += 1
            last = piece
        names.append(name)
    if name + 1 < len(lms):
        of = np.zeros(n, dtype=np.int64)
        of[order] = names
        order = lms[suffix_array(of[lms])]
    return np.array(_induce(values, smaller, ends, order.tolist()))


def common_prefixes(values: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For each place, how many values its suffix shares with its predecessor in the array, counted up to ``most``.

    In the order of places ("permuted") this falls by one at most from one to the next, so one pass is linear.
    """
    before = np.full(len(values), -1)
    before[array[1:]] = array[:-1]
    t, out, common = values.tolist(), [], 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            common = 0
        else:
            while common < most and t[i + common] == t[j + common]:
                common += 1
        out.append(common)
        if common:
            common -= 1
    return np.array(out)


def repeated_starts(values: np.ndarray, array: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Mask over ``values``: places of ``starts`` (a mask) whose first ``least`` values also begin at another of them."""
    run = np.cumsum(common_prefixes(values, array, least)[array] < least)  # suffixes that share a prefix stand together
    own = starts[array]
    out = np.zeros(len(values), dtype=bool)
    out[array[own]] = np.bincount(run[own], minlength=len(values) + 1)[run[own]] > 1
    return out
