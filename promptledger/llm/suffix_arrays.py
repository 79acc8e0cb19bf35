"""Suffix arrays by induced sorting, and their permuted common prefixes.

The text is an integer array that ends with its only, smallest value.
Suffixes are classified as smaller (S) or larger (L) than their right
neighbour.  The leftmost S suffixes of runs (LMS) are sorted by sorting and
naming the substrings between them; where names repeat, the suffixes of the
text of names are sorted by doubling, which in numpy takes less time than the
recursion's scans element by element.  Then all L suffixes and all S suffixes
are induced from them in one linear scan each: bucket by bucket in numpy on
bytes, element by element on larger alphabets.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1024  # alphabets up to this size are scanned bucket by bucket


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.append(t[:-1] != t[1:], True)
        # Equal neighbours have the type of the first place further right that differs.
        at = np.where(differs, np.arange(n), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        rises = np.append(t[:-1] < t[1:], True)
        out = rises[at]
    return out


def _induce_buckets(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, ends = len(t), np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    t = t.astype(np.uint16)  # numpy sorts short integers by radix

    def placed(p: np.ndarray, at: np.ndarray, forward: bool) -> None:
        """Append each place to its bucket, in order."""
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        count = np.bincount(c, minlength=len(at))
        within = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        if forward:
            sa[at[c] + within] = p
            at += count
        else:
            sa[at[c] - 1 - within] = p
            at -= count

    # LMS suffixes at the ends of their buckets, in the given order.
    tails = ends.copy()
    placed(lms[::-1], tails, False)
    first_lms = tails.copy()
    heads = starts.copy()
    used = np.flatnonzero(sizes)
    for c in used:
        lo = starts[c]
        while lo < heads[c]:  # a run of one value feeds its own bucket
            block = sa[lo : heads[c]]
            lo = heads[c]
            p = block[block > 0] - 1
            placed(p[~small[p]], heads, True)
        block = sa[first_lms[c] : ends[c]]
        p = block[block > 0] - 1
        placed(p[~small[p]], heads, True)
    tails = ends.copy()
    for c in used[::-1]:
        hi = ends[c]
        while hi > tails[c]:
            block = sa[tails[c] : hi][::-1]
            hi = tails[c]
            p = block[block > 0] - 1
            placed(p[small[p]], tails, False)
        block = sa[starts[c] : heads[c]][::-1]
        p = block[block > 0] - 1
        placed(p[small[p]], tails, False)
    return sa


def _induce_elements(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, ends = len(t), np.cumsum(sizes)
    sa = [-1] * n
    tails = ends.tolist()
    for p, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist()):
        tails[c] -= 1
        sa[tails[c]] = p
    # The value left of each place if that place is induced in the scan, else
    # -1; the entry behind the last is for empty slots.  Scans see the slots
    # that they fill ahead of them.
    left = np.concatenate(([-1], t[:-1]))
    left_small = np.concatenate(([False], small[:-1]))
    larger = np.append(np.where(left_small, -1, left), -1).tolist()
    heads = (ends - sizes).tolist()
    for p in sa:
        c = larger[p]
        if c >= 0:
            sa[heads[c]] = p - 1
            heads[c] += 1
    smaller = np.append(np.where(left_small, left, -1), -1).tolist()
    tails = ends.tolist()
    for p in reversed(sa):
        c = smaller[p]
        if c >= 0:
            tails[c] -= 1
            sa[tails[c]] = p - 1
    return np.array(sa, np.int64)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (_induce_buckets if len(sizes) <= _SMALL else _induce_elements)(t, small, lms, sizes)


def _named(t: np.ndarray, small: np.ndarray, places: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring, equal ones alike, listed by place; ``in_order`` is sorted by substring."""
    length = np.full(len(t), 1, np.int64)
    length[places[:-1]] = np.diff(places) + 1  # up to and with the next LMS place
    a, b = in_order[:-1], in_order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        x, y = a[open_] + k, b[open_] + k
        equal = (t[x] == t[y]) & (small[x] == small[y])
        same[open_[~equal]] = False
        open_ = open_[equal & (length[a[open_]] > k + 1)]
        k += 1
    names = np.zeros(len(t), np.int64)
    names[in_order] = np.concatenate(([0], np.cumsum(~same)))
    return names[places]


def _doubled(names: np.ndarray) -> np.ndarray:
    """The places of all suffixes of ``names`` in order, by doubling the sorted length of those still alike."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    rank = np.empty(n, np.int64)  # where the group of suffixes alike so far begins
    alike, at, known = order, np.arange(n), 1
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[alike] = at[new][np.cumsum(new) - 1]
        single = new & np.append(new[1:], True)
        alike, at = alike[~single], at[~single]
        if not len(alike):
            return order
        # A suffix that ends here is the smaller one.
        after = alike + known
        key = rank[alike] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        sort = np.argsort(key)
        alike, key = alike[sort], key[sort]
        order[at] = alike
        known *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The places of all suffixes of ``t`` in order; ``t`` ends with its only smallest value, 0."""
    t = np.asarray(t, np.int64)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = smaller_types(t)
    is_lms = np.concatenate(([False], small[1:] & ~small[:-1]))
    places = np.flatnonzero(is_lms)
    sizes = np.bincount(t)
    by_substring = _induce(t, small, places, sizes)
    in_order = by_substring[is_lms[by_substring]]
    names = _named(t, small, places, in_order)
    if names.max() + 1 < len(places):
        lms = places[_doubled(names)]
    else:
        lms = np.empty_like(places)
        lms[names] = places
    return _induce(t, small, lms, sizes)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """For each place, by place, the common prefix with the suffix before it in order, up to ``most``.

    A place's value is at least its left neighbour's less one, so places are
    walked from left to right, all pieces (``starts``, ``lengths``) side by side.
    """
    before = np.empty(len(t), np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    padded = np.concatenate([t, np.full(most + 1, -1)])  # the end differs from everything before it
    out = np.zeros(len(t), np.int64)
    held = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max()) if len(lengths) else 0):
        alive = np.flatnonzero(lengths > step)
        i = starts[alive] + step
        j = before[i]
        known = np.maximum(held[alive] - 1, 0)
        known[j < 0] = 0
        grow = np.flatnonzero((j >= 0) & (known < most))
        while len(grow):
            same = padded[i[grow] + known[grow]] == padded[j[grow] + known[grow]]
            grow = grow[same]
            known[grow] += 1
            grow = grow[known[grow] < most]
        out[i] = known
        held[alive] = known
    return out
