"""What a run of rows makes of any spend it starts with.

A row with limit ``l`` and cost ``c`` maps a spend ``s`` to ``s + c`` where
``s <= l`` and leaves it where not.  A run of rows is a step function of the
same kind: pieces of the line of spends, each with what it adds.  Two runs are
composed by cutting the pieces of the first where their images meet a border
of the second; neighbours that add the same become one piece.  Runs are
composed pairwise, level by level, all pairs of a level in one pass over
arrays.

Only whole numbers are used (micro-dollars), and costs are not negative.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

NO_LIMIT = 2**62
_END = 2**62
_BLOCK = 1 << 16  # rows that one pairwise composition starts from


class Steps(NamedTuple):
    """Spends from ``start[k]`` up to the next start grow by ``add[k]``; the first start is the lowest spend."""

    start: np.ndarray
    add: np.ndarray

    def __call__(self, spend: int) -> int:
        return spend + int(self.add[np.searchsorted(self.start, spend, side="right") - 1])

    def within(self, low: int, high: int) -> Steps:
        """The pieces that spends from ``low`` to ``high`` meet."""
        i, j = np.searchsorted(self.start, [low, high], side="right")
        return Steps(self.start[max(0, i - 1) : j], self.add[max(0, i - 1) : j])


def of_rows(cost: np.ndarray, limit: np.ndarray, low: int) -> Steps:
    """The step function of rows in order, for spends of at least ``low``."""
    # Rows without a limit add their cost whatever the spend is: they move the
    # limits of the rows behind them instead of taking part.
    free = np.where(limit >= NO_LIMIT, cost, 0)
    moved = np.cumsum(free)
    tight = limit - moved
    some = (limit < NO_LIMIT) & (cost > 0) & (tight >= low)
    cost, tight = cost[some], tight[some]
    done = Steps(np.array([low]), np.array([0]))
    if len(cost):
        top = int(tight.max()) + int(cost.max()) + 2
        size = max(1, min(_BLOCK, 2**61 // (top - low + 1)))
        for k in range(0, len(cost), size):
            done = _composed([done, _of_block(cost[k : k + size], tight[k : k + size], low, top)], low, top)
    return Steps(done.start, done.add + (int(moved[-1]) if len(moved) else 0))


def _of_block(cost: np.ndarray, limit: np.ndarray, low: int, top: int) -> Steps:
    n = len(cost)
    start, add = np.empty(2 * n, np.int64), np.zeros(2 * n, np.int64)
    start[0::2], start[1::2], add[0::2] = low, limit + 1, cost
    of = np.repeat(np.arange(n), 2)
    while n > 1:
        start, add, of = _halved(start, add, of, n, low, top)
        n -= n // 2
    return Steps(start, add)


def _composed(runs: list[Steps], low: int, top: int) -> Steps:
    of = np.repeat(np.arange(len(runs)), [len(r.start) for r in runs])
    start, add, _ = _halved(np.concatenate([r.start for r in runs]), np.concatenate([r.add for r in runs]), of, len(runs), low, top)
    return Steps(start, add)


def _halved(start: np.ndarray, add: np.ndarray, of: np.ndarray, n: int, low: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compose function 0 with 1, 2 with 3 and so on; a last one without a partner stays.

    ``of`` is the function of each piece; all are defined from ``low`` to below ``top`` and stay there.
    """
    pairs, span = n // 2, top - low + 1
    one, two = (of % 2 == 0) & (of < 2 * pairs), of % 2 == 1
    s1, a1, f1 = start[one], add[one], of[one] // 2
    s2, a2, f2 = start[two], add[two], of[two] // 2
    end = np.append(s1[1:], top)
    end[np.append(f1[1:] != f1[:-1], True)] = top
    # The pieces of the second function that the image of a piece of the first meets.
    place = f2 * span + (s2 - low)
    lo = np.searchsorted(place, f1 * span + (s1 + a1 - low), side="right") - 1
    hi = np.searchsorted(place, f1 * span + (end - 1 + a1 - low), side="right")
    many = hi - lo
    piece = np.repeat(np.arange(len(s1)), many)
    met = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many) + lo[piece]
    s, a, f = np.maximum(s1[piece], s2[met] - a1[piece]), a1[piece] + a2[met], f1[piece]
    new = np.append(True, (a[1:] != a[:-1]) | (f[1:] != f[:-1]))
    s, a, f = s[new], a[new], f[new]
    if n % 2:
        left = of == n - 1
        s, a, f = np.append(s, start[left]), np.append(a, add[left]), np.append(f, np.full(left.sum(), pairs))
    return s, a, f


class Outline(NamedTuple):
    """Bounds of a step function over runs of its pieces: what they add at least and most, and where they lead."""

    start: np.ndarray
    add_low: np.ndarray
    add_high: np.ndarray
    to_low: np.ndarray
    to_high: np.ndarray

    def __call__(self, low: int, high: int) -> tuple[int, int]:
        """Between which spends the function leads from any spend between ``low`` and ``high``."""
        i, j = np.searchsorted(self.start, [low, high], side="right") - 1
        part = slice(max(0, i), j + 1)
        begin = np.maximum(self.start[part], low)
        end = np.minimum(np.append(self.start[1:], _END)[part] - 1, high)
        return (
            int(np.maximum(self.to_low[part], begin + self.add_low[part]).min()),
            int(np.minimum(self.to_high[part], end + self.add_high[part]).max()),
        )


def outline(steps: Steps, parts: int = 256) -> Outline:
    """At most ``parts`` runs of equally many pieces."""
    at = np.arange(0, len(steps.start), -(-len(steps.start) // parts))
    to = steps.start + steps.add
    upto = np.append(steps.start[1:] - 1, _END) + steps.add
    return Outline(
        steps.start[at], np.minimum.reduceat(steps.add, at), np.maximum.reduceat(steps.add, at),
        np.minimum.reduceat(to, at), np.maximum.reduceat(upto, at),
    )
