"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (lower-cased, punctuation counting as blank) has a row in each of three
embedding tables, chosen by hashes of the word and of its first four and six
bytes, so that other endings of a known stem are known, too.  Filters of several widths slide over the words, each is
rectified and pooled by its maximum over the whole text, and a linear layer
gives the logit.  Everything is trained in numpy, by Adagrad, on all labelled
rows: in ``ROUNDS``, in which each shard of them takes ``EPOCHS`` passes and
the results are averaged (``features.improved``).  Rows of the tables that fewer than ``LEAST_TEXTS`` training texts
use stay zero, so unknown words say nothing.

*Thresholds by language.*  One of ``REST`` training ids is not learned from: all
these rows give a threshold and a temperature; where enough of them are in one
language, told by its most frequent words (never by a column), that language
has a threshold of its own.  A score is the calibrated probability moved so
that the threshold of the text's language is at 0.5.

Defined cases: null and empty texts are scored like a text of blanks; rows
without an id are scored and never learned from; a score depends on the text
only, so repeated rows score alike; without labelled rows of both classes every
score is 0; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import dropped, table
from .features import SCORED, held_out, improved, labelled, logit_counts, scored_batch, sharded, softened, step_logits, temperature, totals
from .shingles import word_hashes

ROWS, SIDE, WIDTHS, FILTERS, BATCH = 1 << 16, 6, (1, 2, 3), 8, 32
ROUNDS, EPOCHS, REST = 4, 2, 4
WORDS = 60_000  # words of texts that are taken together; a longer text is pooled in pieces of so many
THRESHOLD = 0.5
HEADS, LEAST_TEXTS = (4, 6), 4
LEAST_OF_LANGUAGE = 40  # held-back rows of each label that a language needs for a threshold of its own

# Frequent words that tell languages apart.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "with", "for"),
    "de": ("der", "die", "und", "das", "ist", "von", "mit", "für"),
    "fr": ("le", "les", "des", "est", "une", "dans", "avec", "pour"),
    "es": ("el", "los", "las", "por", "una", "con", "del", "como"),
}
LANGUAGES = (*COMMON_WORDS, "other")

_BLANK = string.punctuation.encode()
_PAD = max(WIDTHS)
_OUT = sum(WIDTHS) * FILTERS
_TABLES = 1 + len(HEADS)


def _word_lists(texts: Sequence[str | None]) -> list[np.ndarray]:
    return list(word_hashes(texts, _BLANK, HEADS))


_COMMON = {name: np.sort(np.concatenate(list(word_hashes(words)))) for name, words in COMMON_WORDS.items()}


def languages(held: Sequence[np.ndarray]) -> np.ndarray:
    """The number of each text's language in ``LANGUAGES``."""
    ends = np.cumsum([0, *(h.shape[1] for h in held)])
    every = np.concatenate([*(h[0] for h in held), np.zeros(0, np.uint64)])
    counts = np.zeros((len(LANGUAGES), len(held)))
    for k, known in enumerate(_COMMON.values()):
        hits = np.concatenate(([0], np.cumsum(np.isin(every, known))))
        counts[k] = hits[ends[1:]] - hits[ends[:-1]]
    counts[-1] = 0.5
    return counts.argmax(0)


class Convolution:
    """Embedding tables, filters and output layer; gradients reach only what the maxima chose."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.tables = [np.zeros((ROWS + 1, SIDE), np.float32) for _ in range(_TABLES)]  # the last row is the pad
        # Filters side by side: for each width, and each place in it, FILTERS columns.
        self.filters = (rng.standard_normal((_TABLES * SIDE, _OUT)) * 0.5).astype(np.float32)
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.temperature = 1.0
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def __getstate__(self) -> dict:
        """Of the tables only rows that are not zero: few are, and the network travels to every task."""
        used = [np.flatnonzero(t.any(1)) for t in self.tables]
        return {**self.__dict__, "tables": [(u, t[u]) for u, t in zip(used, self.tables)]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.tables = [np.zeros((ROWS + 1, SIDE), np.float32) for _ in range(_TABLES)]
        for table_, (used, values) in zip(self.tables, state["tables"]):
            table_[used] = values

    @staticmethod
    def _places(held: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of each table for all texts with pads behind each; each text's first place and its length with one pad."""
        pad = np.zeros((_TABLES, _PAD), np.uint64)
        rows = (np.concatenate([x for h in held for x in (h, pad)], axis=1) & np.uint64(ROWS - 1)).astype(np.int64)
        padded = np.array([h.shape[1] + _PAD for h in held])
        starts = np.cumsum(padded) - padded
        for k in range(_PAD):
            rows[:, starts + padded - 1 - k] = ROWS
        return rows, starts, padded - _PAD + 1

    def _slide(self, rows: np.ndarray) -> np.ndarray:
        """Filter values at every place, all widths side by side."""
        one = rows[0]
        seen = np.concatenate([t[r] for t, r in zip(self.tables, rows)], axis=1) @ self.filters
        out = np.zeros((len(one), len(WIDTHS) * FILTERS), np.float32)
        column = 0
        for k, width in enumerate(WIDTHS):
            mine = out[:, k * FILTERS : (k + 1) * FILTERS]
            for place in range(width):
                mine[: len(one) - place] += seen[place:, column : column + FILTERS]
                column += FILTERS
        return out

    def _pooled(self, held: Sequence[np.ndarray]) -> np.ndarray:
        rows, starts, lengths = self._places(held)
        bounds = np.stack([starts, starts + lengths], 1).ravel()
        return np.maximum.reduceat(self._slide(rows), bounds[:-1], axis=0)[::2]

    def _piece(self, words: np.ndarray, last: bool) -> np.ndarray:
        """Of a long text: windows that reach over the end of a piece are the next piece's."""
        rows, _, lengths = self._places([words])
        return self._slide(rows)[: lengths[0] if last else words.shape[1] - _PAD].max(0)

    def logits(self, held: Sequence[np.ndarray], words: int = WORDS) -> np.ndarray:
        """Texts are taken together up to a number of words; a longer one is pooled piece by piece."""
        out, group, size = np.zeros(len(held), np.float32), [], 0

        def flush() -> None:
            if group:
                out[group] = np.maximum(0, self._pooled([held[i] for i in group]) + self.bias) @ self.out + self.offset[0]
                group.clear()

        for i, h in enumerate(held):
            n = h.shape[1]
            if n > words:
                parts = [self._piece(h[:, a : a + words], a + words >= n) for a in range(0, n - _PAD, words - _PAD)]
                out[i] = np.maximum(0, np.max(parts, axis=0) + self.bias) @ self.out + self.offset[0]
                continue
            if size + n > words:
                flush()
                size = 0
            group.append(i)
            size += n + _PAD
        flush()
        return out

    def state(self) -> np.ndarray:
        """All that is learned, in rows of ``SIDE`` numbers, and beside them Adagrad's sums of squares, not begun."""
        parts = [*self.tables, self.filters, self.bias, self.out, self.offset]
        rows = np.concatenate([np.append(p, np.zeros(-p.size % SIDE, np.float32)).reshape(-1, SIDE) for p in parts])
        return np.concatenate([rows, np.full_like(rows, 1e-3)], axis=1)

    def _views(self, side: np.ndarray) -> list[np.ndarray]:
        """``side`` of a state, as tables, filters, bias, output and offset."""
        out, at = [], 0
        for p in (*self.tables, self.filters, self.bias, self.out, self.offset):
            n = -(-p.size // SIDE)
            out.append(np.ascontiguousarray(side[at : at + n]).ravel()[: p.size].reshape(p.shape).astype(np.float32))
            at += n
        return out

    def take(self, state: np.ndarray) -> None:
        *self.tables, self.filters, self.bias, self.out, self.offset = self._views(state[:, :SIDE])

    def _best(self, held: Sequence[np.ndarray], rare: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's maxima, and the rows of each table in the window of each: ``(text, filter), (table, text, filter, place)``."""
        tops, windows = [], []

        def seen(texts: Sequence[np.ndarray], upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
            rows, starts, lengths = self._places(texts)
            for own_rows, few in zip(rows, rare):
                own_rows[few[own_rows]] = ROWS
            slid = self._slide(rows)
            at = np.stack([s + slid[s : s + (upto or n)].argmax(0) for s, n in zip(starts, lengths)])
            return slid[at, np.arange(slid.shape[1])], rows[:, at[..., None] + np.arange(_PAD)]

        group: list[np.ndarray] = []
        for h in [*held, None]:
            if group and (h is None or sum(g.shape[1] + _PAD for g in group) + h.shape[1] > WORDS):
                top, window = seen(group)
                tops.append(top)
                windows.append(window)
                group = []
            if h is None:
                break
            n = h.shape[1]
            if n <= WORDS:
                group.append(h)
                continue
            best = None
            for a in range(0, n - _PAD, WORDS - _PAD):
                last = a + WORDS >= n
                top, window = seen([h[:, a : a + WORDS]], None if last else WORDS - _PAD)
                if best is None:
                    best = top, window
                else:
                    more = top > best[0]
                    best = np.where(more, top, best[0]), np.where(more[None, :, :, None], window, best[1])
            tops.append(best[0])
            windows.append(best[1])
        return np.concatenate(tops), np.concatenate(windows, axis=1)

    def learn(self, state: np.ndarray, held: Sequence[np.ndarray], y: np.ndarray, rare: Sequence[np.ndarray], seed: int) -> np.ndarray:
        """``state`` after ``EPOCHS`` passes over texts and labels."""
        rng = np.random.default_rng(seed)
        self.take(state)
        *table_squares, filter_squares, bias_squares, out_squares, offset_squares = self._views(state[:, SIDE:])

        def move(p: np.ndarray, s: np.ndarray, g: np.ndarray, rate: float = 0.05) -> None:
            s += g * g
            p -= rate * g / np.sqrt(s)

        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                top, windows = self._best([held[i] for i in part], rare)
                active = np.maximum(0, top + self.bias)
                error = (softened(active @ self.out + self.offset[0]) - y[part]).astype(np.float32) / len(part)
                back = np.outer(error, self.out) * (active > 0)
                g_filters = np.zeros_like(self.filters)
                touched: list[list] = [[] for _ in range(_TABLES)]
                column = 0
                for k, width in enumerate(WIDTHS):
                    mine = slice(k * FILTERS, (k + 1) * FILTERS)
                    b = back[:, mine].ravel()
                    which = np.tile(np.arange(FILTERS), len(part))
                    for place in range(width):
                        columns = column + which
                        for side in range(_TABLES):
                            r = windows[side, :, mine, place].ravel()
                            lo = side * SIDE
                            grad = np.zeros((_OUT, SIDE), np.float32)
                            np.add.at(grad, columns, b[:, None] * self.tables[side][r])
                            g_filters[lo : lo + SIDE] += grad.T
                            touched[side].append((r, b[:, None] * self.filters[lo : lo + SIDE, columns].T))
                        column += FILTERS
                for side in range(_TABLES):
                    grads = np.concatenate([t[1] for t in touched[side]])
                    used, where = np.unique(np.concatenate([t[0] for t in touched[side]]), return_inverse=True)
                    g = np.zeros((len(used), SIDE), np.float32)
                    np.add.at(g, where, grads)
                    g[used == ROWS] = 0
                    s = table_squares[side]
                    s[used] += g * g
                    self.tables[side][used] -= 0.1 * g / np.sqrt(s[used])
                move(self.out, out_squares, active.T @ error)
                move(self.offset, offset_squares, error.sum(keepdims=True))
                move(self.bias, bias_squares, back.sum(0))
                move(self.filters, filter_squares, g_filters)
        after = self.state()
        squares = [*table_squares, filter_squares, bias_squares, out_squares, offset_squares]
        after[:, SIDE:] = np.concatenate([np.append(s, np.full(-s.size % SIDE, 1e-3, np.float32)).reshape(-1, SIDE) for s in squares])
        return after

    def fit(self, rows: DataFrame) -> None:
        """Learn from all rows of ``features.sharded``, encoded by ``_encoded``."""
        own = rows.where("not rest")

        def texts(xs: list[bytes], ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = np.zeros((_TABLES, ROWS), np.int64)
            for x in xs:
                for k, used in enumerate(_decoded(x)[1]):
                    n[k, np.unique(used)] += 1
            n = n.ravel()
            used = np.flatnonzero(n)
            return used, n[used, None]

        # A row that few texts use stays zero: its words are read as pads.
        rows_used, n = totals(own, 1, texts)
        often = np.sort(rows_used[n[:, 0] >= LEAST_TEXTS])
        state = self.state()
        # Only rows that can move travel.
        moving = np.concatenate([often + often // ROWS, np.arange(_TABLES * (ROWS + 1), len(state))])

        def learned(begun: np.ndarray, xs: list[bytes], ys: np.ndarray, seed: int) -> np.ndarray:
            network = Convolution()
            whole = network.state()
            whole[moving] = begun
            rare = np.ones(_TABLES * (ROWS + 1), bool)
            rare[moving[: len(often)]] = False
            rare = rare.reshape(_TABLES, ROWS + 1)
            rare[:, ROWS] = False
            return network.learn(whole, [_decoded(x)[1] for x in xs], ys, rare, seed)[moving]

        for turn in range(ROUNDS):
            state[moving] = improved(own, state[moving], lambda begun, xs, ys, seed=9 + turn: learned(begun, xs, ys, seed))
        self.take(state)
        self._calibrate(rows.where("rest"))

    def _calibrate(self, rows: DataFrame) -> None:
        def scored(xs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            spoken, held = zip(*(_decoded(x) for x in xs))
            return np.array(spoken), self.logits(held)

        counts = logit_counts(rows, len(LANGUAGES), scored)
        self.thresholds[:] = _threshold(counts.sum(0))
        for k, mine in enumerate(counts):
            if mine.sum(1).min() >= LEAST_OF_LANGUAGE:
                self.thresholds[k] = _threshold(mine)
        spoken, y, at = np.nonzero(counts)
        self.temperature = temperature(step_logits()[at] - self.thresholds[spoken], y, counts[spoken, y, at])

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        held = _word_lists(texts)
        if not held:
            return np.zeros(0)
        return softened((self.logits(held) - self.thresholds[languages(held)]) * self.temperature)


def _threshold(counts: np.ndarray) -> float:
    """Where F1 is best, in the middle of the widest such gap; ``counts`` has the rows of label 0 and 1 by step of logit."""
    steps = np.flatnonzero(counts.sum(0))[::-1]
    hits = np.cumsum(counts[1, steps])
    f1 = 2 * hits / (np.cumsum(counts[:, steps].sum(0)) + max(1, counts[1].sum()))
    z = step_logits()[steps]
    gap = np.append(z[:-1] - z[1:], 0)
    best = np.flatnonzero((f1 >= f1.max(initial=0) - 1e-9) & (gap > 0))
    if not len(best):
        return 0.0
    k = best[np.argmax(gap[best])]
    return float((z[k] + z[k + 1]) / 2)


def _encoded(texts: list[str]) -> list[bytes]:
    """Of each text the number of its language, then the rows of its words in each table."""
    held = _word_lists(texts)
    low = np.uint64(ROWS - 1)
    return [np.append(np.uint16(k), (h & low).astype(np.uint16).ravel()).tobytes() for k, h in zip(languages(held), held)]


def _decoded(raw: bytes) -> tuple[int, np.ndarray]:
    x = np.frombuffer(raw, np.uint16)
    return int(x[0]), x[1:].reshape(_TABLES, -1)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Convolution | None:
    """The trained network; none where a class has no labelled row."""
    rows = sharded(labelled(docs, labels, label, REST), _encoded)
    if rows is None:
        return None
    network = Convolution()
    network.fit(rows)
    dropped(rows)
    return network


def score_toxicity(docs: DataFrame, network: Convolution | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The network, at most 5 MB whatever the data, travels with the function.
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield scored_batch(batch, network.score(texts) if network else np.zeros(len(texts)), threshold)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCORED)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and prediction of toxicity for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
