"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

*Word vectors.*  Every word form falls into one of ``FORMS`` hashed forms.  A
form is the word's shape (its case, its punctuation at either end, whether it
repeats the word before it) with, for words of the plain shape, a hash of its
letters.  Each form has a sparse random index vector that follows from its
number; a form's vector is the sum of the index vectors of the forms next to
it, over all documents, scaled by the form's count.  The sums are made in
every task and added up by Spark, so what is gathered has a fixed size however
large the corpus.

*Documents.*  A text's features are the mean of its words' vectors, the mean of
their index vectors, and four measures of length.

*Network.*  One hidden layer of ``HIDDEN`` units and one output, trained in numpy
on all labelled rows: in ``ROUNDS``, in which each shard of them takes
``EPOCHS`` passes and the results are averaged (``features.improved``).  One of
``REST`` training ids is not learned from: all these rows set the temperature of the probabilities.

Defined cases: null and empty texts are scored from zero features; rows
without an id are scored and never learned from; a row's score depends on its
text only, so repeated rows score alike; without any labelled row of a class
every score is 0.5; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table
from .features import SCORED, held_out, improved, labelled, logit_counts, scored_batch, sharded, softened, step_logits, temperature, totals
from .shingles import mixed

FORMS, DIMENSIONS, NONZEROS, HIDDEN = 2048, 32, 4, 24
ROUNDS, EPOCHS, REST = 6, 10, 5
THRESHOLD = 0.3

_SHAPES = 64


def _kinds() -> np.ndarray:
    """Class of each byte: 0 space, 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 sentence mark, 5 other mark."""
    k = np.full(256, 5, np.uint8)
    k[[9, 10, 11, 12, 13, 32]] = 0
    k[97:123] = 1
    k[128:] = 1
    k[65:91] = 2
    k[48:58] = 3
    for c in b".,;:'?":
        k[c] = 4
    return k


_KIND = _kinds()


def forms(text: str | None) -> np.ndarray:
    """The form number of each word of a text, in order."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    kind = _KIND[raw]
    word = np.concatenate(([False], kind != 0, [False])).astype(np.int8)
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64)
    first, last = kind[starts], kind[ends - 1]
    uppers = np.concatenate(([0], np.cumsum(kind == 2)))
    marks = np.concatenate(([0], np.cumsum(kind == 5)))
    n_upper = uppers[ends] - uppers[starts]
    shouted = (n_upper >= 2) | ((n_upper == 1) & (ends - starts == 1))
    marked = np.minimum(marks[ends] - marks[starts], 3)
    # A hash of the letters: running sums of bytes and squares tell most words apart.
    value = raw.astype(np.uint64) + np.uint64(1)
    one = np.concatenate(([0], np.cumsum(value * value * value))).astype(np.uint64)
    letters = mixed(one[ends] - one[starts] + (ends - starts).astype(np.uint64) * np.uint64(1 << 40))
    again = np.concatenate(([False], letters[1:] == letters[:-1]))
    shape = (shouted * 1 + marked * 2 + again * 8 + (last == 4) * 16 + (first == 3) * 32).astype(np.int64)
    plain = (shape & ~16) == 0
    return np.where(plain, _SHAPES + (letters % np.uint64(FORMS - _SHAPES)).astype(np.int64), shape)


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1, a function of the form's number alone."""
    rng = np.random.default_rng(7)
    out = np.zeros((FORMS, DIMENSIONS), np.float32)
    for k in range(FORMS):
        at = rng.choice(DIMENSIONS, NONZEROS, replace=False)
        out[k, at] = rng.choice([-1.0, 1.0], NONZEROS)
    return out


def _context_sums(docs: DataFrame) -> np.ndarray:
    """How often each form stands next to each other one, times the index vectors: the word vectors.

    Co-occurrences are counted per task as numbers of (form, neighbour); a row
    per form and task is shuffled and summed.
    """
    index = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros(FORMS * FORMS, np.int64)
        for batch in batches:
            codes = []
            for text in batch.column(0).to_pylist():
                f = forms(text)
                codes.append(f[:-1] * FORMS + f[1:])
            if codes:
                together += np.bincount(np.concatenate(codes), minlength=FORMS * FORMS)
        pairs = together.reshape(FORMS, FORMS)
        count = pairs.sum(1) + pairs.sum(0)
        sums = pairs @ index.astype(np.float64) + pairs.T @ index.astype(np.float64)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(count[seen])] + [pa.array(sums[seen, d].astype(np.int64)) for d in range(DIMENSIONS)],
            names=["form", "n", *(f"v{d}" for d in range(DIMENSIONS))],
        )

    names = [f"v{d}" for d in range(DIMENSIONS)]
    sums = docs.select("text").mapInArrow(run, "form long, n long, " + ", ".join(f"{v} long" for v in names))
    rows = sums.groupBy("form").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in names)).collect()  # FORMS rows at most
    out = np.zeros((FORMS, DIMENSIONS), np.float32)
    for r in rows:
        v = np.array([r[name] for name in names], np.float64) / r["n"]
        out[r["form"]] = v / max(1e-6, float(np.linalg.norm(v)))
    return out


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """``vectors`` holds, side by side, each form's learned and index vector."""
    out = np.zeros((len(texts), vectors.shape[1] + 4), np.float32)
    for k, text in enumerate(texts):
        f = forms(text)
        if len(f):
            often = np.bincount(f, minlength=FORMS)
            used = np.flatnonzero(often)
            out[k, :-4] = often[used].astype(np.float32) @ vectors[used] / len(f)
            out[k, -4:] = np.log1p(len(f)) / 5, len(used) / len(f), often[:_SHAPES].sum() / len(f), len(text) / len(f) / 10
    return out


class Network:
    """Two layers, trained by Adam on the mean log loss."""

    def __init__(self, n_in: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n_in, np.float32), np.ones(n_in, np.float32)
        self.p = [
            (rng.standard_normal((n_in, HIDDEN)) / np.sqrt(n_in)).astype(np.float32), np.zeros(HIDDEN, np.float32),
            (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32),
        ]
        self.temperature = 1.0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.p[0] + self.p[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._hidden((x - self.mean) / self.scale) @ self.p[2] + self.p[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return softened(self.logit(x) * self.temperature)

    def state(self) -> np.ndarray:
        """Rows of ``HIDDEN`` numbers: all that is learned, and beside it Adam's two moments, not begun."""
        last = np.append(self.p[3], np.zeros(HIDDEN - 1))
        rows = np.concatenate([self.p[0], self.p[1][None], self.p[2][None], last[None]])
        return np.concatenate([rows, np.zeros((len(rows), 2 * HIDDEN))], axis=1)

    @staticmethod
    def _parts(state: np.ndarray, side: int) -> list[np.ndarray]:
        rows = state[:, side * HIDDEN : (side + 1) * HIDDEN]
        return [rows[:-3], rows[-3], rows[-2], rows[-1, :1]]

    def take(self, state: np.ndarray) -> None:
        self.p = [p.astype(np.float32) for p in self._parts(state, 0)]

    def learn(self, state: np.ndarray, x: np.ndarray, y: np.ndarray, turn: int) -> np.ndarray:
        """``state`` after ``EPOCHS`` passes over features and labels, in the round ``turn``."""
        rng = np.random.default_rng(3 + turn)
        z = (x - self.mean) / self.scale
        p, m, v = (self._parts(state, side) for side in range(3))
        batches = max(1, len(y) // 64)
        step = turn * EPOCHS * batches
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(y)), batches):
                h = np.maximum(0, z[part] @ p[0] + p[1])
                error = (softened(h @ p[2] + p[3][0]) - y[part]) / len(part)
                back = np.outer(error, p[2]) * (h > 0)
                grads = [z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error, error.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    m[k][...] = 0.9 * m[k] + 0.1 * g
                    v[k][...] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return state

    def fit(self, rows: DataFrame) -> None:
        """Learn from all rows of ``features.sharded``, encoded as 32-bit features."""
        own = rows.where("not rest")

        def sums(xs: list[bytes], ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = _decoded(xs).astype(np.float64)
            return np.arange(2), np.column_stack([np.full(2, len(x)), np.stack([x.sum(0), (x * x).sum(0)])])

        keys, total = totals(own, len(self.mean) + 1, sums)
        first, second = (total[keys == k][0, 1:] / total[0, 0] for k in range(2))
        self.mean, self.scale = first.astype(np.float32), (np.sqrt(np.maximum(0, second - first * first)) + 1e-3).astype(np.float32)
        state = self.state()
        for turn in range(ROUNDS):
            state = improved(own, state, lambda begun, xs, ys, turn=turn: self.learn(begun, _decoded(xs), ys, turn))
        self.take(state)
        counts = logit_counts(rows.where("rest"), 1, lambda xs: (np.zeros(len(xs), np.int64), self.logit(_decoded(xs))))[0]
        y, at = np.nonzero(counts)
        self.temperature = temperature(step_logits()[at], y, counts[y, at])


def _decoded(xs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xs), np.float32).reshape(len(xs), -1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network | None]:
    """Word vectors of all documents, and the network; none where a class has no labelled row."""
    vectors = np.concatenate([_context_sums(docs), index_vectors()], axis=1)
    rows = sharded(labelled(docs, labels, label, REST), lambda texts: [x.tobytes() for x in features(texts, vectors)])
    if rows is None:
        return vectors, None
    network = Network(vectors.shape[1] + 4)
    network.fit(rows)
    dropped(rows)
    return vectors, network


def score_quality(docs: DataFrame, vectors: np.ndarray, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2).to_pylist(), vectors)
            yield scored_batch(batch, network.probability(x) if network else np.full(len(x), 0.5), threshold)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCORED)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and prediction of quality for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, *train(docs, table(spark, sf_dir, "labels")))
