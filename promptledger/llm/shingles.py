"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A text's set holds
its distinct five-word shingles; a text of fewer words has one shingle, its
whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from .common import SHINGLE_WORDS

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]  # A-Z hash like a-z

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _CHUNK + (1 << 17))
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 2**64), _U)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hash_words(raw: bytes, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: polynomials by differences of one running sum.

    With ``heads`` a row of hashes for whole words, then one for their first
    bytes up to each of these numbers.
    """
    data = np.frombuffer(raw, np.uint8)
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    edge = np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    rows = [ends, *(np.minimum(starts + k, ends) for k in heads)]
    hashes = np.stack([mixed((sums[e] - sums[starts]) * down[starts] + (e - starts).astype(_U)) for e in rows])
    return hashes if heads else hashes[0], starts


def word_hashes(texts: Sequence[str | None], blank: bytes = b"", heads: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order.

    Bytes of ``blank`` count as white space; ``heads`` as in ``_hash_words``.
    """
    encoded = [(t or "").encode() for t in texts]
    if blank:
        spaced = bytes.maketrans(blank, b" " * len(blank))
        encoded = [e.translate(spaced) for e in encoded]
    at = 0
    while at < len(encoded):
        size, upto = 0, at
        while upto < len(encoded) and (upto == at or size + len(encoded[upto]) <= _CHUNK):
            size += len(encoded[upto]) + 1
            upto += 1
        if upto == at + 1 and size > _CHUNK:
            yield _long(encoded[at], heads)
        else:
            hashes, starts = _hash_words(b"\n".join(encoded[at:upto]), heads)
            ends = np.cumsum([len(e) + 1 for e in encoded[at:upto]])
            yield from np.split(hashes, np.searchsorted(starts, ends[:-1]), axis=-1)
        at = upto


def _long(raw: bytes, heads: tuple[int, ...] = ()) -> np.ndarray:
    """A long text in pieces cut at white space."""
    out, at = [], 0
    while at < len(raw):
        upto = min(len(raw), at + _CHUNK)
        while upto < len(raw) and not _IS_SPACE[raw[upto]]:
            upto += 1
        out.append(_hash_words(raw[at:upto], heads)[0])
        at = upto
    return np.concatenate(out, axis=-1)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of each run of ``size`` words; of the whole sequence where it is shorter."""
    if not len(words):
        return np.zeros(0, _U)
    width = min(size, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, _U)
    for k in range(width):
        h = mixed(h * _U(_BASE) + words[k : n + k])
    return h


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in word_hashes(texts):
        yield np.unique(shingle_hashes(words))
