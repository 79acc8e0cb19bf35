"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment's characters are linked symbols.  An agenda, ordered by score and
then by place, holds the adjacent pairs whose joined string is a piece; the
best pair is merged and its new neighbours join the agenda, until it is empty.
What is no piece falls back to bytes, or to the unknown id.

A text is cut into segments where no piece of the vocabulary can reach across:
before a run of blanks (when no piece has a blank after another character),
around control characters that are in no piece, and before punctuation that no
piece has after a letter.  Merges never cross such a
cut, so segments are encoded apart and their results are kept in a cache of
bounded size.  Each Arrow batch checks the segments it saw for the first time
against the sentencepiece library; a difference is counted and the library's
ids are taken.

Defined cases.  A null text is an empty text: no ids but the end id.  Texts of
any length are encoded whole.  Rows are independent, so repeated rows, null
ids and an empty table need no rule; other columns pass through.  Decoding
ids outside the vocabulary raises ``IndexError``.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices

MARK = "▁"
CACHED = 250_000  # segments in each of the cache's two generations
CACHED_CHARS = 48  # longer segments are not cached
_PLACE = 32  # bits of an agenda entry that hold the place
_PLACES = (1 << _PLACE) - 1
SHORT, _NONE = 40, 1 << _PLACE  # characters of a segment whose agenda is a plain list; the rank of what is no piece


class Pieces:
    """A merge-type vocabulary with its own encoder and decoder."""

    def __init__(self, model_file: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        # Pieces of equal score share a rank; the best score has rank 0.
        place = {v: k for k, v in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.piece[i]: place[sp.get_score(i)] for i in plain}
        self.id = {self.piece[i]: i for i in plain}
        self.unused = {self.piece[i] for i in plain if sp.is_unused(i)}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        # What ids decode to.  An unknown id decodes to the library's surface for it.
        self.number = [str(i) for i in range(size)]
        self.surface: list[bytes] = [
            b"" if sp.is_control(i) else bytes([int(self.piece[i][3:5], 16)]) if sp.is_byte(i)
            else sp.decode([i]).encode() if sp.is_unknown(i) else self.piece[i].replace(MARK, " ").encode()
            for i in range(size)
        ]
        if sp.encode("\ufb01  a ", out_type=str) != [MARK, *self._split("\ufb01"), *self._split(MARK + MARK + "a" + MARK)]:
            raise ValueError("only BPE models without normalisation and with a leading blank are supported")
        self.cuts, self.segments = self._segmenter()
        self.young: dict[str, tuple[str, bytes, int]] = {}
        self.old: dict[str, tuple[str, bytes, int]] = {}
        self.fresh: dict[str, list[int]] = {}

    def _segmenter(self) -> tuple[str, Callable[[str], list[str]]]:
        """Characters of no piece, and the function that cuts a text where no piece reaches across.

        Besides the characters of no piece these are the places before
        punctuation that no piece has after a letter or digit.
        """
        used = set("".join(self.id))
        cuts = "".join(c for c in map(chr, range(32)) if c not in used)
        pairs = {pair for piece in self.id for pair in pairwise(piece)}
        marks = set(string.punctuation) - {b for a, b in pairs if a.isalpha()}
        c, m = (re.escape("".join(sorted(x))) for x in (cuts, marks))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            parts = [f"[^{c}]+" if c else r"[\s\S]+"]
        else:
            # A word up to a blank or a cutting mark; else all up to a blank.
            parts = [f" *[^\\W\\d_]+(?=[ {c}{m}]|\\Z)", f" *[^ {c}]+", " +"]
        return cuts, re.compile("|".join([*parts, *([f"[{c}]+"] if c else ())])).findall

    # -- encoding ---------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        """The pieces of ``text`` (blanks already marks): the agenda."""
        n = len(text)
        if n <= SHORT and not self.unused:
            return self._split_short(text)
        symbols = [*text, ""]  # merged-away symbols and the place behind the last are empty
        before, after = list(range(-1, n)), [*range(1, n + 1), n]
        rank, made = self.rank, {}
        # An entry is the rank of a pair's score and, below it, the pair's left place.
        agenda = [r << _PLACE | i for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & _PLACES
            right = after[left]
            joined = symbols[left] + symbols[right]
            # A pair whose symbols have meanwhile been merged away or grown is stale.
            if rank.get(joined) != entry >> _PLACE or not symbols[left] or not symbols[right]:
                continue
            if joined in self.unused:
                made[joined] = (symbols[left], symbols[right])
            symbols[left], symbols[right] = joined, ""
            after[left] = nxt = after[right]
            before[nxt], after[right] = left, n
            if nxt < n and (r := rank.get(joined + symbols[nxt])) is not None:
                heappush(agenda, r << _PLACE | left)
            if (prior := before[left]) >= 0 and (r := rank.get(symbols[prior] + joined)) is not None:
                heappush(agenda, r << _PLACE | prior)
        if not made:
            return [s for s in symbols if s]
        out: list[str] = []
        for s in filter(None, symbols):
            stack = [s]
            while stack:
                piece = stack.pop()
                if piece in made:
                    stack += reversed(made[piece])
                else:
                    out.append(piece)
        return out

    def _split_short(self, text: str) -> list[str]:
        """As ``_split``, for a vocabulary without unused pieces: the agenda is a list beside the symbols.

        Its least entry, the leftmost of equals, is found by looking through it.
        """
        rank, symbols = self.rank.get, list(text)
        agenda = [rank(a + b, _NONE) for a, b in pairwise(symbols)]
        while agenda and (best := min(agenda)) != _NONE:
            at = agenda.index(best)
            joined = symbols[at] + symbols.pop(at + 1)
            symbols[at] = joined
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank(joined + symbols[at + 1], _NONE)
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + joined, _NONE)
        return symbols

    def segment_ids(self, segment: str) -> list[int]:
        ids: list[int] = []
        for piece in self._split(segment.replace(" ", MARK)):
            known = self.id.get(piece)
            if known is not None:
                ids.append(known)
            elif self.byte:
                ids += (self.byte[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text, with the end id."""
        return [i for s in self._cut(text or "") for i in self.segment_ids(s)] + [self.end]

    def _cut(self, text: str) -> list[str]:
        # A literal mark is a blank to the library, too.
        return self.segments(" " + text.replace(MARK, " ")) if text else []

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        first = next((i for i in ids if not self.library.is_control(i)), None)
        led = first is not None and self.piece[first].startswith(MARK)
        return self._text(b"".join(map(self.surface.__getitem__, ids)), led)

    @staticmethod
    def _text(raw: bytes, led: bool = True) -> str:
        """``led``: the first piece has the leading blank that encoding adds."""
        raw = raw[1:] if led and raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            # Each byte that is part of no character becomes one replacement character.
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[at : at + e.start].decode() + "\ufffd")
                    at += e.start + 1
            return "".join(out)

    # -- whole batches ----------------------------------------------------

    def _learn(self, segment: str) -> tuple[str, bytes, int]:
        known = self.old.get(segment)
        if known is None:
            ids = self.segment_ids(segment)
            self.fresh[segment] = ids
            known = (" ".join(map(self.number.__getitem__, ids)), b"".join(map(self.surface.__getitem__, ids)), len(ids))
        if len(segment) <= CACHED_CHARS:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[segment] = known
        return known

    def _encode_text(self, text: str) -> tuple[int, str, str]:
        segments = self._cut(text)
        found = list(map(self.young.get, segments))
        if not all(found):
            found = [v or self.young.get(s) or self._learn(s) for s, v in zip(segments, found)]
        ids, raw, sizes = zip(*found) if found else ((), (), ())
        return sum(sizes) + 1, " ".join([*ids, self.number[self.end]]), self._text(b"".join(raw))

    def _disagreeing(self) -> list[str]:
        """Fresh segments to which the library gives other ids; they are corrected."""
        segments, self.fresh = self.fresh, {}
        names = list(segments)
        # A lone blank has no text of its own behind the leading blank: it is compared in context, too.
        blank = [s for s in names if s[0] == " " and s != " "]
        rest = [s for s in names if s[0] != " " or s == " "]
        wanted = dict(zip(blank, self.library.encode([s[1:] for s in blank], num_threads=1)))
        if rest:
            # The leading blank and a cut character come first, then the segment as it stands.
            lead = self.cuts[:1] or "a"
            skip = len(self.library.encode(lead))
            wanted |= {s: ids[skip:] for s, ids in zip(rest, self.library.encode([lead + s for s in rest], num_threads=1))}
        wrong = [s for s in names if wanted[s] != segments[s]]
        for s in wrong:
            ids = wanted[s]
            self.young[s] = (" ".join(map(self.number.__getitem__, ids)), b"".join(map(self.surface.__getitem__, ids)), len(ids))
        return wrong

    def encode_texts(self, texts: Sequence[str | None]) -> tuple[list[tuple[int, str, str]], list[int]]:
        """(number of ids, ids as text, decoded text) and the number of corrected segments of each text."""
        out = [self._encode_text(t or "") for t in texts]
        wrong = set(self._disagreeing())
        corrected = [0] * len(out)
        if wrong:
            for k, t in enumerate(texts):
                corrected[k] = sum(s in wrong for s in self._cut(t or ""))
                if corrected[k]:
                    ids = [*self.library.encode(t or ""), self.end]
                    out[k] = (len(ids), " ".join(map(self.number.__getitem__, ids)), self.library.decode(ids))
        return out, corrected


_LOADED: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """The vocabulary, loaded once in each worker process."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


_ADDED = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
    "n_corrected": (T.LongType(), pa.int64()),
}


def encode_documents(
    docs: DataFrame, model_file: str, text_col: str = "text", add: Sequence[str] = ("n_tokens", "ids"), prefix: str = "",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the named results of encoding ``text_col`` and decoding its ids.

    ``model_file`` must be readable under that path on every executor, as an
    installed package is.  Results are named ``prefix`` plus a name of
    ``n_tokens, ids, decoded, ids_sha256, decoded_sha256, n_corrected``; where a
    column of that name exists, underscores come before it.
    """
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(free_name(kept, prefix + a), _ADDED[a][0]) for a in add])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_file)
        for batch in slices(batches):
            rows, corrected = vocabulary.encode_texts(batch.column(at).to_pylist())
            made = {
                "n_tokens": lambda: [r[0] for r in rows],
                "ids": lambda: [r[1] for r in rows],
                "decoded": lambda: [r[2] for r in rows],
                "ids_sha256": lambda: [hashlib.sha256(r[1].encode()).hexdigest() for r in rows],
                "decoded_sha256": lambda: [hashlib.sha256(r[2].encode()).hexdigest() for r in rows],
                "n_corrected": lambda: corrected,
            }
            columns = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            columns += [pa.array(made[a](), _ADDED[a][1]) for a in add]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, number of ids, digest of the ids and of the decoded text of every document."""
    return encode_documents(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
        model_file or default_model(),
        add=("n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"),
        keep_text=False,
    )
