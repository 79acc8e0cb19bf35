"""Where the tokens of two tokenizers meet: groups, links, and how often ids are linked in a corpus.

Every text is encoded twice over the same bytes: by a byte-level BPE (A, over a
blank and the text) and by a sentence-piece model (B, which adds the blank).
Byte offsets where a token of A and one of B both end cut the tokens into
groups; the tokens of a group are linked, each of A with each of B.

1.  *Lockstep merging.*  One state vector holds, for all documents of a block,
    the pointers into A and B and the starts of the open groups.  A step
    advances the pointer whose token ends first, and both where they end
    together, which emits a cut and the links of the group it closes.  Finished
    documents leave the vector.  Long documents take several places in it: each
    place begins behind a cut that is found by bisection, so the number of
    steps is bounded by ``LANE`` and not by the longest document.
2.  A *block* of documents becomes one row of a written table: the documents'
    figures, the distinct id pairs that are linked in the block with the number
    of documents that hold them, and each document's pairs as indexes of these.
3.  Pairs are counted over blocks, so a pair that every document holds is one
    row for each block and not one for each document.
4.  The counts go back to the blocks: a block gathers the counts of its own
    pairs only, and sums them for its documents.

No step gathers pairs of the corpus in one place.  The highest count of each id
of A has one row for each entry of A's vocabulary.

Defined cases.  A null or empty text has no tokens, nor has one whose joined
tokens are not a blank and the text (a literal U+2581, for one): all figures are
0 and the groups are empty.  Rows are taken one by one: a repeated row counts
as one more document, a null id stays null, an empty table gives an empty
result, other columns are not read.  Texts are encoded whole; a block holds
one text at least, so memory grows with the longest text, not with the table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

LANE = 512  # tokens of A in a place of the state vector
BLOCK_TOKENS = 1_000_000  # of A and B together; a block ends with the text that reaches it
CALL_CHARS = 100_000  # of the texts that one call of a library gets
WIDE = 64  # links of a group beyond which equal ids are counted first
_MARK = "▁"
# How A splits a text before it merges: a fixed pattern of its vocabulary.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that editions of Unicode may class differently, and runs of blanks that a matcher without bounds gives up on.
_LATER = re.compile(r"[^\x00-\u024f]|\s{2000}")


# -- the two vocabularies --------------------------------------------------


class Vocabularies:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        of_char = _byte_of_char()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(map(of_char.__getitem__, self.a.id_to_token(i))) if set(self.a.id_to_token(i)) <= of_char.keys() else b"" for i in range(size)]
        b = self.b
        self.b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(_MARK, " ").encode()
            for i in range(b.get_piece_size())
        ]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # An id as text with what follows it: within its side, at the end of A's side, at the end of the group.
        self.a_text = [f"{i}{c}".encode() for i in range(size) for c in ",|"]
        self.b_text = [f"{i}{c}".encode() for i in range(len(self.b_bytes)) for c in ",;"]

        # The same vocabulary as ranks: every entry behind the single bytes is a merge, and merges are in order.
        self.ranks = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if x}, special_tokens={})

    def _ids_of_a(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of A.  The faster library takes texts in whose characters both see the same letters, digits and blanks."""
        rest = [t for t in texts if _LATER.search(t)]
        others = (e.ids for e in self.a.encode_batch_fast([" " + t for t in rest], add_special_tokens=False))
        for t in texts:
            yield next(others) if _LATER.search(t) else self.ranks.encode_ordinary(" " + t)

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B of each text; none where their bytes are not a blank and the text."""
        none = np.zeros(0, np.int64)
        second = self.b.encode(list(texts), num_threads=1)
        for text, a, b in zip(texts, self._ids_of_a(texts), second):
            whole = b" " + text.encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else (none, none)


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others are numbered
    from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _vocabularies(byte_file: str, piece_file: str) -> Vocabularies:
    return Vocabularies(byte_file, piece_file)


# -- merging ---------------------------------------------------------------


class Groups(NamedTuple):
    """Groups in order of their place: tokens ``a_from`` to ``a_to`` of A, ``b_from`` to ``b_to`` of B."""

    a_from: np.ndarray
    a_to: np.ndarray
    b_from: np.ndarray
    b_to: np.ndarray


def merge(a_end: np.ndarray, b_end: np.ndarray, first: np.ndarray) -> Groups:
    """The groups of a block's documents.

    ``a_end`` and ``b_end`` are the rising byte offsets at which the tokens of
    all documents end, one document behind the other; ``first`` has the first
    token of A of every document that has tokens.
    """
    last = len(a_end)
    lane = _lanes(a_end, b_end, first)
    stop = np.append(lane, last)[1:]
    pa_, pb = lane.copy(), _behind(b_end, a_end, lane)
    ga, gb = pa_.copy(), pb.copy()
    begin_a, begin_b, end_b = (np.full(last, -1, np.int64) for _ in range(3))  # by the last token of A of a group
    while len(pa_):
        ea, eb = a_end[pa_], b_end[pb]
        met = np.flatnonzero(ea == eb)
        at = pa_[met]
        begin_a[at], begin_b[at], end_b[at] = ga[met], gb[met], pb[met] + 1
        pa_ = pa_ + (ea <= eb)
        pb = pb + (eb <= ea)
        ga[met], gb[met] = pa_[met], pb[met]
        if len(met):
            going = pa_ < stop
            if not going.all():
                pa_, pb, ga, gb, stop = pa_[going], pb[going], ga[going], gb[going], stop[going]
    cut = np.flatnonzero(end_b >= 0)
    return Groups(begin_a[cut], cut + 1, begin_b[cut], end_b[cut])


def _behind(b_end: np.ndarray, a_end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token of B that begins where token ``at`` of A does, which is known to follow a cut."""
    before = np.where(at > 0, a_end[np.maximum(at, 1) - 1], 0)
    return np.searchsorted(b_end, before, side="right")


def _lanes(a_end: np.ndarray, b_end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens of A that follow a cut: those of ``first``, and within long documents one for about ``LANE`` tokens."""
    size = np.diff(np.append(first, len(a_end)))
    more = np.maximum(size - 1, 0) // LANE
    at = np.repeat(first, more) + LANE * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    found = []
    while len(at):  # on to the next token that follows a cut; the end of a document is one
        end = a_end[at - 1]
        met = b_end[np.searchsorted(b_end, end)] == end
        found.append(at[met])
        at = at[~met] + 1
    at = np.unique(np.concatenate([first, *found]))
    return at[at < len(a_end)]


def links(groups: Groups, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every linked id pair of a group: the group, the pair (A's id above B's), and how many links it has."""
    sizes = (groups.a_to - groups.a_from) * (groups.b_to - groups.b_from)
    plain = np.flatnonzero(sizes <= WIDE)
    n = sizes[plain]
    group = np.repeat(plain, n)
    place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.divmod(place, (groups.b_to - groups.b_from)[group])
    pair = a[groups.a_from[group] + i] << 32 | b[groups.b_from[group] + j]
    found = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(sizes > WIDE):
        x, nx = np.unique(a[groups.a_from[g] : groups.a_to[g]], return_counts=True)
        y, ny = np.unique(b[groups.b_from[g] : groups.b_to[g]], return_counts=True)
        found.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), np.outer(nx, ny).ravel()))
    return tuple(np.concatenate(part) for part in zip(*found))


def group_texts(groups: Groups, a: np.ndarray, b: np.ndarray, of: np.ndarray, n: int, words: Vocabularies) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of each of ``n`` documents; ``of`` is the document of each group."""
    sizes_a, sizes_b = groups.a_to - groups.a_from, groups.b_to - groups.b_from
    # The tokens in the order in which they are written: A's of a group, then B's.
    code = np.empty(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + np.repeat(groups.b_from, sizes_a)
    place_b = np.arange(len(b)) + np.repeat(groups.a_to, sizes_b)
    code[place_a] = 2 * a
    code[place_b] = 2 * (b + len(words.a_len))
    code[place_a[groups.a_to - 1]] += 1
    code[place_b[groups.b_to - 1]] += 1
    ends = np.zeros(n + 1, np.int64)
    np.add.at(ends, of + 1, sizes_a + sizes_b)
    ends = np.cumsum(ends)
    table = words.a_text + words.b_text
    return [b"".join(map(table.__getitem__, code[x:y].tolist()))[:-1] for x, y in zip(ends[:-1], ends[1:])]


# -- blocks ----------------------------------------------------------------

_FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_NAMES = [f.split()[0] for f in _FIGURES.split(", ")]
BLOCK = (
    f"block long, docs array<struct<doc: long, {_FIGURES.replace(' ', ': ').replace(',: ', ', ')}>>, "
    "pairs array<long>, holders array<int>, entries binary, times binary, upto array<int>"
)
_DOC = pa.struct([("doc", pa.int64()), *((n, pa.string() if n == "groups_sha256" else pa.int64()) for n in _NAMES)])


def _smallest(x: np.ndarray, top: int) -> bytes:
    """A byte that names the type, then the numbers in the smallest type that holds ``top``."""
    kind = np.min_scalar_type(max(0, top))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _block(key: int, ids: list, encoded: list[tuple[np.ndarray, np.ndarray]], words: Vocabularies) -> pa.RecordBatch:
    n = len(ids)
    n_a, n_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in encoded)]) for k in (0, 1))
    first = np.cumsum(n_a) - n_a
    groups = merge(np.cumsum(words.a_len[a]), np.cumsum(words.b_len[b]), first[n_a > 0])
    doc_of_a = np.repeat(np.arange(n), n_a)
    of = doc_of_a[groups.a_from]
    n_groups = np.bincount(of, minlength=n)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, of, (groups.a_to - groups.a_from) * (groups.b_to - groups.b_from))
    texts = group_texts(groups, a, b, of, n, words)
    digests = ["" if not t else hashlib.sha256(t).hexdigest() for t in texts]

    group, pair, times = links(groups, a, b)
    pairs, index = np.unique(pair, return_inverse=True)
    # Entries: the distinct pairs of each document, document by document.
    entry, at = np.unique(of[group] * max(1, len(pairs)) + index, return_inverse=True)
    times = np.bincount(at, weights=times, minlength=len(entry)).astype(np.int64)
    held, index = np.divmod(entry, max(1, len(pairs)))
    docs = pa.StructArray.from_arrays(
        [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string())],
        fields=list(_DOC),
    )
    columns = [
        pa.array([key], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), docs),
        pa.array([pairs], pa.list_(pa.int64())),
        pa.array([np.bincount(index, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32())),
        pa.array([_smallest(index, len(pairs))], pa.binary()),
        pa.array([_smallest(times, int(times.max(initial=0)))], pa.binary()),
        pa.array([np.cumsum(np.bincount(held, minlength=n)).astype(np.int32)], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "pairs", "holders", "entries", "times", "upto"])


def blocks(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for a block of documents, as step 2 has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabularies(byte_file, piece_file)
        key = TaskContext.get().partitionId() << 32
        ids, encoded, tokens = [], [], 0
        for batch in slices(batches, 64):
            for call in _calls(batch):
                ids += call.column(0).to_pylist()
                for pair in words.encode([t or "" for t in call.column(1).to_pylist()]):
                    encoded.append(pair)
                    tokens += len(pair[0]) + len(pair[1])
                if tokens >= BLOCK_TOKENS:
                    yield _block(key, ids, encoded, words)
                    key, ids, encoded, tokens = key + 1, [], [], 0
        if ids:
            yield _block(key, ids, encoded, words)

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK)


def _calls(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``CALL_CHARS``, as the libraries' results take many times the text's size."""
    size, begin = 0, 0
    for k, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        if size and size + (n or 0) > CALL_CHARS:
            yield batch.slice(begin, k - begin)
            size, begin = 0, k
        size += n or 0
    yield batch.slice(begin)


# -- counts ----------------------------------------------------------------


def pair_counts(made: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold the pair, and whether no pair of its A id has more."""
    held = made.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("count")))
    a = F.shiftright("pair", 32)
    # At most one row for each entry of A's vocabulary.
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


_RESULT = f"doc_id long, {_FIGURES}, n_best long, count_sum long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        row = {name: batch.column(name)[0] for name in batch.schema.names}
        docs = row["docs"].values
        upto = row["upto"].values.to_numpy()
        found = row["found"].values
        if found is None or not len(found):
            best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        else:
            order = np.argsort(found.field("pair").to_numpy())  # pairs of a block are in order, too
            count = found.field("count").to_numpy()[order]
            is_best = found.field("best").to_numpy(zero_copy_only=False)[order]
            entry, times = _numbers(row["entries"].as_py()), _numbers(row["times"].as_py())
            runs = [np.concatenate([[0], np.cumsum(x)]) for x in (times * is_best[entry], times * count[entry])]
            begin = np.concatenate([[0], upto[:-1]])
            best, total = (r[upto] - r[begin] for r in runs)
        yield pa.RecordBatch.from_arrays(
            [*docs.flatten(), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", *_NAMES, "n_best", "count_sum"]
        )


def aligned(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row."""
    made = written(blocks(docs, byte_file, piece_file, id_col, text_col))
    counts = written(pair_counts(made))
    of_block = made.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
    gathered = of_block.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    return made.select("block", "docs", "entries", "times", "upto").join(gathered, "block", "left").mapInArrow(_summed, _RESULT)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    """Groups, links and corpus-wide counts of the two tokenizers' tokens for every document."""
    return aligned(docs, *default_files())
