"""Chat formatting with typed content parts.

A turn is a list of parts (text, image, audio, document).  A visitor walks the
parts in order and writes one flat string: texts with their control strings
escaped, and for every other part a placeholder, a record of the attachment,
and the number of tokens the placeholder stands for.  Turns are written one by
one, so a conversation of any length passes through a task as a stream.

The template is ``<|turn|>role\\n text <|end|>\\n`` around escaped text.  Every
control string starts with one of the openers ``<|``, ``</``, ``[`` or the
escape ``\\``; escaping puts ``\\`` behind ``<`` or before ``[`` and ``\\``, so no
control string of this template or of other common ones is left in a text, and
``unescape(escape(s)) == s``.

Defined cases.  A null text is an empty text, a null role an empty role; rows
without a conversation id form one conversation without id.  Turns are ordered
by turn (null first), then role, then text; repeated rows are repeated turns.
Other columns are dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, END = "<|turn|>", "<|end|>"
_TO_ESCAPE = re.compile(r"\\|\[|<(?=[|/s\\])")
_ESCAPED = re.compile(r"\\(\\|\[)|<\\(?=[|/s\\])")

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE_PIXELS, TOKENS_PER_TILE = 448, 256
TOKENS_PER_SECOND, TOKENS_PER_PAGE = 25, 1024


def escape(text: str) -> str:
    """No control string is left: ``\\`` before ``\\`` and ``[``, and after ``<`` where one could open."""
    return _TO_ESCAPE.sub(lambda m: "<\\" if m[0] == "<" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "<", text)


@dataclass
class Flattened:
    """What the visitor has written of one turn."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind')}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or TILE_PIXELS) / TILE_PIXELS) * math.ceil((part.get("height") or TILE_PIXELS) / TILE_PIXELS)
        self._attach("image", part, max(1, tiles) * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * TOKENS_PER_PAGE)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown kind of part: {part.get('kind')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        offset = sum(map(len, self.text))
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "offset": offset, "tokens": tokens})
        self.text.append(f"<|{kind}:{n}|>")
        self.expanded_tokens += tokens


def flatten(parts: Iterable[dict] | None) -> Flattened:
    out = Flattened()
    for part in parts or ():
        out.visit(part)
    return out


FORMATTED = (
    "conv_id long, n long, formatted string, loss_start int, loss_end int,"
    "attachments array<struct<kind:string,ref:string,offset:int,tokens:int>>, expanded_tokens long"
)
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("tokens", pa.int32())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted row per turn, in order inside a partition: ``FORMATTED``.

    ``turns`` has ``conv_id, turn, role`` and either ``parts`` (an array of
    ``PART``) or ``text``.  ``formatted`` of all turns of a conversation, in
    order of ``n``, is the formatted conversation; ``loss_start`` to
    ``loss_end`` are the code points of a turn that carry loss.
    """
    if "parts" in turns.columns:
        # The text form of the parts breaks ties, so that the order is always the same.
        slim = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts")
        tie = F.to_json("parts")
    else:
        slim = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        tie = F.col("text")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, n = object(), 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")}
            for conv, role, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = n + 1 if conv == conversation else 0
                conversation = conv
                flat = flatten(content) if isinstance(content, list) or content is None else flatten([{"kind": "text", "text": content}])
                body, head = "".join(flat.text), f"{TURN}{escape(role)}\n"
                loss = (len(head), len(head) + len(body)) if role == "assistant" else (len(head), len(head))
                for k, v in zip(out, (conv, n, f"{head}{body}{END}\n", *loss, flat.attachments, flat.expanded_tokens)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), _ATTACHMENTS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return ordered.mapInArrow(run, FORMATTED)


_READ = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n\Z", re.S)

READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its formatted turns and loss masks.

    Rows must come in the order ``format_turns`` gives them.  Digests run on
    from turn to turn; nothing of a conversation is held but their states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done(rows: list) -> pa.RecordBatch:
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2].hexdigest() for r in rows], [r[3] for r in rows],
                       [r[4].hexdigest() for r in rows], [r[5] for r in rows]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            ready: list[list] = []
            for conv, n, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if n == 0:
                    if state is not None:
                        ready.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = _READ.match(text).groups()
                loss = unescape(text[start:end])
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(text)
            if ready:
                yield done(ready)
        if state is not None:
            yield done([state])

    return formatted.mapInArrow(run, READ_BACK)


PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7: turn and loss digests read back from the formatted output."""
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_turns(turns))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(t, r)
),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(replace(text, '\', '\\'), '[', '\['), '<([|/s])', '<\\\1', 'g'), '<\\\\', '<\\\\\\', 'g') AS e FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(e) + length(role) + 17)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
