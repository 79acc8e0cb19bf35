from __future__ import annotations

import hashlib
import random

import pytest

from promptledger.llm import chat_format as cf

CONTROLS = ["<|turn|>", "<|end|>", "<|image:0|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<\\|", "\\["]


def test_escape_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    for _ in range(3000):
        s = "".join(rnd.choice([*CONTROLS, "<", "|", "/", "s", "[", "]", "é", "\n", "a"]) for _ in range(rnd.randint(0, 12)))
        e = cf.escape(s)
        assert cf.unescape(e) == s
        assert not any(c in e for c in ("<|", "</s>", "<s>")) and all(e[i - 1] == "\\" for i, c in enumerate(e) if c == "[")


def test_parts():
    flat = cf.flatten([
        {"kind": "text", "text": "see [1] "}, {"kind": "image", "ref": "a.png", "width": 900, "height": 400},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.5}, {"kind": "text", "text": None}, {"kind": "document", "ref": "c.pdf", "pages": 3},
    ])
    assert "".join(flat.text) == "see \\[1] <|image:0|><|audio:1|><|document:2|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in flat.attachments] == [("image", "a.png", 768), ("audio", "b.wav", 63), ("document", "c.pdf", 3072)]
    assert all("".join(flat.text)[a["offset"] :].startswith(f"<|{a['kind']}:{k}|>") for k, a in enumerate(flat.attachments))
    assert flat.expanded_tokens == 768 + 63 + 3072
    assert cf.flatten(None).text == []
    with pytest.raises(ValueError):
        cf.flatten([{"kind": "video"}])


def test_read_back(spark):
    turns = [(1, 1, "assistant", "b [x]"), (1, 0, "user", cf.PROBE), (2, 0, None, None), (None, 0, "user", "x"), (None, None, "assistant", "y" * 100_000),
             (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (1, 2, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cf.read_back(cf.format_turns(df)).collect()}
    for conv in (1, 2, None, 3):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in turns if c == conv))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
        assert got[conv].formatted_chars == sum(len(cf.escape(r)) + len(cf.escape(x)) + 17 for _, r, x in mine)
    assert cf.read_back(cf.format_turns(df.limit(0))).count() == 0


def test_parts_column(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", [("text", "hi", None, None, None, None, None), ("image", None, "a.png", 10, 10, None, None)]), (1, 1, "assistant", None)],
        f"conv_id long, turn long, role string, parts array<{cf.PART}>",
    )
    first, second = sorted(cf.format_turns(df).collect(), key=lambda r: r.n)
    assert first.formatted == "<|turn|>user\nhi<|image:0|><|end|>\n" and first.expanded_tokens == 256 and first.attachments[0].ref == "a.png"
    assert first.loss_start == first.loss_end and second.loss_start == second.loss_end
