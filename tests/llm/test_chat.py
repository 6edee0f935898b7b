"""Chat formatting as a round trip."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from samebytes.llm import chat

TEXTS = ["hi", "", None, "<|end|>\n", "a\\0b\\1\\", "<<SYS>>x</s>", "<|join|>", "[/INST]\n<|turn|>user\n", "é\U0001f600"]


def test_turns_and_loss_come_back(spark):
    rows = [(c, t, ("user", "assistant", "assistant", None, "od\nd<|")[(t * c) % 5], TEXTS[(t + c) % len(TEXTS)], "extra")
            for c in range(1, 12) for t in range(c)]
    rows += [(None, 1, "user", "lost", "x"), (20, None, "user", "b", "x"), (20, None, "user", "a", "x"), (20, 1, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(turns)
    got = out.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for row in got:
        own = sorted((r for r in rows if r[0] == row.conv_id), key=key)
        assert [(t.role, t.text) for t in row.turns] == [(r[2] or "", r[3] or "") for r in own]
        assert row.loss == [r[3] or "" for r in own if r[2] == "assistant"]
        starts = [i for i in range(len(own)) if i == 0 or (own[i][2] or "") != (own[i - 1][2] or "")]
        assert row.formatted.count(chat.TURN) == len(starts) == row.formatted.count(chat.END)
    assert len(got) == 13
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_query_reads_back_every_conversation(spark):
    from samebytes.llm.queries import QUERIES

    rows = {r.conv_id: r for r in QUERIES["op8_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
