"""Chat formatting: typed parts, escapes and the loss mask."""

import random

from pyspark.sql import functions as F

from inkproof.llm import chat

TURNS = f"conv_id long, turn long, role string, content array<{chat.PART}>"
TEXT = lambda t: ("text", t, None, None, None, None, None)


def test_escapes_round_trip(spark):
    rng = random.Random(6)
    pieces = ["\\", "<|", "<", "|", "s>", "</s>", "[INST]", "[/INST]", "[", "INST]", "<|end|>", "<|says|>", "<|turn|>", "é🙂", "\n", "$1", "\\\\"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in frame.select("*", chat.unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in chat.CONTROL)


def test_parts(spark):
    content = [
        TEXT("see <|image|> "),
        ("image", None, "a.png", 28, 15, None, None),
        TEXT(None),
        ("audio", None, "b.wav", None, None, 1.01, None),
        ("document", "ignored", "c.pdf", None, None, None, 3),
        ("image", None, None, None, None, None, None),
        None,
        (None, "end", None, None, None, None, None),
        ("video", "clip", "d.mp4", None, None, None, None),
    ]
    rows = [(1, 1, "assistant", [TEXT("yes <s>")]), (1, 0, "user", content), (2, None, None, None), (None, 0, "user", [])]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1))).collect()}
    one = got[1]
    assert one.formatted == (
        "<|turn|>user<|says|>see <\\|image|> <|image|><|audio|><|document|><|image|>endclip<|end|>"
        "<|turn|>assistant<|says|>yes <\\s><|end|>"
    )
    assert [(a.place, a.kind, a.ref, a.tokens) for a in one.attachments] == [
        (0, "image", "a.png", 4), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 768), (3, "image", None, 0)]
    assert one.attachment_tokens == 798 and one.n_turns == 2
    assert [s.text for s in one.segments if s.loss] == ["yes <\\s>"]
    assert got[2].formatted == got[2].formatted == "<|turn|><|says|><|end|>" and got[None].n_turns == 1


def test_read_back(spark):
    rng = random.Random(8)
    pieces = ["\\", "<|end|>", "</s>", "[INST]", "a", "<", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>"]), "".join(rng.choices(pieces, k=5))) for c in range(30) for t in range(4)]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(frame.select("conv_id", "turn", "role", chat.text_content(F.col("text")).alias("content")))
    back = done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    for row in back:
        want = sorted(((t, r, x) for c, t, r, x in rows if c == row.conv_id), key=lambda v: v[0])
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in want]
        assert row.loss == "".join(x for _, r, x in want if r == "assistant")


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []
