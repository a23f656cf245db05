"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an array of parts (type, text, ref, width, height, seconds, pages).  The visitor
flattens them in order: text parts become escaped text, image, audio and document parts become
a placeholder, and each of these is recorded with its place, reference and the tokens it expands to.

The template is ``<|turn|>role<|says|>content<|end|>`` per turn.  Control strings inside roles and texts
are escaped reversibly: a backslash is doubled, and one is put after the first character of every control
string.  So an escaped text holds no control string, and ``read_turns`` gives back what went in.  The
loss mask flags the segments of the formatted text that are assistants' content.

A null text or role is empty, a part of a null or unknown type counts as text, and null parts, null or
empty contents are empty texts.  Turns are ordered by turn (nulls first), then role, then content, so ties
and repeated rows have one order.  Rows of a null conversation id are one conversation.  A conversation is one
row of the result, so all its turns meet in one row whatever their number; everything after that is linear
in its length.  Extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that texts may not hold: the start of every marker here, and markers of other common templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_content(text: Column) -> Column:
    """A plain text as content."""
    return F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), text, *_no_media()).cast(PART))


def _no_media() -> list[Column]:
    return [x for name in ("ref", "width", "height", "seconds", "pages") for x in (F.lit(name), F.lit(None))]


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens a placeholder stands for: image patches, audio frames, document pages; unknown sizes count as none."""
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    audio = F.ceil(part["seconds"] * audio_rate)
    pages = part["pages"].cast("long") * page_tokens
    tokens = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages)
    return F.coalesce(tokens, F.lit(0)).cast("long")


def flatten(content: Column, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256) -> Column:
    """struct(text, attachments): the content as escaped text with placeholders, and what these refer to."""
    media = F.create_map(*[F.lit(x) for pair in PLACEHOLDER.items() for x in pair])
    mark = lambda part: F.try_element_at(media, F.coalesce(part["type"], F.lit("text")))
    parts = F.filter(F.coalesce(content, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    pieces = F.transform(parts, lambda p: F.coalesce(mark(p), escape(p["text"])))
    attachments = F.transform(
        F.filter(parts, lambda p: mark(p).isNotNull()),
        lambda p, n: F.struct(
            n.alias("place"),
            p["type"].alias("kind"),
            p["ref"].alias("ref"),
            expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens"),
        ),
    )
    return F.struct(F.array_join(pieces, "").alias("text"), attachments.alias("attachments"))


def format_conversations(turns: DataFrame, key: str = "conv_id", **sizes) -> DataFrame:
    """One row per conversation of turns (key, turn, role, content).

    Columns: key, n_turns, segments (text, loss), formatted, attachments (turn by turn, place counts the
    attachments of its turn), attachment_tokens.
    """
    flat = turns.select(
        F.col(key).alias("conversation"), "turn", F.coalesce("role", F.lit("")).alias("role"), flatten(F.col("content"), **sizes).alias("flat")
    )
    grouped = flat.groupBy("conversation").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "flat"))).alias("turns")
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["flat"]["text"].alias("text"), (t["role"] == "assistant").alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    attachments = F.flatten(F.transform("turns", lambda t: t["flat"]["attachments"]))
    built = grouped.select(
        "conversation", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), attachments.alias("attachments")
    )
    return built.select(
        F.col("conversation").alias(key),
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted text; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring(F.split(p, r"<\|says\|>", -1)[0], len(TURN) + 1, 1 << 30)).alias("role"),
            unescape(F.split(p, r"<\|says\|>", -1)[1]).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
