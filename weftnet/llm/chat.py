"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a row with its conversation, its turn, a role and typed parts. A visitor turns each
part into text: a text part is escaped, an image, audio or document part becomes a placeholder
whose reference and number of expanded tokens are recorded in the order of the placeholders.

Template of a turn: ``<|turn|>`` role, a line feed, the parts, ``<|end|>``.

Escapes: a control string inside a text or role gets one backslash after its first character;
one that has n backslashes there already gets n + 1. So no control string of a text survives, and
taking one backslash away gives the text back. In roles, backslash and line feed are written
``\\\\`` and ``\\n`` before that.

Defined cases: a null text, role or part list is empty; rows of a conversation are ordered by turn
(null first), then role, then content, so ties and repeated rows give one order; a null conversation
id is a conversation of its own; an unknown part type is a document; an attachment without sizes
expands to one token; an empty table gives no row. A formatted conversation is one value, so one row
must hold it; its rows are formatted before the shuffle and its offsets come from a window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of common chat templates.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)(?=(?:{_RESTS}))"
UNESCAPE = rf"([<\[])(\\*)\\(?=(?:{_RESTS}))"
#: The same places without a look-ahead, for engines that have none.
FOUND = rf"[<\[]\\*(?:{_RESTS})"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undoes escape_role: pairs of backslashes are read from the left, the rest holds line feeds."""
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _kind(p: Column) -> Column:
    return F.when(p["type"].isin("text", "image", "audio"), p["type"]).otherwise(F.lit("document"))


def _visit(p: Column) -> Column:
    """The text that stands for a part."""
    return F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))


def expanded_tokens(p: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a placeholder expands to: patches of an image, frames of audio, a number a page."""
    up = lambda x: F.greatest(F.lit(1), F.ceil(x)).cast("long")
    n = F.when(p["type"] == "image", up(p["width"] / patch) * up(p["height"] / patch)).when(p["type"] == "audio", up(p["seconds"] * audio_rate)).otherwise(up(p["pages"] * F.lit(page_tokens)))
    return F.coalesce(n, F.lit(1).cast("long"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def format_chats(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant", patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 256) -> DataFrame:
    """Formats conversations.

    Returns conv_id, formatted, turn_starts (of each turn in `formatted`, in characters),
    loss_spans (per turn, the start and length of each text part under the loss mask) and
    attachments (turn_index, type, ref, tokens in the order of the placeholders).
    """
    empty = F.array().cast(f"array<{PART}>")
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts).cast(f"array<{PART}>"), empty).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", "parts", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"), F.transform("parts", _visit).alias("shown"))
    rows = rows.select(
        "conv_id", "turn", "role", "parts", "shown", F.length("head").cast("long").alias("head_chars"),
        F.concat("head", F.array_join("shown", ""), F.lit(END)).alias("chunk"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "chunk", F.to_json("parts"))
    rows = rows.select(
        "*", F.row_number().over(order).alias("at"),
        (F.sum(F.length("chunk").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("chunk")).alias("began"),
    )
    before = lambda i: F.aggregate(F.slice("shown", F.lit(1), i), F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    spans = F.transform("parts", lambda p, i: F.struct((p["type"] == "text").alias("is_text"), (F.col("began") + F.col("head_chars") + before(i)).alias("start"), F.length(F.get("shown", i)).cast("long").alias("length")))
    spans = F.transform(F.filter(spans, lambda s: s["is_text"] & (F.col("role") == loss_role)), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    found = F.transform(F.filter("parts", lambda p: p["type"].isNull() | (p["type"] != "text")), lambda p: F.struct((F.col("at") - 1).alias("turn_index"), _kind(p).alias("type"), p["ref"].alias("ref"), expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens")))
    rows = rows.select("conv_id", F.struct("at", "chunk", "began", spans.alias("spans"), found.alias("found")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return out.select(
        "conv_id", F.array_join(F.transform("ts", lambda t: t["chunk"]), "").alias("formatted"), F.transform("ts", lambda t: t["began"]).alias("turn_starts"),
        F.transform("ts", lambda t: t["spans"]).alias("loss_spans"), F.flatten(F.transform("ts", lambda t: t["found"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and, read from `formatted` alone, turns (role, text) and, through the loss mask, loss_text."""
    chunks = F.split(F.col("formatted"), re.escape(END))
    chunks = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))
    df = formatted.select("*", chunks.alias("chunks"))

    def parse(chunk: Column) -> Column:
        body = F.substr(chunk, F.lit(len(TURN) + 1))
        cut = F.instr(body, "\n")
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    masked = F.transform("chunks", lambda c, i: F.array_join(F.transform(F.get("loss_spans", i), lambda s: unescape(F.substr(c, (s["start"] - F.get("turn_starts", i) + 1).cast("int"), s["length"].cast("int")))), ""))
    return df.select("conv_id", "formatted", F.transform("chunks", parse).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of op10, from what `read_back` gives."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
