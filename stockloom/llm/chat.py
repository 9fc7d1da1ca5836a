"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged by an array aggregation,
and the blocks are concatenated. Text, masks and everything read back come from column expressions.

Template of one block: ``<|im_start|>role\\ntext<|im_end|>\\n``; merged turns of a block are parted by ``<|im_next|>``.
Inside roles and texts a backslash is doubled, ``<|`` becomes ``<\\|``, and in roles a line feed becomes ``<\\n``; no
control string can then arise from content, and the replacements are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, sha256_hex

#: The control strings of the template.
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
ASSISTANT = "assistant"

#: So many turns are summed in one fold.
_CHUNK = 128


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _swap(_swap(text, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: Column) -> Column:
    return _swap(_swap(text, "<\\|", "<|"), "\\\\", "\\")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), "\n", "<\\n")


def unescape_role(role: Column) -> Column:
    return unescape(_swap(role, "<\\n", "\n"))


def _loss_spans(turns: Column) -> Column:
    """(start, end) of the texts under the loss mask, from the lengths of all turns and of what stands around them.

    Sums run over chunks of turns first and then inside each chunk: one fold over all turns would copy its result for each of them.
    """
    kind = "array<struct<start:int,end:int>>"
    length = lambda t: t["head"] + t["n"] + t["tail"]

    def inside(chunk: Column, start: Column) -> Column:
        return F.aggregate(chunk, F.struct(start.alias("at"), F.array().cast(kind).alias("spans")), lambda acc, t: F.struct(
            (acc["at"] + length(t)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["n"]).alias("end"))))
            ).otherwise(acc["spans"]).alias("spans")))["spans"]

    def chunked(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, t: a + length(t)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return bind(starts, lambda at: F.flatten(F.transform(chunks, lambda c, k: inside(c, F.get(at, k)))))

    firsts = lambda ts: F.sequence(F.lit(0), F.floor((F.size(ts) - 1) / _CHUNK).cast("int"))
    cut = lambda ts: F.transform(firsts(ts), lambda k: F.slice(ts, k * _CHUNK + 1, _CHUNK))
    return bind(turns, lambda ts: bind(cut(ts), chunked))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``turns`` has conv_id, turn, role, text; further columns are ignored. Turns come in order of (turn, role, text), nulls
    first, so ties and repeated rows have a fixed place and none is lost. Null roles and texts are empty strings; rows
    without conv_id form one conversation. ``loss_spans`` are the (start, end) code point ranges of assistant texts in
    ``formatted``, end exclusive, one for each assistant turn. An empty table gives no rows. A conversation is one
    result value and so has to fit one; conversations are otherwise independent of each other.
    """
    said = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.select("conv_id", said.alias("said")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("said")).alias("said"))

    # Where a block starts: a turn whose role differs from the one before it. A block is then the slice up to the next
    # start; slicing keeps the merge linear, while growing arrays in a fold would copy them for each turn.
    starts = lambda said: F.transform(F.filter(
        F.transform(said, lambda t, i: F.struct(
            i.alias("i"), ((i == 0) | (F.coalesce(F.get(said, i - 1)["role"], F.lit("")) != t["role"])).alias("new"))),
        lambda x: x["new"]), lambda x: x["i"])

    def merged(said: Column) -> Column:
        def blocks(first: Column) -> Column:
            return F.transform(first, lambda i, k: F.struct(
                F.get(said, i)["role"].alias("role"),
                F.transform(
                    F.slice(said, i + 1, F.coalesce(F.get(first, k + 1), F.size(said)) - i), lambda t: escape(t["text"])
                ).alias("texts")))

        return bind(starts(said), blocks)

    blocks = grouped.select("conv_id", bind(F.col("said"), merged).alias("blocks"))
    body = lambda b: F.concat(
        F.lit(START), escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], NEXT), F.lit(END))
    written = blocks.select("conv_id", "blocks", F.transform("blocks", body).alias("parts"))

    # One entry per turn: role, length and the characters in front of the text (block head or separator) and after it.
    lengths = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        (b["role"] == ASSISTANT).alias("loss"),
        F.when(i == 0, F.length(escape_role(b["role"])) + len(START) + 1).otherwise(len(NEXT)).alias("head"),
        F.length(t).alias("n"),
        F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("tail")))))
    return written.select(
        "conv_id", F.array_join("parts", "").alias("formatted"),
        _loss_spans(lengths).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations again: conv_id, turns (array of role, text), loss_text, formatted_chars.

    Turns come from the marks of the template, ``loss_text`` from cutting the loss spans out of the formatted string.
    """
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: F.length(x) > 0)

    def turns(b: Column) -> Column:
        inner = F.substring(b, len(START) + 1, 2147483647)
        role = F.substring_index(inner, "\n", 1)
        text = F.substr(inner, F.length(role) + 2)
        return F.transform(F.split(text, r"<\|im_next\|>"), lambda t: F.struct(
            unescape_role(role).alias("role"), unescape(t).alias("text")))

    cut = F.transform("loss_spans", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    return formatted.select(
        "conv_id", F.flatten(F.transform(parts, turns)).alias("turns"), F.array_join(cut, "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all read back from the output."""
    back = read_back(format_conversations(turns))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha256_hex(listed).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), sha256_hex(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars")
