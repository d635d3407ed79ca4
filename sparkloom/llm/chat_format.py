"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role share a block (a turn looks at the
role before it in the array, so that a block needs no array of its own); the formatted text is the concatenation of an array of segments, each of which says whether it counts for the loss.

    <|start|>ROLE\\n TEXT [\\n<|next|>\\n TEXT]... \\n<|end|>\\n

A control string inside a text gets one more backslash than stands before it, so the template's own control strings
are exactly those without a backslash before them (the template always writes a line break or a tag's end there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>"
#: The template's control strings and those of common chat templates.
CONTROL = (START, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ANY = "|".join("".join(f"\\{c}" if not c.isalnum() and c not in "_<>" else c for c in s) for s in CONTROL)
ESCAPE = rf"(?<!\\)\\*+({_ANY})"
UNESCAPE = rf"\\(\\*+({_ANY}))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1")


def _empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text and loss; joined they are ``formatted``).

    Defined cases: turns sort by number (nulls first), equal numbers by role, then text; repeated rows are turns of
    their own; a null role or text is empty; a null conv_id is a conversation; an empty table gives an empty result.
    Other columns are left behind, whatever their names; texts are whole, however long. A conversation's turns meet in one task, since its text is one value of the result.
    """
    turn = F.struct(F.col("turn"), _empty(F.col("role")).alias("role"), _empty(F.col("text")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def segments(t: Column, i: Column) -> Column:
        before = F.try_element_at(F.col("_turns"), F.greatest(i, F.lit(1)))["role"]
        opens = (i == 0) | (before != t["role"])
        head = F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
        lead = F.when(i == 0, head).when(opens, F.concat(F.lit(f"\n{END}\n"), head)).otherwise(F.lit(f"\n{NEXT}\n"))
        return F.array(
            F.struct(lead.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("loss")),
        )

    last = F.array(F.struct(F.lit(f"\n{END}\n").alias("text"), F.lit(False).alias("loss")))
    return sorted_turns.select(
        "conv_id", F.concat(F.flatten(F.transform("_turns", segments)), last).alias("segments")
    ).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The formatted text's turns again, as an array of role and text."""
    blocks = F.filter(F.split(formatted, rf"(?<!\\){START.replace('|', '[|]')}"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(f"\n{END}\n"))
        texts = F.split(body, f"\n{NEXT.replace('|', '[|]')}\n")
        return F.transform(texts, lambda t: F.struct(F.url_decode(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks of the formatted chats, read back from them."""
    turns, loss = F.col("_turns"), F.col("_loss")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("_turns"), loss_text(F.col("segments")).alias("_loss")).select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
