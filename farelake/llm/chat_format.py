"""Chat formatting with prefix-target expansion.

A turn is written ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. Every assistant turn becomes
an example of its own: all turns before it as context and only that reply trainable. A conversation that does not end
with an assistant turn also gives one example without a trainable part, so its last turns are not lost.

Escaping is reversible and leaves other texts as they are: in a text, each ``<`` followed by backslashes (or
none) and ``|`` gets one backslash more before the ``|``; so no text can hold a control string, and reading back takes one
backslash away. In a role, ``%`` and line ends are written as percent escapes as well.

An example holds its context, so a conversation's output grows with the square of its turns; that is the
method. A conversation is one row while it is formatted.

Defined results: null text and null role are empty; turns of one number are ordered by role, then text; equal rows are
turns of their own; null conv_id is a conversation; null turns come first; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: str | Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str | Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: str | Column) -> Column:
    return escaped(F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D")))


def unescaped_role(role: str | Column) -> Column:
    return F.replace(F.replace(F.replace(unescaped(role), F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (the place of its last turn, from 0), is_last (it holds the whole
    conversation), text, loss_start and loss_chars (code points of ``text``; 0 chars: nothing is trainable)."""
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    whole = whole.select("conv_id", written.alias("w"))
    whole = whole.select("conv_id", "w", F.transform("w", lambda t: F.concat(t["head"], t["body"], F.lit(END))).alias("texts"))
    picked = F.explode(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == F.size("w") - 1) | (F.get("w", i)["role"] == target)))
    each = whole.select("conv_id", picked.alias("example"), "w", "texts")
    context = F.array_join(F.slice("texts", 1, F.col("example")), "")
    last = F.get("w", F.col("example"))
    trained = last["role"] == target
    each = each.select("conv_id", "example", (F.col("example") == F.size("w") - 1).alias("is_last"), context.alias("context"), last["head"].alias("head"), F.get("texts", F.col("example")).alias("reply"), F.when(trained, F.length(last["body"])).otherwise(0).alias("loss_chars"))
    return each.select("conv_id", "example", "is_last", F.concat("context", "reply").alias("text"), (F.length("context") + F.length("head")).cast("long").alias("loss_start"), F.col("loss_chars").cast("long").alias("loss_chars"))


def turns_of(text: str | Column) -> Column:
    """Read back: array of (role, text) of a formatted text."""
    blocks = F.slice(F.split(text, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))

    return F.transform(blocks, turn)


def loss_text(text: str | Column = "text", start: str | Column = "loss_start", chars: str | Column = "loss_chars") -> Column:
    """Read back: the text under the loss mask, unescaped."""
    start, chars = (F.col(c) if isinstance(c, str) else c for c in (start, chars))
    return unescaped(F.substring(text, start.cast("int") + 1, chars.cast("int")))
