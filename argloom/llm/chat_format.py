"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are the
context and only that reply is trainable.  Turns after the last reply (or a
conversation without one) make one more example without a trainable part, so the
examples of a conversation hold all its turns.

A turn is written as ``<|turn|>role<|text|>text<|end|>``.  Control strings inside
roles and texts (also the usual ones of other templates) are escaped by one more
backslash after their first character, and unescaped by one backslash less; other
characters stay as they are, so the escape is reversible and short.

Loss masks are spans ``[loss_start, loss_end)`` in code points of the formatted text.

Defined results: a null text or role counts as empty; rows of a conversation are in
order of turn (null first), then role, then text, so ties and repeated rows have a
fixed order and all stay; rows with a null id form one conversation; an empty table
gives an empty result; other columns are not looked at.  The length of a
conversation's examples together grows with the square of its turns: that is what
the expansion asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings without their first character.
ANGLE = "\\|turn\\|>|\\|text\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>"
SQUARE = "/?INST\\]"


def escape(text: Column) -> Column:
    """``text`` without bare control strings."""
    return F.regexp_replace(F.regexp_replace(text, f"<(\\\\*)({ANGLE})", "<\\\\$1$2"), f"\\[(\\\\*)({SQUARE})", "[\\\\$1$2")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(F.regexp_replace(text, f"<\\\\(\\\\*)({ANGLE})", "<$1$2"), f"\\[\\\\(\\\\*)({SQUARE})", "[$1$2")


def _part(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable_role: str = "assistant") -> DataFrame:
    """One row per example: ``conv_id, example, n_turns, is_last, formatted, loss_start, loss_end``."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), _part(role_col).alias("role"), _part(text_col).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def one(t: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        body = escape(t["text"])
        return F.struct(F.concat(head, body, F.lit(END)).alias("whole"), (t["role"] == trainable_role).alias("trains"), F.length(head).alias("head"), F.length(body).alias("body"))

    def examples(parts: Column) -> Column:
        last = F.size(parts) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: parts[i]["trains"] | (i == last))
        return F.transform(
            ends,
            lambda i, k: F.struct(
                k.alias("example"),
                (i + 1).alias("n_turns"),
                (i == last).alias("is_last"),
                F.array_join(F.transform(F.slice(parts, F.lit(1), i + 1), lambda p: p["whole"]), "").alias("formatted"),
                F.when(parts[i]["trains"], parts[i]["body"]).alias("body"),
            ),
        )

    whole = convs.select("conv_id", F.explode(let(F.transform("t", one), examples)).alias("e")).select("conv_id", "e.*")
    end = F.length("formatted") - len(END)
    return whole.withColumn("loss_start", F.when(F.col("body").isNotNull(), end - F.col("body"))).withColumn("loss_end", F.when(F.col("body").isNotNull(), end)).drop("body")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of ``role, text``."""
    # Between a turn's end and the next turn's start there is nothing; an escaped control string holds a backslash and never matches.
    parts = F.split(F.substring(formatted, len(TURN) + 1, 1 << 30), "<\\|end\\|>(?:<\\|turn\\|>|$)")
    turns = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, "<\\|text\\|>", 2))
    return F.transform(turns, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Read back from formatted examples: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples``."""
    loss = F.when(F.col("loss_end").isNotNull(), unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    per_example = examples.select("conv_id", "example", F.when(F.col("is_last"), F.col("formatted")).alias("_full"), loss.alias("_loss"), F.length("formatted").cast("bigint").alias("_chars"))
    convs = per_example.groupBy("conv_id").agg(
        F.max("_full").alias("_full"),
        F.sort_array(F.collect_list(F.when(F.col("_loss").isNotNull(), F.struct("example", "_loss")))).alias("_losses"),
        F.sum("_chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        convs.withColumn("_turns", read_turns(F.col("_full")))
        .withColumn("_all", F.array_join(F.transform("_losses", lambda x: x["_loss"]), ""))
        .select(
            "conv_id",
            F.size("_turns").cast("bigint").alias("n_turns"),
            F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
            F.length("_all").cast("bigint").alias("loss_chars"),
            F.sha2(F.encode("_all", "UTF-8"), 256).alias("loss_sha256"),
            "formatted_chars",
            "n_examples",
        )
    )
