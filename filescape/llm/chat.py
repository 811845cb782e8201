"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context
and only that reply is trainable. Turns after the last reply (or a conversation without a
reply) form one more example in which nothing is trainable, so that no turn is lost.

Template of a turn: ``<s>[INST] role [/INST] text</s>``. Inside roles and texts a backslash
is doubled and the control strings ``<s> </s> [INST] [/INST]`` get a backslash after their
first character, which can be undone.

A null role or text is the empty string. Turns are taken in the order (turn, role, text)
with null turns first; repeated rows are repeated turns. Rows whose conversation id is null
form one conversation with a null id. An empty table gives no rows. An example is as long
as the turns it holds, so a conversation has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, BETWEEN, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(BETWEEN), escape(text), F.lit(CLOSE))


def expand_replies(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per assistant turn, and one for turns that no reply follows.

    Returns conv_id, example (1, 2, ... in a conversation), n_context (turns before the
    target), has_target, formatted, loss_start (first trainable code point, from 1) and
    loss_length; the last two are 0 where nothing is trainable.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            format_turn(F.col(role), F.col(text)).alias("formatted"),
            F.length(escape(F.col(text))).cast("long").alias("loss"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    reply = lambda t: t["role"] == ASSISTANT
    places = F.expr(f"filter(sequence(1, size(turns)), i -> turns[i - 1].role = '{ASSISTANT}')")
    tail = F.when(~reply(F.element_at("turns", -1)), F.array(F.size("turns"))).otherwise(
        F.array().cast("array<int>")
    )
    target = F.element_at(F.col("turns"), F.col("last"))
    return (
        whole.withColumn("places", F.concat(places, tail))
        .select("conv_id", "turns", F.posexplode("places").alias("example", "last"))
        .select(
            "conv_id",
            (F.col("example") + 1).cast("long").alias("example"),
            (F.col("last") - F.when(reply(target), 1).otherwise(0)).cast("long").alias("n_context"),
            reply(target).alias("has_target"),
            F.array_join(F.slice(F.transform("turns", lambda t: t["formatted"]), 1, F.col("last")), "").alias("formatted"),
            F.when(reply(target), target["loss"]).otherwise(0).alias("loss_length"),
        )
        .withColumn(
            "loss_start",
            F.when(
                F.col("has_target"), F.length("formatted") - len(CLOSE) - F.col("loss_length") + 1
            )
            .otherwise(0)
            .cast("long"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(F.substring_index(F.substring(piece, len(OPEN) + 1, 1 << 30), BETWEEN, 1)).alias("role"),
            unescape(F.split(piece, r" \[/INST\] ", 2)[1]).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape(F.when(length > 0, F.substring(formatted, start, length)).otherwise(F.lit("")))


def round_trip(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, and the text that is trained."""
    seen = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.struct("example", "formatted").alias("longest"),
        F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).alias("part"),
    )
    gathered = seen.groupBy("conv_id").agg(
        F.max("longest").alias("longest"),
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = gathered.select(
        "conv_id",
        read_turns(F.col("longest.formatted")).alias("turns"),
        F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"),
        "formatted_chars",
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
