"""Preference formatting in DataFrame functions only.

For a chosen and a rejected conversation, the longest common prefix of turns (role and text equal)
is rendered once as prompt; the rest of each is rendered as its completion, with a mask: the
character spans of the completion that count for the loss, those of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """Spans 'start:end' in _render(turns) of what the trained role says, end mark included, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)))
        end = start + F.length(t["text"]) + len(CLOSE)
        return F.struct(
            end.alias("at"),
            F.when(t["role"] == TRAINED, F.concat(acc["out"], F.array(F.concat_ws(":", start, end)))).otherwise(acc["out"]).alias("out"),
        )

    return F.array_join(F.aggregate(turns, zero, step, lambda acc: acc["out"]), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) for pairs with both sides.

    turns: pair_id, side ('chosen' or 'rejected'), turn, role, text. Turns go by (turn, role, text),
    so ties and repeated rows have a fixed order and each counts. Null roles and texts are empty, a
    null turn comes first; rows with a null pair_id or another side are left out, as is a pair with one side only.
    Equal conversations give empty completions. A conversation's turns meet in one row, as its
    rendered text does, however long it is. Other columns, whatever their names, are not read; an empty table gives an empty one.
    """
    rows = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select(
        F.col("pair_id"), "side", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    both = rows.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("chosen", "rejected")))
    both = both.where("size(chosen) > 0 and size(rejected) > 0")
    same = F.aggregate(
        F.zip_with("chosen", "rejected", lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, eq: F.struct((acc["n"] + (acc["on"] & F.coalesce(eq, F.lit(False))).cast("int")).alias("n"), (acc["on"] & F.coalesce(eq, F.lit(False))).alias("on")),
        lambda acc: acc["n"],
    )
    cut = both.withColumn("n_prompt_turns", same.cast("long"))
    n = F.col("n_prompt_turns").cast("int")
    rest = {s: F.slice(s, n + 1, F.size(s)) for s in ("chosen", "rejected")}
    cut = cut.select("pair_id", "n_prompt_turns", F.slice("chosen", F.lit(1), n).alias("head"), *(r.alias(s) for s, r in rest.items()))
    return cut.select(
        "pair_id", "n_prompt_turns", _render(F.col("head")).alias("prompt"), _render(F.col("chosen")).alias("chosen"), _render(F.col("rejected")).alias("rejected"),
        _spans(F.col("chosen")).alias("chosen_spans"), _spans(F.col("rejected")).alias("rejected_spans"),
    )


def pair_answers(conversations: DataFrame) -> DataFrame:
    """Turns of every conversation as a pair of sides, pair_id being conv_id: chosen as it is, rejected with another last answer.

    The rejected side has, in its last assistant turn, the last answer of the neighbour (conv_id with its lowest bit
    turned), or an empty one where there is no neighbour or it has no answer. All turns before are shared. Without an
    assistant turn both sides are equal, as they are where both answers are. Rows with a null conv_id are left out;
    repeated rows of the last turn are all replaced, and of tied answers the greatest text counts.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("pair_id is not null")
    last = rows.where(F.col("role") == TRAINED).groupBy("pair_id").agg(
        F.max("turn").alias("last_turn"), F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("answer")
    )
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("other"))
    told = rows.join(last.drop("answer"), "pair_id", "left").join(other, "pair_id", "left")
    swapped = (F.col("role") == TRAINED) & F.col("turn").eqNullSafe(F.col("last_turn"))
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(swapped, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text")),
    )
    return told.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
