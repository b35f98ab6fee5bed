"""Preference pairs as one prompt and two masked completions.

The longest run of leading turns that the chosen and the rejected conversation share is
rendered once as the prompt.  What is left of each is its completion; a mask tells, run
by run of characters, what is trained on: the text and end mark of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
_TURN = "array<struct<role: string, text: string>>"


def _opening(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """(characters, trained) runs; they add up to the rendered length."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.length(_opening(t)).alias("chars"), F.lit(False).alias("trained")),
        F.struct(F.length(_body(t)).alias("chars"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("trained")),
    )))


def format_preferences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of ``pairs`` (with chosen and rejected, arrays of role and text), and

    n_shared    turns in the common prefix (equal role and text; null equals null)
    prompt      the shared turns, rendered once
    chosen_completion, rejected_completion   the rest of each
    chosen_mask, rejected_mask               runs of (chars, trained) over the completion

    A null conversation counts as one without turns, a null text or role renders as
    nothing, and two equal conversations have empty completions.  Repeated rows are kept;
    other columns are left out.  No shuffle.
    """
    none = F.array().cast(_TURN)
    own = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]  # no clash with the names below
    both = pairs.select(
        *own, F.coalesce(F.col("chosen").cast(_TURN), none).alias("_c"),
        F.coalesce(F.col("rejected").cast(_TURN), none).alias("_r"))
    differs = F.transform(
        F.arrays_zip("_c", "_r"), lambda z, i: F.when(~z["_c"].eqNullSafe(z["_r"]), i))
    shorter = F.least(F.size("_c"), F.size("_r"))
    both = both.withColumn("_n", F.least(shorter, F.coalesce(F.array_min(differs), shorter)))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.size(c))
    return both.select(
        *[F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)], F.col("_n").cast("long").alias("n_shared"),
        _render(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"),
        _render(rest("_c")).alias("chosen_completion"), _mask(rest("_c")).alias("chosen_mask"),
        _render(rest("_r")).alias("rejected_completion"), _mask(rest("_r")).alias("rejected_mask"))


def continued_pairs(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) from rows of turns (conv_id, turn, role, text).

    Chosen is the conversation itself; rejected keeps its first half (rounded down) and
    goes on as the conversation of the next number does after as many turns.  Turns of
    one number are ordered by role and text.  Rows without conv_id belong to no
    conversation; a conversation without a successor keeps its first half alone.
    """
    said = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"], t["text"]))
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(said.cast(_TURN).alias("chosen"))
    later = whole.select((F.col("conv_id") - 1).alias("conv_id"), F.col("chosen").alias("other"))
    half = F.floor(F.size("chosen") / 2).cast("int")
    other = F.coalesce("other", F.array().cast(_TURN))
    rejected = F.concat(
        F.slice("chosen", F.lit(1), half), F.slice(other, half + 1, F.greatest(F.size(other), F.lit(1))))
    return whole.join(later, "conv_id", "left").select("conv_id", "chosen", rejected.alias("rejected"))
