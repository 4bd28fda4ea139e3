"""Preference pairs from conversations, in DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what follows
on either side becomes that side's completion, with the spans of it that training should learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers around a turn: before its role, between role and text, after its text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT_ROLE = "assistant"


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))))


def _learnt(turns: Column) -> Column:
    """[start, stop) in characters of each learnt turn's text and closing marker within the rendered turns."""
    spans = "array<struct<start: int, stop: int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start = (acc["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])).cast("int")
        stop = (start + F.length(t["text"]) + F.lit(len(CLOSE))).cast("int")
        more = F.array(F.struct(start.alias("start"), stop.alias("stop"))).cast(spans)
        return F.struct(stop.alias("at"), F.when(t["role"] == LEARNT_ROLE, F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, begin, add, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen_col: str = "chosen_turns", rejected_col: str = "rejected_turns") -> DataFrame:
    """Takes arrays of (role, text) turns and adds n_common, prompt, chosen, rejected, chosen_learnt, rejected_learnt.

    Turns are equal if role and text are. If one side is the prefix of the other its completion is empty; of equal
    sides both are. A null or empty side leaves no common prefix. Within turns, nulls count as empty.
    """
    none = F.array().cast("array<struct<role: string, text: string>>")
    text = lambda c: F.coalesce(c, F.lit(""))
    plain = lambda c: F.coalesce(F.transform(c, lambda t: F.struct(text(t["role"]).alias("role"), text(t["text"]).alias("text"))), none)
    d = pairs.withColumn(chosen_col, plain(chosen_col)).withColumn(rejected_col, plain(rejected_col))
    # zip_with fills the shorter side with nulls, so the first difference is at most one past its end.
    differs = F.array_position(F.zip_with(chosen_col, rejected_col, lambda a, b: a.eqNullSafe(b)), False)
    d = d.withColumn("n_common", F.when(differs == 0, F.size(chosen_col)).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    d = d.withColumn("prompt", _rendered(F.slice(F.col(chosen_col), F.lit(1), F.col("n_common"))))
    for side, c in (("chosen", chosen_col), ("rejected", rejected_col)):
        d = d.withColumn(side, _rendered(rest(c))).withColumn(f"{side}_learnt", _learnt(rest(c)))
    return d.drop(chosen_col, rejected_col)


def pair_conversations(turns: DataFrame, pair: Column, rejected: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Gathers the turns of each pair's two conversations: pair_id, chosen_id, rejected_id and the two arrays of turns.

    ``pair`` names a row's pair and ``rejected`` its side. Turns go by number, then role and text, nulls first;
    repeated rows stay. Rows without a pair belong to none and are left out. A pair with one side only keeps that side, with
    a null id and no turns on the other. One shuffle; a pair, which becomes one row, is the most that meets in a place.
    """
    rows = turns.select(pair.alias("pair_id"), F.coalesce(rejected, F.lit(False)).alias("is_rejected"), F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    rows = rows.where(F.col("pair_id").isNotNull())
    side = lambda c, is_rejected: F.when(F.col("is_rejected") == is_rejected, F.col(c))
    aggs = [F.min(side("conv", False)).alias("chosen_id"), F.min(side("conv", True)).alias("rejected_id"), F.sort_array(F.collect_list(side("t", False))).alias("chosen_turns"), F.sort_array(F.collect_list(side("t", True))).alias("rejected_turns")]
    return rows.groupBy("pair_id").agg(*aggs)


def preference_rows(turns: DataFrame, pair: Column, rejected: Column, **columns: str) -> DataFrame:
    """``pair_conversations``, then ``format_pairs``. An empty table gives an empty result; other columns are ignored."""
    return format_pairs(pair_conversations(turns, pair, rejected, **columns))


def swapped_answers(neighbours: DataFrame) -> DataFrame:
    """Preference pairs from two conversations a row (``pair_conversations``): each conversation is chosen as it is, and
    rejected with its last answer, the text of its last ``LEARNT_ROLE`` turn, replaced by that of its neighbour's last answer.

    pair_id is the conversation's id, rejected_id that of the neighbour. The two sides share all turns before that answer.
    Without an answer on the neighbour's side the rejected one lacks the turn; without one on its own the sides are equal.
    A neighbour that has no turns lends nothing; a missing conversation (null id) makes no pair.
    """
    turn = "struct<role: string, text: string>"

    def side(own: str, other: str) -> Column:
        last = F.array_max(F.transform(f"{own}_turns", lambda t, i: F.when(t["role"] == LEARNT_ROLE, i)))
        answers = F.filter(f"{other}_turns", lambda t: t["role"] == LEARNT_ROLE)
        lent = F.get(answers, F.size(answers) - 1)
        turns = F.transform(f"{own}_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")).cast(turn))
        answer = F.struct(F.lit(LEARNT_ROLE).alias("role"), lent["text"].alias("text")).cast(turn)
        before = F.slice(turns, F.lit(1), last)
        behind = F.slice(turns, last + 2, F.greatest(F.size(turns), F.lit(1)))
        given = F.when(lent.isNull(), F.array().cast(f"array<{turn}>")).otherwise(F.array(answer))
        swapped = F.when(last.isNull(), turns).otherwise(F.concat(before, given, behind))
        return F.struct(F.col(f"{own}_id").alias("pair_id"), F.col(f"{own}_id").alias("chosen_id"), F.col(f"{other}_id").alias("rejected_id"), turns.alias("chosen_turns"), swapped.alias("rejected_turns"))

    both = neighbours.select(F.explode(F.array(side("chosen", "rejected"), side("rejected", "chosen"))).alias("p")).select("p.*")
    return both.where(F.col("pair_id").isNotNull())
