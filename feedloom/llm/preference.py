"""Preference formatting: the longest common turn prefix of two conversations is the prompt, rendered once; the turns
behind it are the two completions, with masks over what the assistant says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: OPEN role NEXT text CLOSE.
OPEN, NEXT, CLOSE = "<|", "|>\n", "<|end|>\n"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(NEXT), t["text"], F.lit(CLOSE))), "")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the conversations share from the start (role and text alike)."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.get(unlike, F.lit(0))


def mask(turns: Column, role: str = "assistant") -> Column:
    """Spans (start, stop: characters of the rendered turns) of the texts of the role, with the closing mark."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN + NEXT + CLOSE)
    empty = F.lit(None).cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))

    def step(s: Column, t: Column) -> Column:
        stop = s["at"] + size(t)
        low = stop - F.length(t["text"]) - len(CLOSE)
        own = F.struct(low.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(t["role"] == role, F.array_append(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def conversations(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: id, turns (array of role and text). Turns go by number, then role and text; null roles and texts are empty."""
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy(F.col(id_column).alias(id_column)).agg(turns.alias("turns"))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds prompt_turns, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask and usable to pairs of turn arrays.

    Mask spans count from the start of a completion; the prompt is never trained on. usable: both completions have an
    assistant's turn and differ. Equal conversations have a whole prompt and empty completions. Null arrays are empty.
    Columns of pairs that have one of these names are replaced. Texts are rendered as they are: a closing mark inside a
    text is not escaped, and the spans, which count characters, hold all the same.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    c, r, n = F.col("__c"), F.col("__r"), F.col("prompt_turns")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    out = pairs.withColumns({"__c": F.coalesce(F.col(chosen), none), "__r": F.coalesce(F.col(rejected), none)}).withColumn("prompt_turns", common_turns(c, r))
    out = out.withColumn("prompt", render(F.slice(c, 1, n))).withColumns({"__c": rest(c), "__r": rest(r)})
    out = out.withColumns({"chosen_text": render(c), "rejected_text": render(r), "chosen_mask": mask(c), "rejected_mask": mask(r)}).drop("__c", "__r")
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0) & (F.col("chosen_text") != F.col("rejected_text")))


def swapped_answers(talks: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Pairs for tables without preferences: a conversation up to its last assistant turn is chosen; rejected has the
    last answer of the conversation whose id differs in the lowest bit instead, or ends before it if there is none.
    A conversation without an assistant turn has no answer to compare, so it gives no pair."""
    answers = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    last = talks.withColumn("last", F.array_max(answers)).where("last is not null")
    own = last.select(F.col(id_column).bitwiseXOR(F.lit(1)).alias("partner"), F.get("turns", F.col("last")).alias("answer"))
    both = last.join(own, F.col(id_column) == F.col("partner"), "left")
    before = F.slice("turns", 1, F.col("last"))
    swapped = F.when(F.col("answer").isNull(), before).otherwise(F.concat(before, F.array("answer")))
    return both.select(id_column, F.slice("turns", 1, F.col("last") + 1).alias("chosen"), swapped.alias("rejected"))
