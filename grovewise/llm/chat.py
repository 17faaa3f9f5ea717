"""Preference pairs: the turns that chosen and rejected conversations share become the prompt, once.

Turns are compared in order by role and text up to the first that differs. What follows is each
side's completion, with the spans of it that are learned: the assistant's text and its end mark.

Cases: conversation ids may be of any type that the pairs' ids can be compared with; turns sort by (turn, role, text) with NULLs first; a NULL role or text renders as empty; a missing
side or a NULL id has no turns, so the pair has an empty prompt and a NULL completion; a side that ends with the prefix has an
empty completion; repeated turns are turns, and turns that tie in (turn, role, text) are equal; a conversation is one row, however long;
an empty table gives no pairs; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.plans.lineage import with_dense_id

BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"


def _render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    """array<struct<start, end>>: code points of the rendered turns that are learned."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + len(BEGIN + MIDDLE) + F.char_length(t["role"])
        end = (head + F.char_length(t["text"]) + len(END)).cast("long")
        span = F.array(F.struct(head.cast("long").alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i) == F.get(b, i))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation; only the conversation's own turns meet."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask).

    `turns` has conv_id, turn, role, text; `pairs` has pair_id, chosen_id, rejected_id."""
    c = conversations(turns)
    x = pairs.select("pair_id", "chosen_id", "rejected_id").join(c.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_c")), "chosen_id", "left")
    x = x.join(c.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("_r")), "rejected_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    x = x.withColumn("n_prefix", common_prefix(F.coalesce("_c", none), F.coalesce("_r", none)))
    rest = lambda t: F.when(F.col(t).isNotNull(), F.slice(F.col(t), F.col("n_prefix") + 1, F.greatest(F.size(t), F.lit(1))))
    x = x.withColumn("prompt", _render(F.slice(F.coalesce("_c", none), F.lit(1), F.col("n_prefix")))).withColumn("_c", rest("_c")).withColumn("_r", rest("_r"))
    return x.select("pair_id", "chosen_id", "rejected_id", "n_prefix", "prompt", _render(F.col("_c")).alias("chosen"), _render(F.col("_r")).alias("rejected"), _mask(F.col("_c")).alias("chosen_mask"), _mask(F.col("_r")).alias("rejected_mask"))


def numbered(turns: DataFrame, strict: bool = False) -> DataFrame:
    """Turns with conv_id as a whole number; NULL where it is none, so that text ids of other kinds are in no pair, or with `strict` an error. `ranked_pairs` takes any ids."""
    number = F.expr("try_cast(conv_id AS bigint)")
    if strict:
        said = F.concat(F.lit("not a whole number: conversation "), F.col("conv_id").cast("string"))
        number = F.when(F.col("conv_id").isNotNull() & F.expr("try_cast(CAST(conv_id AS string) AS bigint)").isNull(), F.raise_error(said).cast("bigint")).otherwise(number)
    return turns.select("turn", "role", "text", number.alias("conv_id"))


def neighbours(turns: DataFrame, strict: bool = False) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversation 2k is preferred to 2k + 1, where at least one of them exists."""
    low = F.col("conv_id").bitwiseAND(1)
    ids = numbered(turns, strict).where("conv_id IS NOT NULL").select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id") - low).alias("chosen_id"), (F.col("conv_id") - low + 1).alias("rejected_id"))
    return ids.distinct()


def ranked_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations in order of their ids, of any type with an order, two at a time; a last one without a partner has a NULL one."""
    ids = with_dense_id(turns.select("conv_id").where("conv_id IS NOT NULL").distinct(), ["conv_id"], "_r")
    two = ids.groupBy(F.shiftright("_r", 1).alias("pair_id"))
    return two.agg(F.min_by("conv_id", "_r").alias("chosen_id"), F.min_by(F.when(F.col("_r") % 2 == 1, F.col("conv_id")), F.when(F.col("_r") % 2 == 1, F.col("_r"))).alias("rejected_id"))


def spans_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
