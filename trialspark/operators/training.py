"""Training sets out of verified trajectories: filters, assembly, masks, batches, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import joined_ids, joined_mask, supervised_positions


def safe_success(success: Column, collateral: Column, error: Column, truncated: Column, has_ids: Column, end: Column) -> Column:
    return success & ~collateral & ~error & ~truncated & has_ids & ~end.isin("truncated", "length_budget")


def assembled(df: DataFrame, prompt: str, completion: str, mask: str, most: int) -> DataFrame:
    """df with ids, train_mask, supervised (number of tokens that are trained on) and too_long."""
    x = df.withColumn("ids", joined_ids(F.col(prompt), F.col(completion))).withColumn("train_mask", joined_mask(F.col(prompt), F.col(mask)))
    return x.withColumn("supervised", F.size(supervised_positions(F.col("train_mask"))).cast("long")).withColumn("too_long", F.size("ids") > most)


def conversation_tokens(df: DataFrame, conversation: str, turn: str, role: str, text: str, trained: list[str]) -> DataFrame:
    """conversation, tokens, mask: the words of all turns in order, 1 for those of the trained roles. One conversation is one row."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \t\r\n]+"), lambda w: w != "")
    turns = df.select(conversation, F.struct(F.col(turn).alias("turn"), words.alias("w"), F.col(role).isin(*trained).cast("int").alias("m")).alias("t"))
    c = turns.groupBy(conversation).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return c.select(conversation, F.flatten(F.transform("t", lambda t: t["w"])).alias("tokens"), F.flatten(F.transform("t", lambda t: F.array_repeat(t["m"], F.size(t["w"])))).alias("mask"))


def demonstrations(records: DataFrame, key: str, episodes: str, most: int, bad_ends: list[str]) -> DataFrame:
    """One row for each of the first most passing episodes of a record that did not end badly; the cap comes before the filter."""
    first = records.select(key, F.explode(F.slice(F.filter(episodes, lambda e: e["passed"]), 1, most)).alias("e"))
    return first.where(~F.col("e.end").isin(*bad_ends)).select(key, "e.*")


def batches(df: DataFrame, order: Column, key: str, size: int, chunks: int = 64) -> DataFrame:
    """df with batch: groups of size rows in hash order. Ranks come from two levels of counts, so no task ranks all rows."""
    x = df.withColumn("order", order).withColumn("piece", F.floor(F.col("order") / (2.0**48 / chunks)))
    sums = x.groupBy("piece").agg(F.count("*").alias("k"))
    base = sums.select("piece", F.coalesce(F.sum("k").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rn = F.row_number().over(Window.partitionBy("piece").orderBy("order", key))
    return x.withColumn("rn", rn).join(base, "piece").withColumn("batch", F.floor((F.col("base") + F.col("rn") - 1) / size)).drop("order", "piece", "rn", "base")


def user_message(instruction: Column, budget: Column) -> Column:
    return F.when(budget.isNull(), instruction).otherwise(F.concat(instruction, F.lit("\n\nYou may use at most "), budget.cast("string"), F.lit(" commands.")))


def prompt(system: str, message: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), message.alias("content")))


def without_padding(ids: Column, pad: int) -> Column:
    """ids up to the last one that is no padding."""
    last = F.array_max(F.filter(F.transform(ids, lambda x, i: F.when(x != pad, i + 1)), lambda i: i.isNotNull()))
    return F.slice(ids, F.lit(1), F.coalesce(last, F.lit(0)))
