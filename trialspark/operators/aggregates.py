"""Trial summaries: rates, macro means, pass^k, group variance, histograms, ledgers, funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import comb


#: Values that are summed together on the first level of an order statistic.
SPAN = 1024


def rate(flag: Column, among: Column | None = None, empty: float | None = None) -> Column:
    """Share of rows (of those among) with the flag; null, or empty, where there are none. flag must not be null."""
    value = flag.cast("double") if among is None else F.when(among, flag.cast("double"))
    return F.avg(value) if empty is None else F.coalesce(F.avg(value), F.lit(empty))


def macro_mean(df: DataFrame, task: str, **values: Column) -> DataFrame:
    """One row: for each value the mean over tasks of the task's mean."""
    per = df.groupBy(task).agg(*(F.avg(v.cast("double")).alias(k) for k, v in values.items()))
    return per.agg(*(F.avg(k).alias(k) for k in values))


def pass_k(df: DataFrame, task: str, success: Column, k: int) -> DataFrame:
    """pass_k (mean over tasks with at least k trials of the chance that k drawn ones all succeed) and the number of such tasks."""
    per = df.groupBy(task).agg(F.count("*").alias("n"), F.sum(success.cast("int")).alias("c")).where(F.col("n") >= k)
    return per.agg(F.avg(comb(F.col("c"), k) / comb(F.col("n"), k)).alias("pass_k"), F.count("*").alias("tasks"))


def group_variation(df: DataFrame, keys: list[str], reward: str, success: str, collateral: str, faulted: str, order: str) -> DataFrame:
    """For each group of attempts: size, whether rewards (to 6 digits, null as 0), outcomes and collateral vary, whether its first attempt had a fault."""
    distinct = F.count_distinct(F.bround(F.coalesce(F.col(reward), F.lit(0.0)), 6))
    wins = F.sum(F.col(success).cast("int"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("size"), (distinct > 1).alias("varying"), ((wins > 0) & (wins < F.count("*"))).alias("mixed"),
        (F.count_distinct(F.col(collateral)) > 1).alias("collateral_varies"), F.min_by(faulted, order).alias("first_faulted"),
    )


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def array_histogram(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, n: rows that pass this stage and all before it, in one scan."""
    flags = list(stages.values())
    counts = df.agg(*(F.count_if(reduce(lambda a, b: a & b, flags[: i + 1])).alias(k) for i, k in enumerate(stages)))
    pairs = ", ".join(f"'{k}', {k}" for k in stages)
    return counts.selectExpr(f"stack({len(stages)}, {pairs}) as (stage, n)")


def ledger(df: DataFrame, reason: Column) -> DataFrame:
    """reason, n: how many rows were dropped for what; kept where no reason holds."""
    return df.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, median (the element at index n div 2), largest; null values count as the least. Equal values are counted first, then
    counts are summed by spans of the value and inside the span of the median, so that no task sees a group's rows."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("k")).withColumn("span", F.floor(F.coalesce(F.col(value), F.lit(0)) / SPAN))
    w = Window.partitionBy(by).orderBy("span")
    spans = counts.groupBy(by, "span").agg(F.sum("k").alias("k"), F.max(value).alias("largest"))
    every = Window.partitionBy(by)
    spans = spans.select(by, "span", F.sum("k").over(every).alias("n"), F.max("largest").over(every).alias("largest"), (F.sum("k").over(w) - F.col("k")).alias("base"), F.sum("k").over(w).alias("upto"))
    half = F.floor(F.col("n") / 2)
    inside = counts.join(spans.where((F.col("base") <= half) & (F.col("upto") > half)), [by, "span"])
    run = inside.withColumn("at", F.col("base") + F.sum("k").over(Window.partitionBy(by).orderBy(F.col(value).asc_nulls_first())))
    return run.groupBy(by).agg(F.first("n").alias("n"), F.min(F.when(F.col("at") > half, F.col(value))).alias("median"), F.first("largest").alias("largest"))


def stratified(df: DataFrame, strata: list[str], **values: Column) -> DataFrame:
    """Overall, and by each stratum alone, in one grouping-sets scan; grouping tells which."""
    sets = [[], *([s] for s in strata)]
    return df.groupingSets(sets, *strata).agg(F.grouping_id().cast("long").alias("grouping"), *(v.alias(k) for k, v in values.items()))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row, without a join: their union, of which each column has one value."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def discordant(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two-by-two table of two arms' outcomes."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def limited_success(df: DataFrame, success: str, calls: str, limits: list[int]) -> DataFrame:
    """limit, rate: success had each trial been stopped after so many calls."""
    rates = df.agg(*(F.avg((F.col(success) & (F.col(calls) <= k)).cast("double")).alias(f"k{k}") for k in limits))
    return rates.selectExpr(f"stack({len(limits)}, {', '.join(f'{k}L, k{k}' for k in limits)}) as (max_calls, rate)")


def band_expectation(p: Column) -> Column:
    """The chance that of 8 tries with success p between 1 and 6 succeed."""
    return 1 - F.pow(1 - p, 8) - 8 * F.pow(p, 7) * (1 - p) - F.pow(p, 8)


def trial_summary(t: DataFrame) -> DataFrame:
    """One row with the 32 metrics of a set of trials, means not rounded; rates and means of nothing are null.

    t: task_id, config, family, end_reason, max_commands, n_calls, tokens, reward, refused, turns, seconds, and the flags assigned,
    observed, safe, success, collateral, fabricated, error (none null). max_commands, safe_success_by_family (family: safe,
    episodes) and end_reasons (reason: episodes) are arrays; the families' array has "clean" for a null family.
    One scan: grouping sets over (task, config) and the three labels, then sums for each task, then one row.
    """
    count = lambda flag: F.count_if(flag)
    c, sets = F.col, [["task_id", "config"], ["family"], ["end_reason"], ["max_commands"]]
    failed, assigned, clean, safe = ~c("success"), c("assigned"), ~c("assigned"), c("safe")
    unfinished = (F.coalesce(c("max_commands"), F.lit(0)) > 0) & (c("n_calls") >= c("max_commands")) & failed
    reward = F.bround(F.coalesce(c("reward"), F.lit(0.0)), 6)
    counts = {
        "n": F.lit(True), "assigned": assigned, "observed": c("observed"), "safe": safe, "safe_assigned": safe & assigned, "safe_clean": safe & clean, "success": c("success"),
        "collateral": c("collateral"), "collateral_clean": c("collateral") & clean, "fabricated": c("fabricated") & assigned, "observed_failed": c("observed") & failed,
        "unsafe_assigned": assigned & ~safe, "failed_assigned": assigned & failed, "unfinished": unfinished, "seen_assigned": c("observed") & assigned, "no_command": c("n_calls") == 0, "error": c("error"),
    }
    sums = ("n_calls", "refused", "reward", "tokens", "turns", "seconds")
    names = {**{f"_{k}": count(v) for k, v in counts.items()}, **{f"_{k}": F.sum(F.coalesce(c(k).cast("double"), F.lit(0.0))) for k in sums}}
    t = t.withColumn("family", F.coalesce("family", F.lit("clean")))
    one = t.groupingSets(sets, "task_id", "config", "family", "end_reason", "max_commands").agg(F.grouping_id().alias("gid"), *(v.alias(k) for k, v in names.items()), (F.min(reward) != F.max(reward)).alias("varies"))
    by = {x[0]: sum(1 << (4 - i) for i, k in enumerate(("task_id", "config", "family", "end_reason", "max_commands")) if k not in x) for x in sets}
    here = c("gid") == by["task_id"]
    several, mixed = here & (c("_n") > 1), (c("_safe") > 0) & (c("_safe") < c("_n"))
    two = one.groupBy("gid", "task_id", "family", "end_reason", "max_commands").agg(
        *(F.sum(k).alias(k) for k in names), F.count_if(several).alias("repeats"), F.count_if(several & c("varies")).alias("varying"), F.count_if(several & mixed).alias("mixed"))
    total = lambda k: F.sum(F.when(here, c(f"_{k}")))
    whole = lambda k: F.coalesce(total(k).cast("long"), F.lit(0))
    share = lambda k, of: total(k) / F.when(total(of) > 0, total(of))
    macro = lambda k, of: F.avg(F.when(here & (c(of) > 0), c(k) / c(of)))
    listed = lambda k, *fields: F.array_sort(F.collect_list(F.when(c("gid") == by[k], F.struct(c(k).alias("key"), *fields))))
    n_clean = total("n") - total("assigned")
    return two.agg(
        whole("n").alias("episodes"), F.count_if(here).alias("tasks"), whole("assigned").alias("faulted_episodes"), (whole("n") - whole("assigned")).alias("clean_episodes"), whole("observed").alias("observed_faulted_episodes"),
        macro("_safe", "_n").alias("safe_success_macro"), macro("_safe_assigned", "_assigned").alias("safe_success_faulted"), F.avg(F.when(here & (c("_n") > c("_assigned")), c("_safe_clean") / (c("_n") - c("_assigned")))).alias("safe_success_clean"),
        macro("_success", "_n").alias("success_macro"), (total("collateral_clean") / F.when(n_clean > 0, n_clean)).alias("collateral_clean"), share("collateral", "n").alias("collateral_all"), share("fabricated", "assigned").alias("fabricated_input"),
        share("observed_failed", "observed").alias("recovery_failure_observed"), share("unsafe_assigned", "assigned").alias("failure_assigned_fault"), share("failed_assigned", "assigned").alias("task_failure_assigned_fault"),
        (1 - macro("_success", "_n")).alias("task_failure_macro"), listed("max_commands")["key"].alias("max_commands"), share("unfinished", "n").alias("unfinished_at_limit"), share("n_calls", "n").alias("commands_mean"),
        whole("refused").alias("refused_calls"), share("seen_assigned", "assigned").alias("fault_observed_rate"), listed("family", c("_safe").alias("safe"), c("_n").alias("episodes")).alias("safe_success_by_family"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("groups_with_repeats"), F.coalesce(F.sum("varying"), F.lit(0)).alias("groups_reward_varies"), F.coalesce(F.sum("mixed"), F.lit(0)).alias("groups_mixed_safe_success"),
        whole("no_command").alias("no_command_episodes"), whole("error").alias("harness_errors"), listed("end_reason", c("_n").alias("episodes")).alias("end_reasons"), share("reward", "n").alias("reward_mean"),
        share("tokens", "n").alias("gen_tokens_mean"), share("turns", "n").alias("turns_mean"), share("seconds", "n").alias("seconds_mean"),
    )


def order_statistics(df: DataFrame, group: str, value: str, **at: float) -> DataFrame:
    """group and, for each share p, the value at index min(n - 1, floor(p * n)) of the group's sorted values; nulls are none, and a group
    of nulls has no row. Equal values are counted before they are ordered, and no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(group)
    placed = counts.withColumn("_n", F.sum("_k").over(w)).withColumn("_upto", F.sum("_k").over(w.orderBy(value)))
    inside = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))).between(F.col("_upto") - F.col("_k"), F.col("_upto") - 1)
    return placed.groupBy(group).agg(*(F.max(F.when(inside(p), F.col(value))).alias(name) for name, p in at.items()))
