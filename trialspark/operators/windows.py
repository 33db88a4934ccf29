"""Windows over attempts and logs: ranks by hash, latches, streaks, fixed windows, budgets, carried headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.scans import running_streak, running_sum


def first_by(df: DataFrame, group: str, *order: Column | str, keep: int = 1) -> DataFrame:
    """The first rows of each group, with their rank rn."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= keep)


def tiered(df: DataFrame, group: str, order: str, lowest: int, highest: int) -> DataFrame:
    """The first highest rows of each group with tier, at least lowest."""
    return first_by(df, group, order, keep=highest).withColumn("tier", F.greatest("rn", F.lit(lowest))).drop("rn")


def latch(df: DataFrame, episode: str, call: str, event: str, path: str, most: int) -> DataFrame:
    """episode, first_call, events of that call (in order, most so many), n_damaged: distinct paths of all calls. Rows with a null
    episode form none. An episode's rows are counted down before they meet: no task sees all of them."""
    told = df.groupBy(episode).agg(F.min(call).alias("first_call"), F.count_distinct(path).alias("n_damaged"))
    calls = told.select(F.col(episode).alias("_episode"), "first_call")
    own = df.join(calls, (F.col(episode) == F.col("_episode")) & (F.col(call) == F.col("first_call"))).where(F.col(event).isNotNull())
    events = first_by(own, episode, event, keep=most).groupBy(episode).agg(F.array_sort(F.collect_list(event)).alias("events"))  # most so many
    return told.where(F.col(episode).isNotNull()).join(events, episode, "left").select(episode, "first_call", F.coalesce("events", F.array().cast(f"array<{df.schema[event].dataType.simpleString()}>")).alias("events"), "n_damaged")


def streaks(df: DataFrame, run: str, step: str, bad: Column) -> DataFrame:
    """df with streak: how many rows in a row up to this one are bad; what is neither bad nor good ends a streak."""
    return running_streak(df, run, step, bad, "streak")


def fixed_windows(df: DataFrame, run: str, step: str, value: Column, size: int) -> DataFrame:
    """run, block, mean and the previous block's mean, of whole blocks of so many steps (steps count from 1)."""
    b = df.groupBy(run, F.floor((F.col(step) - 1) / size).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") == size)
    return b.withColumn("before", F.lag("mean").over(Window.partitionBy(run).orderBy("block"))).drop("n")


def crossing(df: DataFrame, run: str, step: str, amount: str, cap: float) -> DataFrame:
    """run, step: the first step at which the running total reaches cap."""
    return running_sum(df, run, step, amount, "total").where(F.col("total") >= cap).groupBy(run).agg(F.min(step).alias("stop_step"))


def budget_cut(df: DataFrame, run: str, step: str, length: str, limit: int, strict: bool) -> DataFrame:
    """Rows before the first one at which the running length passes (strict: exceeds; else reaches) the limit, with running."""
    running = running_sum(df, run, step, length, "running")
    over = F.col("running") > limit if strict else F.col("running") >= limit
    cuts = running.where(over).groupBy(F.col(run).alias("_run")).agg(F.min(step).alias("_cut"))
    return running.join(cuts, F.col(run).eqNullSafe(F.col("_run")), "left").where(F.col("_cut").isNull() | (F.col(step) < F.col("_cut"))).drop("_run", "_cut")


def limited(df: DataFrame, run: str, limit: int) -> DataFrame:
    """run, used, ran, refused: of each run's calls so many may run, the later ones are refused. Counts need no order."""
    used = df.groupBy(run).agg(F.count("*").alias("used"))
    return used.select(run, "used", F.least("used", F.lit(limit)).cast("long").alias("ran"), F.greatest(F.col("used") - limit, F.lit(0)).cast("long").alias("refused"))


def carried(df: DataFrame, text: str, heading: Callable[[Column], Column]) -> DataFrame:
    """A row for each line of column text with at (from 0), line, section: the last line at or above it that is a heading. A null text
    has no lines. The lines of a row stay in it until they are exploded, so nothing is shuffled, and each is looked at once."""
    lines = F.col("_lines")
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.coalesce(heading(F.get(lines, i)), F.lit(False)))
    ends = F.concat(F.slice(F.col("_starts"), F.lit(2), F.size("_starts")), F.array(F.size(lines)))
    own = lambda i: F.when(F.coalesce(heading(F.get(lines, i)), F.lit(False)), F.get(lines, i))
    row = lambda i, section: F.struct(i.alias("at"), F.get(lines, i).alias("line"), section.alias("section"))
    parts = F.transform(F.arrays_zip(F.col("_starts").alias("lo"), ends.alias("hi")), lambda b: F.transform(F.sequence(b["lo"], b["hi"] - 1), lambda i: row(i, own(b["lo"]))))
    kept = df.withColumn("_lines", F.split(text, "\n")).where("_lines is not null").withColumn("_starts", starts)
    return kept.select(*df.columns, F.explode(F.flatten(parts)).alias("_l")).select(*df.columns, "_l.*")
