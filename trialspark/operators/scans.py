"""Running values along runs of any length: chunks are scanned by themselves, what they carry over is scanned by chunk.

The rows are cut into ranges of (run, step) of bounded size, so a run of any length is read by many tasks. The table of
carries has one row for each run of a chunk, and a window over it sees only as many rows as a run has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trialspark.shared import materialise

#: Rows of a chunk, about.
CHUNK = 1 << 18


def chunked(df: DataFrame, run: str, step: str, size: int = CHUNK) -> DataFrame:
    """df with _chunk, which grows with (run, step). It is written, since the bounds of the ranges are found by a sample. Rows of one
    run with equal steps share a chunk."""
    parts = max(1, -(-df.count() // size))
    return materialise(df.repartitionByRange(parts, run, step).withColumn("_chunk", F.spark_partition_id()), "chunks")


def _own(run: str, step: str) -> WindowSpec:
    return Window.partitionBy("_chunk", run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(run: str) -> WindowSpec:
    return Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, carries: DataFrame, run: str) -> DataFrame:
    """Rows with the carry of their run into their chunk; a null run is a run."""
    c = carries.withColumnRenamed(run, "_run").withColumnRenamed("_chunk", "_at")
    return rows.join(c, (F.col("_chunk") == F.col("_at")) & F.col(run).eqNullSafe(F.col("_run"))).drop("_run", "_at", "_chunk")


def running_sum(df: DataFrame, run: str, step: str, amount: str, name: str, size: int = CHUNK) -> DataFrame:
    """df with name: the sum of amount over the run's rows up to this one, in the order of step; null before the first amount."""
    chunks = chunked(df, run, step, size)
    sums = chunks.groupBy("_chunk", run).agg(F.sum(amount).alias("_sum"))
    carries = sums.select("_chunk", run, F.sum("_sum").over(_earlier(run)).alias("_before"))
    both = _carried(chunks.withColumn("_local", F.sum(amount).over(_own(run, step))), carries, run)
    zero = F.lit(0).cast(sums.schema["_sum"].dataType)
    total = F.when(F.col("_local").isNotNull() | F.col("_before").isNotNull(), F.coalesce("_local", zero) + F.coalesce("_before", zero))
    return both.select(*df.columns, total.alias(name))


def running_streak(df: DataFrame, run: str, step: str, bad: Column, name: str, size: int = CHUNK) -> DataFrame:
    """df with name: how many of the run's rows up to this one, in the order of step, are bad without a break; a null breaks. The
    place of a row less the place of the last break: places are a running count, breaks a running maximum, and both carry."""
    chunks = chunked(df.withColumn("_bad", F.coalesce(bad, F.lit(False))), run, step, size)
    w = _own(run, step)
    placed = chunks.withColumn("_place", F.count(F.lit(1)).over(w)).withColumn("_break", F.max(F.when(~F.col("_bad"), F.col("_place"))).over(w))
    ends = placed.groupBy("_chunk", run).agg(F.max("_place").alias("_n"), F.max("_break").alias("_last"))
    starts = ends.withColumn("_start", F.coalesce(F.sum("_n").over(_earlier(run)), F.lit(0)))
    carries = starts.select("_chunk", run, "_start", F.coalesce(F.max(F.col("_start") + F.col("_last")).over(_earlier(run)), F.lit(0)).alias("_before"))
    streak = F.col("_start") + F.col("_place") - F.coalesce(F.col("_start") + F.col("_break"), F.col("_before"))
    return _carried(placed, carries, run).select(*df.columns, streak.alias(name))


def running_last(df: DataFrame, run: str, step: str, value: str, name: str, size: int = CHUNK) -> DataFrame:
    """df with name: the last value that is not null in the run's rows up to this one."""
    chunks = chunked(df, run, step, size)
    placed = chunks.withColumn("_local", F.last(value, ignorenulls=True).over(_own(run, step)))
    last = placed.groupBy("_chunk", run).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(step))).alias("_end"))
    carries = last.select("_chunk", run, F.last("_end", ignorenulls=True).over(_earlier(run)).alias("_before"))
    return _carried(placed, carries, run).select(*df.columns, F.coalesce("_local", "_before").alias(name))
