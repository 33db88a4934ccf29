"""Deterministic assignment by hash: rows, splits, halves, treatments, roles, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import h12, last_hex_digit
from trialspark.shared import written


def rows_of(tasks: DataFrame, task: str, salt: str, configs: int, attempts: int) -> DataFrame:
    """tasks crossed with configurations and attempts, and a row_id composed of them."""
    grid = tasks.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(configs - 1)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return grid.withColumn("row_id", F.concat_ws(":", F.lit(salt), F.col(task).cast("string"), F.concat(F.lit("c"), "config"), F.concat(F.lit("a"), "attempt")))


def hash_split(key: Column, salt: str) -> Column:
    """Sixteenths by the last hexadecimal digit: 8 train, 2 dev, 2 gate, 4 test."""
    digit = last_hex_digit(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256))
    return F.when(digit < 8, "train").when(digit < 10, "dev").when(digit < 12, "gate").otherwise("test")


def treated(key: Column, salt: str, share: float) -> Column:
    return (h12(salt, key) % 1_000_000) / 1e6 < share


def picked(options: Column, *key: Column | str) -> Column:
    """The element of a sorted array chosen by hash; null if it is empty."""
    return F.when(F.size(options) > 0, F.get(options, (h12(*key) % F.size(options)).cast("int")))


def roles(groups: DataFrame, group: str, exposed: str, order: str, sizes: dict[str, int], rest: str, least: int = 0) -> DataFrame:
    """groups with role: in hash order the first so many not exposed ones get each role, the others and the exposed ones rest. Only as many
    groups as the sizes add up to are ranked; a null exposed is not exposed. One row for each group. Fewer groups than least, exposed
    ones included, are an error: no role is given then."""
    if least and (n := groups.limit(least).count()) < least:
        raise ValueError(f"{n} groups, at least {least} are needed")
    first = groups.where(~F.coalesce(F.col(exposed), F.lit(False))).select(group, order).orderBy(order, group).limit(sum(sizes.values()))
    ranked = first.withColumn("at", F.row_number().over(Window.orderBy(order, group)))  # of as many rows as all sizes
    role, upto = F.when(F.col("at").isNull(), rest), 0
    for name, n in sizes.items():
        upto += n
        role = role.when(F.col("at") <= upto, name)
    ranked = ranked.select(F.col(group).alias("_group"), role.alias("role"))
    return groups.join(ranked, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group").withColumn("role", F.coalesce("role", F.lit(rest)))


#: Rows of one group that are ranked in one task, and hexadecimal digits by which a level of a selection counts.
RANKED, DIGITS = 100_000, 3


def within(df: DataFrame, group: str, h: str, tie: str, k: DataFrame, most: int = RANKED) -> DataFrame:
    """df with within: whether a row is among the first k of its group by h (hexadecimal digits of even spread), then tie. k has one row
    (group, k) for each group; groups without one have none within.

    The place of the k-th row is sought level by level: rows are counted by the next digits of h, and only those that share the digits
    of the k-th are counted again, until they are few enough to be ranked. No group is ordered as a whole. Rows with one and the
    same h stay together, so these must be few.
    """
    at = k.select(F.col(group).alias("_g"), F.lit("").alias("_p"), F.col("k").cast("long").alias("_need"))
    digits = 0
    w = Window.partitionBy("_g")
    while True:
        digits += DIGITS
        near = df.join(at, F.col(group) == F.col("_g")).where(F.substring(h, 1, digits - DIGITS) == F.col("_p"))
        counts = near.groupBy("_g", "_need", F.substring(h, 1, digits).alias("_p")).agg(F.count("*").alias("_n"))  # some thousand a group at most
        upto = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_p")))
        last = upto.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        at, _ = written(last.select("_g", "_p", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), "_n"), "places")
        if digits >= 12 or not (at.agg(F.max("_n")).first()[0] or 0) > most:
            break
        at = at.drop("_n")
    size = k.select(F.col(group).alias("_of"), F.col("k").alias("_k"))
    placed = df.join(at, F.col(group) == F.col("_g"), "left").join(size, F.col(group) == F.col("_of"), "left")
    mine = F.substring(h, 1, digits)
    names = [F.col(c) for c in df.columns]
    sure = placed.where(F.col("_p").isNull() | (mine != F.col("_p"))).select(*names, F.coalesce(mine < F.col("_p"), F.coalesce(F.col("_k"), F.lit(0)) > 0).alias("within"))
    ranked = placed.where(mine == F.col("_p")).withColumn("_at", F.row_number().over(w.orderBy(h, tie)))
    return sure.union(ranked.select(*names, (F.col("_at") <= F.col("_need")).alias("within")))


def hash_order(df: DataFrame, key: Column | str, salt: str, limit: int, skip: int = 0) -> DataFrame:
    """limit rows after the first skip in hash order. Rows to skip are found by counts, not ordered; the limit is the feature, and what
    it leaves is ordered at the end."""
    c = F.col(key) if isinstance(key, str) else key
    rows = df.withColumn("h", h12(salt, c)).withColumn("_key", c).withColumn("_hex", F.lpad(F.lower(F.hex("h")), 12, "0")).withColumn("_all", F.lit(0))
    if skip > RANKED:
        before = rows.sparkSession.createDataFrame([(0, skip)], "_all int, k long")
        rows = within(rows, "_all", "_hex", "_key", before).where(~F.col("within")).drop("within")
        skip = 0
    return rows.orderBy("h", "_key").offset(skip).limit(limit).drop("_key", "_hex", "_all")
