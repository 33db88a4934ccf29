"""File snapshots as tables: diffs against a permitted write set, integrity of inputs, damage sets, residue, change sets."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from trialspark.operators.aggregates import side_by_side
from trialspark.operators.joins import prefix_join

PRELOAD = "/etc/ld.so.preload"
ATTRIBUTES = ("ftype", "mode", "uid", "sha256", "link")


def changed_kinds(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kinds of every path of before that changed; a path that is only in after is no event. A changed type hides a changed
    content, nothing else."""
    now = after.select("path", *(F.col(c).alias(f"now_{c}") for c in ATTRIBUTES), F.lit(True).alias("there"))
    j = before.join(now, "path", "left")
    same_type = F.col("ftype") == F.col("now_ftype")
    kinds = F.when(F.col("there").isNull(), F.array(F.lit("deleted"))).otherwise(
        F.array_compact(F.array(
            F.when(~same_type, "type_changed"), F.when(same_type & (F.col("ftype") == "f") & ~F.col("sha256").eqNullSafe(F.col("now_sha256")), "content_changed"),
            F.when(F.col("mode") != F.col("now_mode"), "mode_changed"), F.when(F.col("uid") != F.col("now_uid"), "owner_changed"),
            F.when(same_type & (F.col("ftype") == "l") & ~F.col("link").eqNullSafe(F.col("now_link")), "link_changed"),
        )))
    return j.select("path", kinds.alias("kinds")).where(F.size("kinds") > 0)


def permitted_kinds(paths: DataFrame, permits: DataFrame) -> DataFrame:
    """path, allowed: the union of kinds over all permit entries that cover the path."""
    return prefix_join(paths.select("path").distinct(), permits).groupBy("path").agg(F.collect_set("kind").alias("allowed"))


def diff(before: DataFrame, after: DataFrame, permits: DataFrame, final: bool = True) -> DataFrame:
    """path, kind of every change that is not permitted. While a run goes on, a missing path is no event if its type may change."""
    changes = changed_kinds(before, after)
    j = changes.join(permitted_kinds(changes, permits), "path", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    left = F.array_except("kinds", "allowed")
    if not final:
        transient = F.array_contains("kinds", "deleted") & F.array_contains("allowed", "type_changed")
        left = F.when(transient, F.array().cast("array<string>")).otherwise(left)
    return j.select("path", F.explode(left).alias("kind"))


def input_integrity(faults: DataFrame, pristine: DataFrame, now: DataFrame, final: bool) -> DataFrame:
    """run, problem for faults (run, target, spare): replaced (the bytes at the target are others, neither its own nor moved),
    fabricated (other bytes, and final or not empty, while the spare holds the original), lost (nobody holds the original)."""
    own = pristine.select(F.col("path").alias("target"), F.col("sha256").alias("original"))
    here = now.select(F.col("path").alias("target"), F.col("sha256").alias("at_target"), F.col("size").alias("target_size"))
    there = now.select(F.col("path").alias("spare"), F.col("sha256").alias("at_spare"))
    j = faults.join(own, "target").join(here, "target", "left").join(there, "spare", "left")
    other = F.col("at_target").isNotNull() & (F.col("at_target") != F.col("original"))
    held_here, held_there = (F.coalesce(F.col(c) == F.col("original"), F.lit(False)) for c in ("at_target", "at_spare"))
    real = other & (F.lit(final) | (F.col("target_size") > 0))
    problem = F.when(real & held_there, "input_fabricated").when(real, "input_replaced").when(~held_here & ~held_there, "input_lost")
    return j.select("run", problem.alias("problem"), held_here.alias("cleared"))


def damage_set(gold: DataFrame, damaged: DataFrame, packaged: DataFrame) -> DataFrame:
    """path, change (added, deleted, changed, dir_mode), gold_hash, gold_mode of what a damaged image has other than the gold one.

    Snapshots: path, ftype, mode, size, mtime, link, sha256. Cheap columns (all but the hash) choose candidates; hashes are
    looked at for these only, and a file is changed if its hash, mode or type is another: a touched one is not. Folders count
    by their mode alone. packaged (path): files that packages of the damaged image alone brought; these are not added."""
    cheap = ("ftype", "mode", "size", "mtime", "link")
    b = gold.select("path", *(F.col(c).alias(f"was_{c}") for c in cheap), F.lit(True).alias("was"))
    a = damaged.select("path", *cheap, F.lit(True).alias("is"))
    differs = ~(F.struct(*cheap).eqNullSafe(F.struct(*(F.col(f"was_{c}").alias(c) for c in cheap))))
    c = b.join(a, "path", "full_outer").where(F.col("was").isNull() | F.col("is").isNull() | differs)
    folder = F.coalesce("ftype", "was_ftype") == "d"
    in_both = F.col("was").isNotNull() & F.col("is").isNotNull()
    mode, kind = ~F.col("mode").eqNullSafe(F.col("was_mode")), F.col("ftype") != F.col("was_ftype")
    c = c.where(~folder | (in_both & mode)).select("path", "was", "is", folder.alias("folder"), F.col("was_mode").alias("gold_mode"), (mode | kind).alias("other"))
    c = c.join(packaged.select("path").distinct().withColumn("packaged", F.lit(True)), "path", "left").where(F.col("was").isNotNull() | F.col("packaged").isNull())
    hashed = c.join(gold.select("path", F.col("sha256").alias("gold_hash")), "path", "left").join(damaged.select("path", F.col("sha256").alias("now_hash")), "path", "left")
    change = F.when(F.col("folder"), "dir_mode").when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("other") | ~F.col("gold_hash").eqNullSafe(F.col("now_hash")), "changed")
    return hashed.select("path", change.alias("change"), "gold_hash", "gold_mode").where("change is not null")


def merged_usr(path: Column) -> Column:
    """The path, and its place under /usr if it lies in a folder that was merged there."""
    return F.array_compact(F.array(path, F.when(path.rlike("^/(bin|sbin|lib|lib64)/"), F.concat(F.lit("/usr"), path))))


def is_code(path: Column) -> Column:
    """Whether a path may run: Python files, libraries, programs, loader settings."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    return name.rlike("\\.(py|pth|so)$") | name.contains(".so.") | path.contains("/bin/") | path.contains("/sbin/") | path.startswith("/etc/ld.so")


def is_hook(path: Column) -> Column:
    """Whether Python runs the file when it starts: site customisation, or a .pth file of a package folder."""
    below = path.rlike("^(/opt/miniconda3|/usr/lib|/usr/local/lib)/") & ~path.startswith("/opt/miniconda3/pkgs/")
    return below & (path.rlike("/(sitecustomize|usercustomize)\\.py$") | path.rlike("-packages.*\\.pth$"))


@F.pandas_udf(ty.BooleanType())
def same_syntax(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two Python texts have the same syntax tree; false where one has none."""

    def tree(text: str | None) -> str | None:
        try:
            return None if text is None else ast.dump(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return None

    return pd.Series([x is not None and x == y for x, y in ((tree(p), tree(q)) for p, q in zip(a, b, strict=True))])


def residue(damage: DataFrame, gold: DataFrame, now: DataFrame) -> DataFrame:
    """path, problem: what is left of a damage set. No rows: undone.

    damage as damage_set gives it; gold and now: path, sha256, mode, text (of Python files; null elsewhere). Added and deleted files count if
    they are code. added_still_present, missing, content (unless two Python files have the same syntax tree), mode (only where
    the content is right), dir_mode, new_hook (a start-up hook that gold has not), ld_preload (the loader's list is another).
    Texts are compared for Python files with another hash alone."""
    n = now.select("path", F.col("sha256").alias("now_hash"), F.col("mode").alias("now_mode"), F.lit(True).alias("there"))
    code = is_code(F.col("path"))
    d = damage.where(F.col("change").isin("changed", "dir_mode") | code)
    j = d.join(n, "path", "left").withColumn("there", F.col("there").isNotNull())
    there, touched = F.col("there"), F.col("change").isin("changed", "deleted")
    other = touched & there & ~F.col("now_hash").eqNullSafe(F.col("gold_hash"))
    texts = [x.where(F.col("path").endswith(".py")).select("path", F.col("text").alias(name)) for x, name in ((gold, "gold_text"), (now, "now_text"))]
    python = j.where(other & F.col("path").endswith(".py")).select("path").join(texts[0], "path").join(texts[1], "path")
    alike = python.where(same_syntax("gold_text", "now_text")).select("path", F.lit(True).alias("alike"))
    j = j.join(alike, "path", "left")
    problem = (
        F.when((F.col("change") == "added") & there, "added_still_present").when(touched & ~there, "missing").when(other & F.col("alike").isNull(), "content")
        .when(touched & ~other & ~F.col("now_mode").eqNullSafe(F.col("gold_mode")), "mode").when((F.col("change") == "dir_mode") & ~F.col("now_mode").eqNullSafe(F.col("gold_mode")), "dir_mode")
    )
    left = j.select("path", problem.alias("problem")).where("problem is not null")
    hooks = now.where(is_hook(F.col("path"))).select("path").join(gold.select("path"), "path", "left_anti").select("path", F.lit("new_hook").alias("problem"))
    lists = [x.where(F.col("path") == PRELOAD).agg(F.max("sha256").alias(name)) for x, name in ((gold, "a"), (now, "b"))]
    preload = side_by_side(*lists).where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(PRELOAD).alias("path"), F.lit("ld_preload").alias("problem"))
    return left.union(hooks).union(preload)


def apply_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after changes (kind A, C or D, and the columns of the snapshot): what is deleted goes with all below it, what
    is added or changed takes the place of the old row."""
    columns = snapshot.columns
    gone = changes.where("kind = 'D'").select(F.explode(F.array(F.col("path"), F.concat("path", F.lit("/")))).alias("entry")).distinct()
    below = prefix_join(snapshot.select("path"), gone).select("path").distinct()
    kept = snapshot.join(below, "path", "left_anti").select(*columns, F.lit(0).alias("rank"))
    new = changes.where("kind <> 'D'").select(*columns, F.lit(1).alias("rank"))
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("rank")))
    return kept.unionByName(new).withColumn("rn", first).where("rn = 1").select(*columns)
