"""A stored tree of digests over many files: updates and comparisons read the changed branches only.

A file lies in the bucket named by the first digits of its path's SHA-256, so buckets are even whatever the folders are; a node
is a prefix of bucket names, its digest covers its (at most 16) children, the root's covers every file. A tree is a folder:

    leaves/layer=N   bucket, path, digest
    nodes/layer=N/level=L   node, digest; null where nothing is left below

Layer 0 is the whole tree, an update adds a layer with the buckets and nodes that it touches; the highest layer of a node counts.
Tables are sorted by name and have short pages, so that ranges of names reach the scan as filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.shared import materialise

#: Files of a bucket on average at most, rows of a stored page, rows of a table's file, which one task sorts and writes.
BUCKET, PAGE, FILE_ROWS = 16, 256, 1 << 16


@dataclass(frozen=True)
class Tree:
    """A stored tree: its folder, the digits of a bucket's name, its layers."""

    root: str
    depth: int
    layers: int


def _store(df: DataFrame, name: str, path: str, rows: int) -> None:
    parts = max(1, -(-rows // FILE_ROWS))
    df.repartitionByRange(parts, name).sortWithinPartitions(name).write.option("parquet.page.row.count.limit", PAGE).parquet(path)


def _bucket(depth: int) -> Column:
    return F.substring(F.sha2("path", 256), 1, depth)


def _leaf_digests(leaves: DataFrame) -> DataFrame:
    """node, digest of buckets. A bucket is small: paths are unique and spread by their hash."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", F.sha2("path", 256), "digest")))
    return leaves.groupBy(F.col("bucket").alias("node")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def _parents(children: DataFrame, level: int) -> DataFrame:
    """node, digest of level from its children's rows (null digests are no children)."""
    lines = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.concat_ws(" ", "node", "digest"))))  # 16 at most
    up = children.groupBy(F.substring("node", 1, level).alias("node")).agg(lines.alias("l"))
    return up.select("node", F.when(F.size("l") > 0, F.sha2(F.array_join("l", "\n"), 256)).alias("digest"))


def _unique(files: DataFrame, path: str, digest: str) -> DataFrame:
    rows = files.select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(digest), F.lit("")).alias("digest")).where("path is not null")
    return rows.groupBy("path").agg(F.max("digest").alias("digest"))


def build(files: DataFrame, path: str, digest: str, root: str, depth: int | None = None) -> Tree:
    """The tree of files (path, digest), stored at root. Rows without a path are left out, a null digest counts as empty, of rows of
    one path the greatest digest counts. depth: digits of a bucket's name, else by the number of files; trees that are to be
    compared need the same. No files give a tree without nodes."""
    leaves = materialise(_unique(files, path, digest), "leaves")
    n = leaves.count()
    if depth is None:
        depth = 0
        while n > BUCKET * 16**depth:
            depth += 1
    spark = files.sparkSession
    leaves = leaves.select(_bucket(depth).alias("bucket"), "path", "digest")
    _store(leaves, "bucket", f"{root}/leaves/layer=0", n)
    below = _leaf_digests(spark.read.parquet(f"{root}/leaves/layer=0"))
    for level in range(depth, -1, -1):
        at = f"{root}/nodes/layer=0/level={level}"
        _store(below, "node", at, min(n, 16**level))
        below = _parents(spark.read.parquet(at), level - 1) if level else below
    return Tree(root, depth, 1)


@dataclass(frozen=True)
class Wanted:
    """Nodes of one level whose rows are to be read, and the ranges of names that they lie in; no ranges: nearly everywhere."""

    nodes: DataFrame
    ranges: list[tuple[str, str]] | None


def _wanted(nodes: DataFrame) -> Wanted:
    """nodes with a range for each of 256 prefixes at most. Where more than 16 of them cover over half of all names, a scan that tests
    them skips next to nothing, and has none."""
    found = nodes.groupBy(F.substring("node", 1, 2)).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).collect()
    covered = sum((int(r["hi"] or "0", 16) - int(r["lo"] or "0", 16) + 1) / 16 ** len(r["lo"]) for r in found)
    return Wanted(nodes, None if len(found) > 16 and covered > 0.5 else [(r["lo"], r["hi"]) for r in found])


def _within(df: DataFrame, name: str, wanted: Wanted, size: int) -> DataFrame:
    """Rows of df whose first size letters of name are a wanted node. The ranges reach the scan; the join does the rest."""
    if wanted.ranges is not None:
        if not wanted.ranges:
            return df.where("false")
        parts = [(F.col(name) >= lo) & (F.col(name) < hi + "g") for lo, hi in wanted.ranges]  # g follows every digit
        while len(parts) > 1:
            parts = [reduce(lambda x, y: x | y, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        df = df.where(parts[0])
    return df.join(wanted.nodes.select(F.col("node").alias("_node")), F.substring(name, 1, size) == F.col("_node"), "left_semi")


def _nodes(spark: SparkSession, tree: Tree, level: int, parents: Wanted | None) -> DataFrame:
    """node, digest of a level below the given nodes of the level above, as the highest layer has them."""
    layers = [spark.read.schema("node string, digest string").parquet(f"{tree.root}/nodes/layer={i}/level={level}").withColumn("layer", F.lit(i)) for i in range(tree.layers)]
    rows = reduce(DataFrame.union, [x if parents is None else _within(x, "node", parents, level - 1) for x in layers])
    return rows.groupBy("node").agg(F.max_by("digest", "layer").alias("digest"))


def _leaves(spark: SparkSession, tree: Tree, buckets: Wanted) -> DataFrame:
    """bucket, path, digest of files in the given buckets, as the highest layer has each bucket; a path without digest marks an
    emptied bucket."""
    layers = [spark.read.schema("bucket string, path string, digest string").parquet(f"{tree.root}/leaves/layer={i}").withColumn("layer", F.lit(i)) for i in range(tree.layers)]
    rows = reduce(DataFrame.union, [_within(x, "bucket", buckets, tree.depth) for x in layers])
    last = rows.groupBy(F.col("bucket").alias("_b")).agg(F.max("layer").alias("_last"))
    return rows.join(last, (F.col("bucket") == F.col("_b")) & (F.col("layer") == F.col("_last"))).where("path is not null").select("bucket", "path", "digest")


def update(spark: SparkSession, tree: Tree, changes: DataFrame, path: str, digest: str) -> Tree:
    """The tree after changes (path, digest; null: the file is gone), as one more layer. Read are the touched buckets and, level by
    level, the children of touched nodes; the tree as it was stays readable."""
    rows = changes.select(F.col(path).cast("string").alias("path"), F.col(digest).alias("new")).where("path is not null")
    rows = materialise(rows.groupBy("path").agg(F.max("new").alias("new")).withColumn("bucket", _bucket(tree.depth)), "changes")
    touched = materialise(rows.select(F.col("bucket").alias("node")).distinct(), "touched")
    n = rows.count()
    old = _leaves(spark, tree, _wanted(touched))
    kept = old.join(rows.select("path"), "path", "left_anti").select("bucket", "path", "digest").union(rows.where("new is not null").select("bucket", "path", F.col("new").alias("digest")))
    emptied = touched.join(kept.select(F.col("bucket").alias("node")), "node", "left_anti").select(F.col("node").alias("bucket"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("digest"))
    at = f"{tree.root}/leaves/layer={tree.layers}"
    _store(kept.union(emptied), "bucket", at, n * BUCKET)
    found = spark.read.schema("bucket string, path string, digest string").parquet(at)
    below = touched.join(_leaf_digests(found.where("path is not null")), "node", "left")
    for level in range(tree.depth, -1, -1):
        at = f"{tree.root}/nodes/layer={tree.layers}/level={level}"
        _store(below, "node", at, n)
        if level:
            new = spark.read.schema("node string, digest string").parquet(at)
            parents = materialise(new.select(F.substring("node", 1, level - 1).alias("node")).distinct(), "parents")
            same = _nodes(spark, tree, level, _wanted(parents)).join(new.select("node"), "node", "left_anti")
            below = _parents(same.union(new), level - 1)
    return Tree(tree.root, tree.depth, tree.layers + 1)


def root_digest(spark: SparkSession, tree: Tree) -> str | None:
    """The digest of all files; None where there are none."""
    row = _nodes(spark, tree, 0, None).first()
    return row["digest"] if row else None


def differences(spark: SparkSession, before: Tree, after: Tree) -> DataFrame:
    """path, state (added, changed, missing) of files that differ: from the root down, only below nodes whose digests differ."""
    if before.depth != after.depth:
        raise ValueError(f"trees of {before.depth} and of {after.depth} levels cannot be compared: build them with one depth")
    differing: Wanted | None = None
    for level in range(before.depth + 1):
        a, b = (_nodes(spark, t, level, differing).select("node", F.col("digest").alias(n)) for t, n in ((before, "a"), (after, "b")))
        differing = _wanted(materialise(a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "differing"))
    a, b = (_leaves(spark, t, differing).select("path", F.col("digest").alias(n)) for t, n in ((before, "a"), (after, "b")))
    both = a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed").alias("state"))
