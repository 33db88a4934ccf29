"""Stored trees of digests: updates against trees built anew, comparisons against joins of all files, rows that are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trialspark.sources import digest_tree as T


def files(spark, n):
    return spark.range(n).select(F.concat_ws("/", F.lit("/srv"), (F.col("id") % 7).cast("string"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))


def test_updates_and_differences(spark, tmp_path):
    before = files(spark, 3000)
    tree = T.build(before, "path", "digest", f"{tmp_path}/a")
    assert tree.depth == 2
    number = F.split("path", "/")[3].cast("long")
    changed = before.where(number % 500 == 3).withColumn("digest", F.lit("other"))
    gone = before.where(number % 700 == 5).withColumn("digest", F.lit(None).cast("string"))
    added = spark.createDataFrame([("/new/ä", "n"), ("/new/b", "")], "path string, digest string")
    changes = changed.union(gone).union(added).union(added)
    later = T.update(spark, tree, changes.union(spark.createDataFrame([(None, "x")], "path string, digest string")), "path", "digest")
    want = {**{r["path"]: "changed" for r in changed.collect()}, **{r["path"]: "missing" for r in gone.collect()}, "/new/ä": "added", "/new/b": "added"}
    assert {r["path"]: r["state"] for r in T.differences(spark, tree, later).collect()} == want
    back = {r["path"]: r["state"] for r in T.differences(spark, later, tree).collect()}
    assert {p for p, x in back.items() if x == "missing"} == {"/new/ä", "/new/b"}

    whole = before.join(changes.select("path"), "path", "left_anti").union(changed).union(added)
    anew = T.build(whole, "path", "digest", f"{tmp_path}/b", depth=2)
    assert T.root_digest(spark, anew) == T.root_digest(spark, later) != T.root_digest(spark, tree)
    assert T.differences(spark, later, anew).count() == 0
    undone = T.update(spark, later, changed.union(gone).select("path").join(before, "path").union(added.withColumn("digest", F.lit(None).cast("string"))), "path", "digest")
    assert undone.layers == 3 and T.root_digest(spark, undone) == T.root_digest(spark, tree)


def test_emptied_and_empty_trees(spark, tmp_path):
    few = files(spark, 3)
    tree, none = T.build(few, "path", "digest", f"{tmp_path}/a", depth=1), T.build(few.where("false"), "path", "digest", f"{tmp_path}/b", depth=1)
    assert T.root_digest(spark, none) is None and T.differences(spark, none, none).count() == 0
    assert {r["state"] for r in T.differences(spark, tree, none).collect()} == {"missing"} and T.differences(spark, none, tree).count() == 3
    emptied = T.update(spark, tree, few.withColumn("digest", F.lit(None).cast("string")), "path", "digest")
    assert T.root_digest(spark, emptied) is None and T.differences(spark, emptied, none).count() == 0
    filled = T.update(spark, none, few.union(few), "path", "digest")
    assert T.root_digest(spark, filled) == T.root_digest(spark, tree)
    with pytest.raises(ValueError):
        T.differences(spark, tree, T.build(few, "path", "digest", f"{tmp_path}/c", depth=2))


def test_a_comparison_reads_the_changed_branches(spark, tmp_path, monkeypatch):
    """Rows that leave the scans: a few pages for each changed file and level, of 200,000 files."""
    n, read = 200_000, []
    tree = T.build(files(spark, n), "path", "digest", f"{tmp_path}/a")
    change = files(spark, n).where(F.col("path").isin("/srv/1/1", "/srv/0/77")).withColumn("digest", F.lit("x"))
    later = T.update(spark, tree, change, "path", "digest")
    within = T._within

    def counted(df, name, wanted, size):
        out = within(df, name, wanted, size)
        plan = out._jdf.queryExecution().executedPlan()
        out.collect()
        leaves = plan.collectLeaves()
        read.extend(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "_metadata" not in leaves.apply(i).toString() and str(tmp_path)[-20:] in leaves.apply(i).verboseString(1000))
        return out

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        monkeypatch.setattr(T, "_within", counted)
        assert {(r["path"], r["state"]) for r in T.differences(spark, tree, later).collect()} == {("/srv/1/1", "changed"), ("/srv/0/77", "changed")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert tree.depth == 4 and len(read) > 10 and 100 < sum(read) < 20_000, read


def test_ranges_only_where_they_skip_rows(spark):
    """Nodes nearly everywhere give a scan no ranges, whose tests took most of a comparison's time; few nodes or one branch do."""
    digits = spark.range(4096).select(F.lower(F.lpad(F.hex("id"), 3, "0")).alias("node"))
    assert T._wanted(digits).ranges is None and T._wanted(digits.where("node like '%7' or node like '%8' or node like '%f'")).ranges is None
    assert sorted(T._wanted(digits.where("node in ('07a', '07c', 'fff')")).ranges) == [("07a", "07c"), ("fff", "fff")]
    assert len(T._wanted(digits.where("node like '%00'")).ranges) == 16 and T._wanted(digits.where("false")).ranges == []
    assert T._wanted(spark.createDataFrame([("",)], "node string")).ranges == [("", "")]


def test_many_rows_are_written_by_many_tasks(spark, tmp_path):
    T._store(spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("node"), F.lit("d").alias("digest")), "node", f"{tmp_path}/t", 200_000)
    assert len(list(tmp_path.glob("t/*.parquet"))) >= 3
