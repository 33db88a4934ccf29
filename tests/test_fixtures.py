"""Small fixtures with answers worked out by hand, for nulls, ties, orders and boundaries."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialspark.functions import columns as C
from trialspark.operators import aggregates as A
from trialspark.operators import assignment as S
from trialspark.operators import grading as G
from trialspark.operators import inference as I
from trialspark.operators import containment as N
from trialspark.operators import joins as J
from trialspark.operators import snapshots as M
from trialspark.operators import code as PY
from trialspark.operators import text as X
from trialspark.operators import training as B
from trialspark.operators import windows as W
from trialspark.operators.components import connected_components
from trialspark.operators.edits import character_similarity
from trialspark.shared import shared_dir
from trialspark.sources import readers as R
from trialspark.sources.archives import archive_members
from trialspark.streaming import monitors as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_macro_mean_weighs_tasks(spark):
    t = spark.createDataFrame([("t1", 1), ("t1", 1), ("t1", 0), ("t1", 0), ("t2", 1)], "task string, s int")
    assert A.macro_mean(t, "task", m=F.col("s")).first()["m"] == 0.75


def test_rates_of_nothing(spark):
    t = spark.createDataFrame([], "s boolean")
    r = t.agg(A.rate(F.col("s")).alias("none"), A.rate(F.col("s"), empty=0.0).alias("zero")).first()
    assert r["none"] is None and r["zero"] == 0.0


def test_pass_k(spark):
    data = [("t1", i < 4) for i in range(5)] + [("t2", i < 3) for i in range(4)] + [("t3", True)] * 3
    r = A.pass_k(spark.createDataFrame(data, "task string, ok boolean"), "task", F.col("ok"), 4).first()
    assert abs(r["pass_k"] - 0.1) < 1e-12 and r["tasks"] == 2


def test_group_variation_rounds_rewards(spark):
    t = spark.createDataFrame([("a", 0.5, True, False, True, 1), ("a", 0.5000000001, False, False, False, 2)], "g string, r double, s boolean, c boolean, f boolean, o int")
    g = A.group_variation(t, ["g"], "r", "s", "c", "f", "o").first()
    assert (g["varying"], g["mixed"], g["collateral_varies"], g["first_faulted"]) == (False, True, False, True)


def test_upper_median(spark):
    assert tuple(A.upper_median(spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x")], "v int, g string"), "v", "g").first()) == ("x", 4, 3, 4)


def test_order_statistic_and_half_even(spark):
    r = spark.range(1).select(C.order_statistic(F.array(*map(F.lit, (30, 10, 20))), 0.9).alias("hi"), C.order_statistic(F.array(*map(F.lit, (30, 10, 20))), 0.1).alias("lo"), C.half_even(F.lit(0.125), 2).alias("r")).first()
    assert tuple(r) == (30, 10, 0.12)


def test_hash_of_a_null_part(spark):
    import hashlib

    want = int(hashlib.sha256(b"7:None:x").hexdigest()[:12], 16)
    assert spark.range(1).select(C.h12(7, F.lit(None).cast("string"), "x").alias("h")).first()["h"] == want


def test_wilson(spark):
    r = spark.range(1).select(I.wilson(F.lit(0), F.lit(0)).alias("a"), I.wilson(F.lit(1), F.lit(1)).alias("b")).first()
    assert r["a"] == 0.0 and abs(r["b"] - 0.20654) < 1e-4


def test_arm_report(spark):
    frozen = spark.createDataFrame([("a", "-"), ("b", "-"), ("c", "-")], "id string, f string")
    arm = spark.createDataFrame([("a", "-"), ("a", "-"), ("d", "-")], "id string, f string")
    assert tuple(J.arm_report(frozen, arm, "id", "f").first()) == (1, 2, 1, 0)


def test_prefix_join_keeps_to_whole_folders(spark):
    paths = spark.createDataFrame([("/h/a/x",), ("/h/ab",), ("/h/a",)], "path string")
    permits = spark.createDataFrame([("/h/a/", "deleted")], "entry string, kind string")
    assert rows(J.prefix_join(paths, permits).select("path")) == [("/h/a/x",)]


def test_prefix_join_deals_a_folder_of_many_paths(spark):
    """Relative paths have no root above them; a folder's paths are dealt over tasks, and ancestors that are no entry go nowhere."""
    odd = ["a", "", "b/c", "/h/hot/", "/h/a/x", "/h/a/x", None]
    names = odd + [f"/h/hot/{i}" for i in range(300)]
    paths = spark.createDataFrame([(x,) for x in names], "path string")
    permits = [("/", "r"), ("a/", "n"), ("b/", "y"), ("/h/hot/", "p"), ("/h/hot/", "q"), ("/h/hot/7", "z"), ("/h/none/", "p"), (None, "p")]
    want = sorted(((e, p, k) for p in names for e, k in permits if p is not None and e is not None and (p == e or (e.endswith("/") and p.startswith(e)))), key=repr)
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            joined = J.prefix_join(paths, spark.createDataFrame(permits, "entry string, kind string"), hot=20)
            found = joined.select("entry", "path", "kind", F.spark_partition_id()).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert sorted((tuple(r)[:3] for r in found), key=repr) == want
    assert len({r[3] for r in found if r["entry"] == "/h/hot/"}) > 1



SNAP = "path string, ftype string, mode string, uid string, size long, sha256 string, link string"


def test_type_change_hides_content(spark):
    before = spark.createDataFrame([("/a", "f", "644", "0", 1, "x", None), ("/b", "f", "644", "0", 1, "x", None)], SNAP)
    after = spark.createDataFrame([("/a", "l", "777", "0", 1, "y", "/z"), ("/b", "f", "644", "0", 1, "x", None), ("/new", "f", "644", "0", 1, "q", None)], SNAP)
    assert [(r["path"], r["kinds"]) for r in M.changed_kinds(before, after).collect()] == [("/a", ["type_changed", "mode_changed"])]
    assert M.changed_kinds(before, before).count() == 0


@pytest.mark.parametrize(("final", "want"), [(False, []), (True, [("/a", "deleted")])])
def test_transient_absence(spark, final, want):
    before = spark.createDataFrame([("/a", "f", "644", "0", 1, "x", None)], SNAP)
    permits = spark.createDataFrame([("/a", "type_changed")], "entry string, kind string")
    assert rows(M.diff(before, before.limit(0), permits, final)) == want


@pytest.mark.parametrize(("final", "want"), [(False, None), (True, "input_fabricated")])
def test_moved_input(spark, final, want):
    faults = spark.createDataFrame([("r", "/t", "/s")], "run string, target string, spare string")
    pristine = spark.createDataFrame([("/t", "x", 3)], "path string, sha256 string, size long")
    now = spark.createDataFrame([("/t", "empty", 0), ("/s", "x", 3)], "path string, sha256 string, size long")
    assert M.input_integrity(faults, pristine, now, final).first()["problem"] == want


def test_applied_changes_reach_the_target(spark):
    before = spark.createDataFrame([("/d/x", "f", "644", "0", 1, "x", None), ("/d2", "f", "644", "0", 1, "x", None), ("/k", "f", "644", "0", 1, "x", None)], SNAP)
    changes = spark.createDataFrame([("/d", None, None, None, None, None, None, "D"), ("/k", "f", "600", "0", 2, "y", None, "C"), ("/n", "f", "644", "0", 1, "z", None, "A")], SNAP + ", kind string")
    assert rows(M.apply_changes(before, changes).select("path", "mode")) == [("/d2", "644"), ("/k", "600"), ("/n", "644")]


def test_phase_verdicts(spark):
    inventory = spark.createDataFrame([("r", "x"), ("r", "y"), ("r", "z"), ("q", "x"), ("q", "gone")], "run_id string, nodeid string")
    results = spark.createDataFrame([("r", "x", "passed", "passed", "failed"), ("r", "y", "skipped", None, None), ("r", "z", "passed", "passed", None), ("q", "x", "passed", "passed", None)], "run_id string, nodeid string, setup string, call string, teardown string")
    assert rows(G.phase_verdicts(inventory, results)) == [("q", 0, 2, False, 1), ("r", 1, 3, False, 0)]


def test_scores(spark):
    score, error = G.score_of(F.col("t"))
    t = spark.createDataFrame([("1.0",), ("nan",), ("",), ("1.2",), (None,), ("inf",)], "t string")
    assert [tuple(r) for r in t.select(score, error).collect()] == [(1.0, False)] + [(0.0, True)] * 5


def test_discrimination(spark):
    m = spark.createDataFrame([("a", 1, "m1", "caught"), ("a", 1, "m2", "n/a"), ("a", 1, "m3", "n/a"), ("b", 1, "m1", "caught"), ("b", 1, "m2", "survived"), ("b", 1, "m3", "n/a")], "task string, output int, mutant string, result string")
    assert rows(G.discrimination(m)) == [("a", 1, True), ("b", 1, False)]


def test_mutants(spark):
    t = spark.createDataFrame([("v=9 7",), ("no digit",), ("",), (None,)], "t string")
    made = [tuple(r) for r in t.select(*(m.alias(n) for n, m in G.mutants_of(F.col("t")))).collect()]
    assert made[0] == ("", "", "v=0 7", "v=9 7\nv=9 7") and made[1][2] is None and made[2][:3] == (None, None, None) and made[3] == (None,) * 4


def test_normalise(spark):
    assert spark.range(1).select(X.normalise(F.lit("Fix /home/user/a.txt 12  times")).alias("t")).first()["t"] == "fix /PATH NUM times"


def test_head_and_tail(spark):
    shown, omitted = X.head_and_tail(F.lit("abcdefghijkl"), 9)
    r = spark.range(1).select(shown.alias("s"), omitted.alias("o")).first()
    assert r["s"] == "abcdef\n[3 characters omitted]\njkl" and r["o"] == 3


def test_components(spark):
    e = spark.createDataFrame([("b", "c"), ("c", "d"), ("c", "c"), ("d", "b"), (None, "a")], "u string, v string")
    assert rows(connected_components(e)) == [("b", "b"), ("c", "b"), ("d", "b")]
    chain = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


def test_tiers_and_roles(spark):
    t = spark.createDataFrame([("X", i) for i in range(5)], "base string, h int")
    assert [r["tier"] for r in W.tiered(t, "base", "h", 2, 4).orderBy("h").collect()] == [2, 2, 3, 4]
    g = spark.createDataFrame([(i, i == 0, f"{i:03}") for i in range(6)], "g int, e boolean, h string")
    assert [r["role"] for r in S.roles(g, "g", "e", "h", {"test": 2, "gate": 1}, "train").orderBy("g").collect()] == ["train", "test", "test", "gate", "train", "train"]


def test_streak_stops_at_the_sixth(spark):
    z = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate([1.0, 1.0, 0.5, 1.0, 1.0, 1.0])], "run string, step int, zero double")
    assert W.streaks(z, "run", "step", F.col("zero") == 1).where("streak >= 3").first()["step"] == 6


def test_both_windows_are_needed(spark):
    z = spark.range(64).select(F.lit("r").alias("run"), (F.col("id") + 1).alias("step"), F.when(F.col("id") < 32, 0.5).otherwise(0.7).alias("x"))
    w = W.fixed_windows(z, "run", "step", F.col("x"), 32).where("mean < 0.6 and before < 0.6")
    assert w.count() == 0


def test_cap_comes_before_the_end_filter(spark):
    e = [(True, "truncated"), (True, "stopped"), (True, "stopped")]
    r = spark.createDataFrame([("k", e)], "key string, episodes array<struct<passed:boolean,end:string>>")
    assert B.demonstrations(r, "key", "episodes", 2, ["truncated"]).count() == 1


def test_redaction_reaches_every_string(spark):
    df = spark.createDataFrame([({"k": "secret"}, [("secret", 1)], None)], "m map<string,string>, a array<struct<s:string,n:int>>, z string")
    assert "secret" not in str(X.redacted(df, [("secret", "x")]).first())


def test_padding(spark):
    r = spark.range(1).select(B.without_padding(F.array(*map(F.lit, (5, 0, 7, 0, 0))), 0).alias("a"), B.without_padding(F.array(F.lit(0)), 0).alias("b")).first()
    assert r["a"] == [5, 0, 7] and r["b"] == []


def test_sources(spark, tmp_path):
    for name, text in (("t1/instruction.md", " Do it. \n"), ("t1/tests/a.py", "assert 1"), ("t2/instruction.md", "x")):
        (tmp_path / "b" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b" / name).write_text(text)
    (tmp_path / "b/t1/tests/raw.bin").write_bytes(b"\xff\xfe\xfa")
    assert rows(R.task_bundles(spark, str(tmp_path / "b"))) == [("t1", "Do it.", 1)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/x.txt", "hello")
        z.writestr("b.bin", b"\xff")
    assert rows(archive_members(spark, str(tmp_path / "*.zip"))) == [("z.zip", "a/x.txt", 5, "hello"), ("z.zip", "b.bin", 1, None)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/k1.json").write_text(json.dumps({"v": 1}, indent=1))
    assert rows(R.record_folder(spark, str(tmp_path / "r"), "v int")) == [(1, "k1")]
    one = spark.createDataFrame([(1,)], "k int")
    R.write_once(one, str(tmp_path / "w"))
    with pytest.raises(Exception, match="(?i)exists"):
        R.write_once(one, str(tmp_path / "w"))
    with pytest.raises(Exception, match="two files"):
        R.exclusive([one, one], "k").collect()
    with pytest.raises(ValueError, match="identity"):
        R.refuse_other_identity(spark.createDataFrame([(1, ("m",))], "k int, identity struct<model:string>"), {"model": "other"})


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=15))
def test_components_equal_union_find(spark, edges):
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u int, v int")).collect()))
    assert got == {x: find(x) for x in list(root)}


def test_the_whole_block_must_lie_in_the_prompt(spark):
    b = "def total(rows):\n    return sum(r.price for r in rows)\n"
    flat = "def total(rows): return sum(r.price for r in rows)"
    blocks = spark.createDataFrame([("whole", b), ("start", b.replace("price", "cost")), ("line", flat), ("short", "def f():\n  pass")], "item string, text string")
    blocks = blocks.where(J.is_block(F.col("text"))).select("item", J.flat(F.col("text")).alias("block"))
    assert rows(blocks.select("item")) == [("start",), ("whole",)]
    prompts = spark.createDataFrame([(1, f"write\n{b} now"), (2, "def total(x)"), (None, f"so {flat}"), (4, None)], "id long, text string")
    found = N.containing(prompts.select("id", J.flat(F.col("text")).alias("text")), "id", "text", blocks, "block")
    assert rows(found) == [(1, flat), (None, flat)]


@pytest.mark.parametrize("words", [1, 2, 3, 4, 5, 9])
def test_containing_is_brute_force(spark, words):
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 11}" + "x" * (k % 3) for k in range(30)) + ("\n\tend  here" if i % 2 else "")) for i in range(12)]
    cut = [t[j : j + 40] for _, t in texts for j in range(0, len(t) - 40, 13)] + ["\tend  here", "nowhere in them at all"]
    literals = {" ".join(c.split(" ")[:words]).strip(" ") for c in cut} - {""}
    found = N.containing(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([(x,) for x in literals], "line string"), "line")
    assert rows(found) == sorted(((i, x) for i, t in texts for x in literals if x in t), key=repr)


def test_literals_within_a_line_are_found(spark):
    lit = "the answer is forty two"
    texts = spark.createDataFrame([(1, f"so {lit}, he said"), (2, f"a\n  {lit} \nb"), (3, "the answer is forty"), (4, f"xx{lit}yy {lit}")], "id long, text string")
    found = N.containing(texts, "id", "text", spark.createDataFrame([(lit,)], "line string"), "line")
    assert rows(found) == [(1, lit), (2, lit), (4, lit)]


def test_copies_stay_in_groups_and_sides(spark, tmp_path):
    from trialspark.plans.texts import Q

    a, b = "red apples grow on old trees by the river", "nine ships left port before dawn with salt"
    docs = spark.createDataFrame([(1, a), (4, a), (8, a), (2, b), (3, b), (5, b + " today"), (6, "alone here")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda n: Q[n](spark, str(tmp_path))
    assert rows(run("t13_components_with_copies")) == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 2), (8, 1)]
    assert {(r["groups"], r["largest"], r["members"]) for r in run("t14_threshold_sensitivity").where("threshold = 0.5").collect()} == {(2, 3, 6)}
    assert {(r["side"], r["pairs"]) for r in run("t15_cross_corpus_documents").collect()} == {("within_known", 1), ("across", 2), ("within_candidates", 3)}
    assert {(r["doc_id"], r["rep"], r["members"]) for r in run("t12_exact_classes").collect()} == {(1, 1, 3), (4, 1, 3), (8, 1, 3), (2, 2, 2), (3, 2, 2), (5, 5, 1), (6, 6, 1)}
    assert {(1, 4, 1.0), (1, 8, 1.0), (2, 3, 1.0)} <= set(rows(run("t24_character_similarity")))


def test_numbers_are_distinct_in_many_pieces(spark):
    """Range bounds are sampled anew in each execution; the numbers must not depend on it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c = spark.range(200_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.lit(1.0).alias("x")).repartition(8)
        got = I.numbered(c, "k").agg(F.count("*"), F.count_distinct("j"), F.min("j"), F.max("j"), F.min("n")).first()
        assert tuple(got) == (200_000, 200_000, 0, 199_999, 200_000)
        assert I.numbered(c, "k").where("k = 0").first()["j"] == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert I.numbered(c.limit(0), "k").count() == 0


def brute_draws(seed, b, n):
    """The rule of the draws, written with Python's whole numbers."""
    full = 2**32

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> 16) * 73244475 % full
        return x ^ x >> 16

    one = mixed(((b + 1) * 2654435761 + seed * 97531) % full)
    two = mixed((one + 1374496523) % full)
    return [mixed(mixed((one + j) % full) ^ two) * n >> 32 for j in range(n)]


def test_bootstrap_equals_brute_force(spark):
    x = [0.25 * (i % 5) for i in range(40)]
    c = spark.createDataFrame([(i, v, float(i % 3 + 1)) for i, v in enumerate(x)], "k long, x double, y double")
    values = {r["b"]: r["value"] for r in I.bootstrap(c, "k", "x", "y", 50, 3).collect()}
    assert len(values) == 50
    for b, v in values.items():
        at = brute_draws(3, b, 40)
        assert abs(v - sum(x[i] for i in at) / sum(i % 3 + 1 for i in at)) < 1e-12
    assert I.bootstrap(c.limit(0), "k", "x", None, 5, 3).count() == 0


def test_tree_of_draws(spark):
    """Any number of pieces draws n numbers for each replicate, the same ones; the interval is that of the direct draws."""
    n = 3001
    c = spark.range(n).select(F.col("id").alias("k"), ((F.col("id") * 7919 % 101) / 100).alias("x"), (F.col("id") % 3 + 1).cast("double").alias("y"))
    runs = [{r["b"]: r for r in I.replicate_sums(c, "k", "x", "y", 60, 5, pieces=pieces, direct=10, leaf=64).collect()} for pieces in (1, 4, 16)]
    for run in runs:
        assert len(run) == 60 and all(r["drawn"] == n and r["method"] == "tree" for r in run.values())
        assert all(abs(r["top"] - runs[0][b]["top"]) < 1e-9 and r["bottom"] == runs[0][b]["bottom"] for b, r in run.items())
    ends = [I.intervals(I.bootstrap(c, "k", "x", "y", 2000, 5, direct=direct, leaf=256), lo=0.025, mid=0.5, hi=0.975).first() for direct in (10, 10_000)]
    assert [r["method"] for r in ends] == ["tree", "draws"] and all(abs(ends[0][k] - ends[1][k]) < 0.0015 for k in ("lo", "mid", "hi"))  # a replicate's deviation is 0.005


def test_draws_by_kind_of_cluster(spark):
    """Clusters of equal numbers are drawn together: n draws a replicate, the interval and spread of the direct draws."""
    c = spark.range(3001).select(F.col("id").alias("k"), (F.col("id") * 7919 % 11 / 10).alias("x"), (F.col("id") % 3 + 1).cast("double").alias("y"))
    sums = I.replicate_sums(c, "k", "x", "y", 300, 5, direct=100).collect()
    assert len(sums) == 300 and all(r["drawn"] == 3001 and r["method"] == "kinds" for r in sums)
    kinds, draws = ([r["value"] for r in I.bootstrap(c, "k", "x", "y", 2000, 5, direct=direct).collect()] for direct in (100, 10_000))
    for at in (50, 1000, 1950):
        assert abs(sorted(kinds)[at] - sorted(draws)[at]) < 0.0015
    assert abs(np.std(kinds) / np.std(draws) - 1) < 0.1


def test_leaf_counts_are_multinomial():
    import numpy as np

    n, leaf = 1000, 64
    whole = [I.leaf_counts(9, b, n, 0, 16, leaf) for b in range(400)]
    assert all(sum(c.values()) == n and len(c) == 16 for c in whole)
    assert all({**I.leaf_counts(9, b, n, 0, 5, leaf), **I.leaf_counts(9, b, n, 5, 16, leaf)} == whole[b] for b in range(20))
    counts = np.array([[c[i] for i in range(16)] for c in whole])
    size = np.array([64] * 15 + [40])
    assert (abs(counts.mean(axis=0) - size) < 5 * np.sqrt(size / 400)).all() and (abs(counts.var(axis=0) / (size * (1 - size / n)) - 1) < 0.4).all()


def test_gates(spark):
    one = spark.range(1)
    name = lambda a, b: one.select(I.headline(collateral=F.lit(a), recovery_failure=F.lit(b)).alias("h")).first()["h"]
    assert (name(0.2, 0.2), name(0.1, 0.3), name(0.19, 0.19)) == ("collateral", "recovery_failure", None)
    rooms = one.select(I.headroom(F.lit(0.8), F.lit(0.89)).alias("a"), I.headroom(F.lit(0.8), F.lit(0.9)).alias("b"), I.headroom(F.lit(0.81), F.lit(0.85)).alias("c")).first()
    assert tuple(rooms) == (True, False, False)
    gates = one.select(*(I.variance_gate(F.lit(v), F.lit(m), F.lit(128)).alias(f"g{v}{m}") for v, m in ((90, 26), (90, 25), (80, 26)))).first()
    assert tuple(gates) == (True, False, False)


def test_medians_by_counts(spark):
    t = spark.createDataFrame([("a", v) for v in (5, 5000, 1, 5)] + [("b", 7), ("c", None), ("c", 3)], "g string, v long")
    assert rows(A.upper_median(t, "v", "g")) == [("a", 4, 5, 5000), ("b", 1, 7, 7), ("c", 2, 3, 3)]


STEP = "run long, step long, loss double, grad_norm double, zero double, clipped double, hours double"


@pytest.mark.parametrize(
    ("rows_", "expected"),
    [
        ([(1, float("inf"), 1.0, 0.0, 0.0, 0.0)], ("not_finite", 1)),
        ([(1, 1.0, float("nan"), 0.0, 0.0, 0.0)], ("not_finite", 1)),
        ([(i, 1.0, 1.0, 1.0, 0.0, 0.0) for i in range(1, 5)], ("streak", 3)),
        ([(i, None, None, 0.5, 0.0, 0.0) for i in range(1, 70)], ("informative", 64)),
        ([(i, 1.0, 1.0, 0.0, 0.06, 0.0) for i in range(1, 20)], ("truncated", 16)),
        ([(i, 1.0, 1.0, 0.0, 0.06 if i > 8 else 0.0, 0.0) for i in range(1, 24)], None),
        ([(i, 1.0, 1.0, 0.0, 0.0, 20.0) for i in range(1, 5)], ("hours", 3)),
        ([(i, 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(1, 80)], ("trajectories", 75)),
        ([(i, 1.0, 1.0, 1.0 if i > 1 else 0.0, 0.0, 41.0 * (i == 4)) for i in range(1, 6)], ("hours", 4)),
    ],
)
def test_stop_rules(spark, tmp_path, rows_, expected):
    log = spark.createDataFrame([(7, *r) for r in rows_], STEP)
    want = [(7, *expected)] if expected else []
    assert rows(V.stops(log, "run", "step")) == want
    if expected is None or expected[0] in ("not_finite", "informative", "hours"):
        log.coalesce(1).write.parquet(f"{tmp_path}/log")
        live = V.liveness(spark.readStream.schema(STEP).parquet(f"{tmp_path}/log"), "run", "step")
        with V.disk_state(spark, drain=True):
            q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert rows(spark.table("live")) == want


SNAPSHOT = "path string, ftype string, mode string, size long, mtime long, link string, sha256 string, text string"


def snapshot(spark, *files):
    return spark.createDataFrame([(p, t, m, len(x), at, None, f"h:{x}", x) for p, t, m, at, x in files], SNAPSHOT)


def test_damage_and_residue(spark):
    gold = snapshot(spark, ("/a.py", "f", "644", 1, "x=1"), ("/b.py", "f", "644", 1, "x=2"), ("/c", "f", "644", 1, "1"), ("/bin/d", "f", "644", 1, "1"), ("/e.txt", "f", "644", 1, "1"), ("/f", "d", "755", 1, ""), ("/etc/ld.so.preload", "f", "644", 1, "l"))
    bad = snapshot(
        spark, ("/a.py", "f", "644", 2, "y=1"), ("/b.py", "f", "644", 2, "y=2"), ("/c", "f", "644", 9, "1"), ("/f", "d", "700", 1, ""), ("/g.py", "f", "644", 1, ""), ("/h.txt", "f", "644", 1, ""), ("/p/i.so.2", "f", "644", 1, ""),
        ("/etc/ld.so.preload", "f", "600", 1, "l"), ("/j", "d", "755", 1, ""),
    )
    damage = M.damage_set(gold, bad, spark.createDataFrame([("/p/i.so.2",)], "path string"))
    assert [r[:2] for r in rows(damage)] == [("/a.py", "changed"), ("/b.py", "changed"), ("/bin/d", "deleted"), ("/e.txt", "deleted"), ("/etc/ld.so.preload", "changed"), ("/f", "dir_mode"), ("/g.py", "added"), ("/h.txt", "added")]
    hook = "/usr/lib/python3/dist-packages/z.pth"
    now = snapshot(
        spark, ("/a.py", "f", "600", 2, "x = 1  # as it was"), ("/b.py", "f", "600", 2, "x=3"), ("/c", "f", "644", 9, "1"), ("/f", "d", "700", 1, ""), ("/g.py", "f", "644", 1, ""), ("/h.txt", "f", "644", 1, ""), (hook, "f", "644", 1, ""),
        ("/etc/ld.so.preload", "f", "600", 1, "l"),
    )
    assert rows(M.residue(damage, gold, now)) == [("/b.py", "content"), ("/bin/d", "missing"), ("/etc/ld.so.preload", "mode"), ("/f", "dir_mode"), ("/g.py", "added_still_present"), (hook, "new_hook")]
    gone = now.where("path <> '/etc/ld.so.preload'")
    assert ("/etc/ld.so.preload", "ld_preload") in rows(M.residue(damage, gold, gone))
    assert rows(M.residue(damage, gold, gold)) == []


def test_faults_are_seen_by_name_and_symptom(spark):
    calls = [
        ("perm_denied", "/d/in.csv", "cat in.csv", "cat: Permission denied", False, True), ("perm_denied", "/d/in.csv", "cat x", "Permission denied", False, False), ("perm_denied", "/d/in.csv", "ls", " ---------- 1 u in.csv", False, True),
        ("moved_input", "/d/in.csv", "ls", "---------- in.csv", False, False), ("moved_input", "/d/in.csv", "cat", "in.csv: No such file", False, True), ("missing_tool", "jq", "jq .", "jq: command not found", False, True),
        ("missing_tool", "jq", "jq .", "command not found", False, False), ("blocking_fifo", "/d/p", "cat p", "", True, True), ("blocking_fifo", "/d/p", "cat p", "No such file", False, False), ("other", "/d/p", "p", "not found", True, False),
        ("perm_denied", "/d/p", None, None, None, False),
    ]
    t = spark.createDataFrame(calls, "family string, target string, command string, output string, timed_out boolean, expected boolean")
    assert t.where(G.fault_observed(*(F.col(c) for c in ("family", "target", "command", "output", "timed_out"))) != F.col("expected")).count() == 0


def test_normalise_as_a_task_text(spark):
    texts = {"run task_12_ab3f of /a/~b/c.txt": "run TASK of /PATH", "v1.2 and 3.50": "v1.NUM and NUM", "a/b //x": "a/b //PATH", "xé3 4": "xé3 NUM"}
    t = spark.createDataFrame([(k, v) for k, v in texts.items()], "a string, b string")
    assert [(r["n"], r["b"]) for r in t.select(X.normalise(F.col("a")).alias("n"), "b").collect()] == [(v, v) for v in texts.values()]


def test_verifier_features_and_flags(spark):
    weak = "import os.path\nfrom numpy import x\nasync def test_a():\n    assert os.path.exists('a')\n"
    good = "import pytest, json\ndef test_b():\n    assert f() == 1\n    assert p.is_file()\n"
    t = spark.createDataFrame([("1", weak), ("2", good), ("3", "def ("), ("4", None)], "id string, text string")
    f = {r["id"]: r["features"] for r in PY.with_features(t, "text").collect()}
    assert (f["1"]["presence_only"], f["1"]["test_functions"], f["1"]["imports"]) == (True, 1, ["numpy", "os"]) and not f["2"]["presence_only"] and f["2"]["assertions"] == 2
    assert f["3"]["syntax_error"] and not f["4"]["syntax_error"] and f["4"]["assertions"] == 0
    flags = lambda i, d, s: spark.createDataFrame([(i, d, s)], "i string, d string, s string").transform(PY.with_features, "s").select(X.task_flags(F.col("i"), F.col("s"), F.col("d"), F.col("features")).alias("f")).first()["f"]
    assert flags("Use at most 5 shell commands", "FROM ubuntu:22.04\nCOPY solution.py /x", weak) == ["weak_verifier_static", "answer_file_suspect", "nonstdlib_test_import", "command_count_constraint"]
    assert flags("curl this image", "from debian\nCOPY . /x", good) == ["runtime_network_text", "multimedia_text", "copy_entire_context", "other_base"]
    assert flags(None, None, good) == ["other_base"]


def test_character_similarity(spark):
    a, b = "käse " * 600, "kase " * 600 + "!"
    t = spark.createDataFrame([("abc", "abd"), (a, b), ("", ""), ("x" * 3000, "y" * 3000), (None, "a")], "a string, b string")
    got = [r["s"] for r in t.select(character_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1 - 1 / 3 and abs(got[1] - (1 - 601 / 3001)) < 1e-12 and got[2:4] == [1.0, 0.0] and got[4] is None


def test_published_versions(spark, tmp_path, monkeypatch):
    """A watcher beside the publications finds a whole version at all times; a failure before the pointer leaves the one before."""
    import threading

    path, rows = f"file://{tmp_path}/contracts", [spark.range(n).coalesce(1) for n in (5, 2)]
    with pytest.raises(FileNotFoundError):
        R.published(spark, path)
    R.publish(rows[0], path)
    seen, done = [], threading.Event()

    def watch():
        while not done.is_set():
            folder = tmp_path / "contracts"
            name = max(p.name for p in (folder / "current").iterdir())
            seen.append(sum(len(p.read_text().splitlines()) for p in (folder / "versions" / name).glob("part-*")))

    watcher = threading.Thread(target=watch)
    watcher.start()
    for n in range(100):
        R.publish(rows[n % 2], path)
    done.set()
    watcher.join()
    assert set(seen) == {2, 5} and len(seen) > 100
    first = R.published(spark, path)
    monkeypatch.setattr(R, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        R.publish(spark.range(7), path)
    monkeypatch.undo()
    assert R.published(spark, path) == first and R.json_lines(spark, first, "id long").count() == 2
    R.publish(rows[0], path)
    R.retire(spark, path)
    assert R.json_lines(spark, R.published(spark, path), "id long").count() == 5 and len(list((tmp_path / "contracts" / "current").glob("0*"))) == 2


def test_ranks_by_counts(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2500, "a").when(F.col("id") < 2990, "b").otherwise("c").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    k = spark.createDataFrame([("a", 1234), ("b", 0), ("c", 99)], "g string, k long")
    got = {r["id"] for r in S.within(df, "g", "h", "id", k, most=1).where("within").collect()}
    rows = [(r["g"], r["h"], r["id"]) for r in df.collect()]
    want = {i for g, n in (("a", 1234), ("c", 99)) for _, _, i in sorted(r for r in rows if r[0] == g)[:n]}
    assert got == want and S.within(df, "g", "h", "id", k).count() == 3000
    assert S.within(df, "g", "h", "id", k.where("g = 'a'")).where("within and g <> 'a'").count() == 0


def test_rows_skipped_by_counts(spark, monkeypatch):
    df = spark.range(2000).withColumnRenamed("id", "k")
    want = [r["k"] for r in S.hash_order(df, "k", "x", 7, 300).collect()]
    monkeypatch.setattr(S, "RANKED", 10)
    assert [r["k"] for r in S.hash_order(df, "k", "x", 7, 300).collect()] == want and len(want) == 7


def test_too_few_groups(spark):
    g = spark.range(20).select(F.col("id").alias("g"), F.lit(False).alias("e"))
    assert S.roles(g, "g", "e", "g", {"test": 5}, "train", 20).count() == 20
    with pytest.raises(ValueError, match="at least 21"):
        S.roles(g, "g", "e", "g", {"test": 5}, "train", 21)


def test_sections_stay_in_their_row(spark):
    from trialspark.operators import windows as W

    t = spark.createDataFrame([(1, "x\n%a\ny\n%b\n%c\nz"), (2, ""), (3, None), (4, "%d")], "k long, text string")
    got = W.carried(t, "text", lambda line: line.startswith("%"))
    assert sorted((r["k"], r["at"], r["line"], r["section"]) for r in got.collect()) == [(1, 0, "x", None), (1, 1, "%a", "%a"), (1, 2, "y", "%a"), (1, 3, "%b", "%b"), (1, 4, "%c", "%c"), (1, 5, "z", "%c"), (2, 0, "", None), (4, 0, "%d", "%d")]
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_large_trees(spark):
    f = spark.createDataFrame([("t", f"p{i}", str(i)) for i in range(50)], "tree string, path string, content string")
    one, two = (R.large_tree_digest(x, "tree", "path", "content", 1).first()["digest"] for x in (f, f.orderBy(F.desc("path")).repartition(3)))
    other = R.large_tree_digest(f.where("path <> 'p7'"), "tree", "path", "content", 1).first()["digest"]
    assert one == two != other


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(3)
    vectors = rng.random((60, 40)) ** 3 * (rng.random((60, 40)) < np.linspace(0.05, 0.5, 40))
    vectors[7], vectors[8] = vectors[9], vectors[9] + 0.01 * (vectors[9] > 0)
    vectors = vectors[vectors.any(axis=1)]
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    w = spark.createDataFrame([(i, f"g{j}", float(vectors[i, j])) for i, j in zip(*map(np.ndarray.tolist, vectors.nonzero()), strict=True)], "doc_id long, gram string, w double")
    cosine = vectors @ vectors.T
    want = {(i, j) for i in range(len(vectors)) for j in range(i + 1, len(vectors)) if cosine[i, j] >= threshold}
    got = {(r["a"], r["b"]): r["cosine"] for r in X.similar_pairs(w, "doc_id", threshold).collect()}
    assert set(got) == want and want and all(abs(got[i, j] - cosine[i, j]) < 1e-9 for i, j in want)


def test_tiles_find_all_similar_pairs(spark):
    """Against all products, for tiles of 1 to 64 vectors, with common grams (dense columns) and rare ones."""
    import numpy as np

    r = np.random.Generator(np.random.PCG64(2))
    rows = []
    for k in range(60):
        grams = {f"g{i}" for i in r.zipf(1.4, 25) if i < 400} | ({f"h{i}" for i in range(k // 6 * 3, k // 6 * 3 + 8)} if k % 2 else set())
        v = {g: float(r.random()) + 0.05 for g in grams}
        norm = sum(x * x for x in v.values()) ** 0.5
        rows += [(k, g, x / norm) for g, x in v.items()]
    vectors = {}
    for k, g, x in rows:
        vectors.setdefault(k, {})[g] = x
    dot = lambda a, b: sum(x * vectors[b].get(g, 0.0) for g, x in vectors[a].items())
    w = spark.createDataFrame(rows, "k long, gram string, w double")
    for threshold, size in ((0.3, 64), (0.4, 16), (0.5, 7)):
        got = {(p["a"], p["b"]): p["cosine"] for p in X.similar_pairs(w, "k", threshold, size).collect()}
        want = {(a, b): dot(a, b) for a in vectors for b in vectors if a < b and dot(a, b) >= threshold}
        assert len(want) > 5 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert X.similar_pairs(w.limit(0), "k", 0.5).count() == 0


def test_similar_texts_equal_weights_multiplied(spark, sf, monkeypatch, tmp_path):
    """Blocks against the products of tfidf's rows, for all-head, mixed and all-rare vectors; what is stored stays below three times the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x"), (-4, "two words")], "doc_id long, text string"))
    vectors = {}
    for r in X.tfidf(docs, "doc_id", "text").collect():
        vectors.setdefault(r["doc_id"], {})[r["gram"]] = r["w"]
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(r["text"], r["doc_id"])
    reps = [k for k in sorted(first.values()) if k in vectors]
    dots = {(a, b): sum(x * vectors[b].get(g, 0.0) for g, x in vectors[a].items()) for i, a in enumerate(reps) for b in reps[i + 1 :]}
    for threshold, head, size in ((0.3, 48, 64), (0.5, 10**9, 2048), (0.15, 1, 50)):
        folder = tmp_path / str(head)
        monkeypatch.setattr(X, "new_path", lambda s, name, folder=folder: f"file://{folder}/{name}")
        monkeypatch.setattr(X, "HEAD", head), monkeypatch.setattr(X, "TILE", size)
        got = {(r["a"], r["b"]): r["cosine"] for r in X.similar_texts(docs, "doc_id", "text", threshold).collect()}
        want = {p: c for p, c in dots.items() if c >= threshold}
        assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        stored = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
        assert stored < 3 * sum(len((r["text"] or "").encode()) for r in docs.collect())


def test_similar_texts_store_no_lists_of_grams(spark, monkeypatch, tmp_path):
    """Blocks keep places, and numbers only of grams that count; a repeated task with other blocks is an error, not a wrong count."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{x:x}" for x in rng.zipf(1.3, 200) % 100_000)) for i in range(1500)], "k long, t string").coalesce(1)
    monkeypatch.setattr(X, "new_path", lambda s, name: f"file://{tmp_path}/{name}")
    assert X.similar_texts(docs, "k", "t", 0.9).count() == 0
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert stored < 0.9 * docs.agg(F.sum(F.octet_length("t"))).first()[0]

    def some(least, most):
        return lambda at, pdf: pdf[["block"]].assign(bucket=at[0], df=b"", id=b"").iloc[int(at[0] == 0) :]

    monkeypatch.setattr(X, "_frequencies", some), monkeypatch.setattr(X, "new_path", lambda s, name: f"file://{tmp_path}/again/{name}")
    with pytest.raises(RuntimeError, match="another order"):
        X.similar_texts(docs, "k", "t", 0.9)


def test_similar_texts_touch_few_products(spark, monkeypatch, tmp_path):
    """Groups of several blocks give all pairs, near copies and texts of common words only too, and add up few of the products of shared grams."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x:x}" for x in rng.zipf(1.25, rng.integers(3, 150)) % 30_000) for _ in range(1200)]
    texts += [t.replace(" w1 ", " w2 ").replace(" w3", " x", 1) for t in texts[:60]] + [f"w1 w{i % 3 + 1:x} w2" for i in range(40)] + ["", None]
    docs = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "k long, t string").coalesce(1)
    first = {}
    for k, t in sorted(docs.collect()):
        first.setdefault(t, k)
    vectors = {}
    for r in X.tfidf(docs, "k", "t").collect():
        vectors.setdefault(r["k"], {})[r["gram"]] = r["w"]
    ids = {g: i for i, g in enumerate({g for v in vectors.values() for g in v})}
    reps = [k for k in sorted(first.values()) if k in vectors]
    dense = np.zeros((len(reps), len(ids)))
    for i, k in enumerate(reps):
        dense[i, [ids[g] for g in vectors[k]]] = list(vectors[k].values())
    dots = dense @ dense.T
    monkeypatch.setattr(X, "BLOCK", 200), monkeypatch.setattr(X, "GROUP", 2), monkeypatch.setattr(X, "new_path", lambda s, name: f"file://{tmp_path}/{name}")
    got = {(r["a"], r["b"]): r["cosine"] for r in X.similar_texts(docs, "k", "t", 0.5).collect()}
    want = {(reps[i], reps[j]): dots[i, j] for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(dots, 1) >= 0.5)), strict=True)}
    assert len(want) > 60 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)

    folder = f"file://{tmp_path}/vectors"
    blocks = [X._Vectors(folder, f.stem, len(texts)) for f in sorted((tmp_path / "vectors").glob("0*.parquet"))]
    group, touched, places = X._Group(blocks, 0.5), [], X._places
    assert len(blocks) > 4
    for most in (X.PRODUCTS, 100):  # by some rows, and by one row in pieces
        monkeypatch.setattr(X, "PRODUCTS", most), monkeypatch.setattr(X, "_places", lambda start, n: touched.append(n.sum()) or places(start, n))
        found = set()
        for y in blocks:
            group.meet(y)
            found |= {(group.key[i], y.key[j]) for some in group.near(y) for i, j in zip(*some, strict=True)}
        assert want.keys() <= found
        shared = ((dense > 0).astype(float) @ (dense > 0).T).sum()
        assert sum(touched) < 0.1 * shared
        touched.clear()


def test_words_beside_letters_beyond_ascii(spark, tmp_path):
    """A word ends where its ASCII letters do, in the query as in its SQL."""
    import duckdb

    from trialspark.plans.catalog import ORACLE, QUERIES

    texts = ["écurl it", "wgeté", "sudo", "xsudo", "at most 3 commandsß", "ünginx and dockerö", "pip install", None]
    spark.createDataFrame([("user", t) for t in texts], "role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.sql(ORACLE["t7_installer_flags"].replace("from conversations", f"from '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in QUERIES["t7_installer_flags"](spark, str(tmp_path)).collect()] == duck == [("user", 8, 3, 1, 1, 1)]
    assert spark.sql("select 'éwget' as t").select(X.hits(F.col("t"), X.HITS["network"]).alias("h")).first()["h"] == ["wget"]


def test_boundaries_beside_letters_look_at_one_side(spark):
    """No position is tried for all boundaries where a pattern names the letter beside it, and the hits stay those of RE2."""
    import duckdb

    assert X.BOUNDARY not in X.ascii_words(X.HITS["privilege"]) and X.BOUNDARY in X.ascii_words(r"\ba?b") and X.BOUNDARY in X.ascii_words(r"\b(a|-)\b")
    texts = ["mount", "émount", "mounté", "xmount", "mount_", "-mount-", "remount mount", "MOUNT sysctl -w", "sysctl -wx", "insmod\nchroot", "backup.bak", ".bakx", ".orig", "ab abd a", "b-", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for pattern in (X.HITS["privilege"], X.HITS["trace"], X.HITS["network"], r"\ba?b\b", r"a\b", r"\bé"):
        want = [duckdb.execute("select regexp_extract_all(?, ?)", [t, pattern]).fetchone()[0] for t in texts]
        assert [r[0] for r in rows.select(F.regexp_extract_all("t", F.lit(X.ascii_words(pattern)), 0)).collect()] == want


def test_record_files_are_written_by_several_tasks(spark, tmp_path):
    from trialspark.plans.pipelines import write_files

    write_files(spark.range(0, 40, 1, 1), str(tmp_path / "files"))
    names = [f.name for f in (tmp_path / "files").glob("part-*.json")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1


def test_far_tiles_are_left_out(spark):
    w = spark.createDataFrame([(k, f"{'ab'[k // 20]}{i}", 0.5) for k in range(40) for i in range(k % 3, k % 3 + 4)], "k long, gram string, w double")
    packed = X.tiles(w, "k", 20)
    assert packed.select("tile").distinct().count() == 2
    assert {tuple(r) for r in X.tile_pairs(packed, 0.5).collect()} == {(0, 0), (1, 1)}


def test_gram_counts(spark):
    t = spark.createDataFrame([(1, "a bb cc bb cc"), (2, "bb  CC"), (3, None), (4, "")], "k long, text string")
    w = {(r["k"], r["gram"]) for r in X.tfidf(t, "k", "text").collect()}
    assert w == {(1, "bb"), (1, "cc"), (1, "bb cc"), (2, "bb"), (2, "cc"), (2, "bb cc")}


CODE = """
'''Module text of eighteen letters
  and another line of it  '''
import a.b, c
from .d import e
from f.g import h
EXPECTED_LINES: list = ["first line of the block here", "second line of the block here"]
x = expected_bytes = b"bytes of the block, line one\\nbytes of the block, line two \\xff"
expected_list = ["not", 1, ["nested, so it is no list of strings", "at all"]]
expected_f = f"formatted {x} text with braces in it"
expected_short = "a\\nb"
expected_later = make("no literal value but a constant")
expected_none: str
class T:
    async def test_one(self):
        def test_inner(): assert self.p.exists() and "quite long constant text"
        self.expected = "half \\ud800 surrogate and enough text\\nsecond line of that value"
        # "a comment with quotes, which is no constant"
"""


def test_facts_of_sources(spark):
    t = spark.createDataFrame([(1, CODE), (2, CODE), (3, "def ("), (4, None), (5, "x = '\\0'\0"), (6, "(" * 5000)], "k long, code string")
    facts = PY.source_facts(t, "code")
    assert facts.where("kind = 'error'").count() == 3 and facts.select("source").distinct().count() == 4  # one of CODE twice, none of the empty one
    f = {r["k"]: r["features"] for r in PY.with_features(t, "code").collect()}
    assert len(f) == 6 and f[1] == f[2] and (f[1]["imports"], f[1]["assertions"], f[1]["test_functions"], f[1]["presence_only"]) == (["a", "c", "d", "f"], 1, 2, True)
    assert f[3]["syntax_error"] and f[5]["syntax_error"] and f[6]["syntax_error"] and not f[4]["syntax_error"]
    lines = {r["line"] for r in PY.literal_lines(t.where("k < 4"), "k", "code").where("k = 2").collect()}
    assert lines == {
        "Module text of eighteen letters", "and another line of it", "first line of the block here", "second line of the block here", "nested, so it is no list of strings", "text with braces in it",
        "no literal value but a constant", "quite long constant text", "half ? surrogate and enough text", "second line of that value",
    }
    blocks = {(r["variable"], r["block"]) for r in PY.expected_blocks(t, "k", "code").where("k = 1").collect()}
    assert blocks == {
        ("EXPECTED_LINES", "first line of the block here second line of the block here"), ("expected_bytes", "bytes of the block, line one bytes of the block, line two \ufffd"),
        ("self.expected", "half ? surrogate and enough text second line of that value"),
    }


def test_literals_of_all_lengths_are_found(spark, sf, monkeypatch):
    import random

    r = random.Random(4)
    body = "".join(r.choice("ab é\U0001f600\n") for _ in range(9000)) + " the end of it"
    texts = [(1, body), (2, body[3000:3400]), (3, "aa"), (4, None), (5, body), (6, "")]
    literals = {body[i : i + n] for n in (1, 2, 3, 5, 7, 8, 9, 16, 30, 31, 32, 60, 400) for i in (0, 3100, 3123, len(body) - n)} | {"zz", "a", "bq", "no such text in any row of it", "the end of it!"}
    monkeypatch.setattr(N, "BYTES", 1000)
    found = N.containing(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([(x,) for x in [*literals, ""]], "line string"), "line")
    assert sorted(map(tuple, found.collect())) == sorted((i, x) for i, t in texts for x in literals if x in (t or ""))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_index_keys_are_few(spark, sf):
    """Of a text all of whose grams are wanted, under half a row for each word is an index key."""
    text = " ".join(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect())
    assert 0 < len(N.keys_of(text.encode(), N.GRAM, N.WINDOW)) < 0.5 * len(text.split())
    rows, _ = N.index_rows(spark.createDataFrame([(1, text)], "id long, text string"), spark.createDataFrame([(7, text[1000:1200])], "id long, text string"))
    assert 5 < rows.count() < 100


def test_steps_in_any_order_and_ended_runs(spark, tmp_path):
    """Micro-batches of shuffled steps, some twice, give what the batch form gives; after their patience runs leave the state."""
    import random
    import time

    r = random.Random(8)
    log = [(run, i, 1.0, 1.0, 1.0 if run < 4 and r.random() < 0.6 else 0.5, 0.1 if run == 5 else 0.0, 0.0) for run in range(8) for i in range(1, 31)]
    shuffled = [*log, *r.sample(log, 20)]
    r.shuffle(shuffled)
    source = f"{tmp_path}/log"
    for n in range(4):
        spark.createDataFrame(shuffled[n::4], STEP).coalesce(1).write.mode("append").parquet(source)
    held = spark.createDataFrame([(90, 2, 1.0, 1.0, 1.0, 0.0, 0.0), (90, 3, 1.0, 1.0, 1.0, 0.0, 0.0), (90, 5, 1.0, 1.0, 1.0, 0.0, 0.0)], STEP)  # steps 1 and 4 are lost
    held.coalesce(1).write.mode("append").parquet(source)
    live = V.liveness(spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(source), "run", "step", patience=15_000)
    with V.disk_state(spark):
        q = live.writeStream.format("memory").queryName("any_order").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state")
    try:
        deadline = time.time() + 150
        want = rows(V.stops(spark.createDataFrame(log, STEP), "run", "step"))
        while rows(spark.table("any_order")) != sorted([*want, (90, "streak", 5)]) and time.time() < deadline:
            time.sleep(1)
        assert rows(spark.table("any_order")) == sorted([*want, (90, "streak", 5)]) and len(want) >= 2
        while state("numbers").count() and time.time() < deadline:
            time.sleep(2)
        assert state("numbers").count() == 0
    finally:
        q.stop()


def test_latch_over_batches(spark, tmp_path):
    source = f"{tmp_path}/calls"
    for part in ([(1, 5, "a"), (1, 7, "a"), (1, 6, "b"), (2, 1, None)], [(1, 3, "a"), (1, 9, "b"), (3, 2, "c")]):
        spark.createDataFrame(part, "episode long, call long, path string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("episode long, call long, path string").option("maxFilesPerTrigger", 1).parquet(source)
    with V.disk_state(spark, drain=True):
        q = V.latch(stream, "episode", "call", "path").writeStream.format("memory").queryName("latched").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(V.latched(spark.table("latched"))) == [(1, 3, 2), (3, 2, 1)]


class _Held:
    """The state of one key as a dict, which counts the requests to it."""

    def __init__(self):
        self.values, self.asked = {}, 0

    def __getattr__(self, name):
        def request(*args):
            self.asked += 1
            key = args[0] if args else None
            put = {"update": lambda: {None: key}, "updateValue": lambda: {key: args[-1]}}.get(name)
            if put:
                self.values |= put()
            elif name in ("clear", "removeKey"):
                self.values.clear() if name == "clear" else self.values.pop(key)
            return {"get": lambda: self.values.get(None), "getValue": lambda: self.values.get(key), "containsKey": lambda: key in self.values, "exists": lambda: bool(self.values)}.get(name, lambda: None)()

        return request


class _Handle(_Held):
    """Also the timers of a key, and its clock."""

    now = 1_000

    def getValueState(self, name, *_):  # noqa: N802
        return self.__dict__.setdefault("_" + name, _Held())

    getMapState = getValueState  # noqa: N815

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def requests(self):
        return self.asked + sum(x.asked for x in self.__dict__.values() if isinstance(x, _Held))


def test_latch_asks_the_state_once_for_an_episode(spark):
    from pyspark.sql import Row

    handle, latch = _Handle(), V._Latch(500, together=3)
    latch.init(handle)
    calls = lambda *x: [tuple(r)[1:] for r in latch.handleInputRows(("e",), iter([Row(path=p, call=c) for p, c in x]), handle)]
    assert calls(("a", 5), ("b", 7), ("a", 4), ("c", 9)) == [("a", 4), ("b", 7), ("c", 9)] and handle.requests() == 2
    assert calls(("a", 6), ("b", 2)) == [("b", 2)] and handle.requests() == 4
    assert calls(("d", 3), ("e", 8), ("a", 4)) == [("d", 3), ("e", 8)] and sorted(handle._first.values) == [("d",), ("e",)]  # beyond three paths
    assert calls(("e", 9), ("d", 1), ("c", 9), ("f", 1)) == [("d", 1), ("f", 1)]
    handle.now = 1_600  # a and b are forgotten
    assert calls(("a", 6), ("d", 2)) == [("a", 6)] and handle._few.values[None][0] == ["a"]


def test_liveness_asks_the_state_for_waiting_steps_only(spark):
    from pyspark.sql import Row

    handle, stops = _Handle(), V._Stops(V.StopLimits(), 500)
    stops.init(handle)
    steps = lambda *x: [tuple(r)[1:] for r in stops.handleInputRows(("r",), iter([Row(step=n, broken=n == 45, zero=0.0, clipped=0.0, hours=0.0) for n in x]), handle)]
    assert steps(*range(1, 41)) == [] and handle.requests() <= 4
    assert steps(43, 42, 44) == [] and sorted(handle._waiting.values) == [(42,), (43,), (44,)]
    assert steps(41, 43) == [] and handle._waiting.values == {} and steps(45) == [("not_finite", 45)] and steps(46) == []


def test_sources_reach_python_in_small_batches(spark):
    """Table functions with Arrow hold 10,000 sources at once and what they give; the memory of a task grew with the rows of its batch."""
    t = spark.createDataFrame([(1, 'EXPECTED = ["' + "x" * 30 + '", "' + "y" * 30 + '"]\nother = EXPECTED')], "k long, code string")
    for df in (PY.expected_blocks(t, "k", "code"), PY.literal_lines(t, "k", "code"), PY.source_facts(t, "code")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert rows(PY.expected_blocks(t, "k", "code")) == [(1, "EXPECTED", "x" * 30 + " " + "y" * 30)]


def test_archives_by_member(spark, tmp_path):
    """Ten thousand members of one archive are read by many tasks; a filter on names leaves the other members' bytes alone."""
    import zipfile

    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(10_000):
            z.writestr(f"t{i}/{'task.json' if i % 100 == 0 else 'blob.bin'}", f"body {i} é" if i != 5 else b"\xff\xfe")
        z.mkdir("empty")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    (tmp_path / "other.txt").write_text("no archive")
    m = archive_members(spark, f"file://{tmp_path}/*.zip", 10_000)
    assert m.count() == 10_000 and m.rdd.getNumPartitions() > 10
    assert m.where("member = 't5/blob.bin'").first()["text"] is None and m.where("size = 2").count() == 1
    broken = path.read_bytes().replace(b"body 3 ", b"BODY 3 ")  # the checksum of t3/blob.bin no longer holds
    path.write_bytes(broken)
    with pytest.raises(Exception, match="CRC"):
        m.agg(F.max("text")).collect()
    tasks = archive_members(spark, f"file://{tmp_path}/*.zip", 10_000).where(F.col("member").endswith("/task.json"))
    assert tasks.agg(F.count("text")).first()[0] == 100 and tasks.where("archive = 'big.zip' and size > 0").count() == 100
    assert archive_members(spark, f"file://{tmp_path}/*.zip").where(F.col("member").isin("t0/task.json", "t1/blob.bin") & F.col("member").startswith("t1/")).count() == 1
