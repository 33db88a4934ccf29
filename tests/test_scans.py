"""Scans in chunks against plain windows, and edit distances against the table of all prefixes."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark.operators import edits as E
from trialspark.operators import joins as J
from trialspark.operators import scans as S
from trialspark.operators import windows as W


@pytest.fixture(scope="module")
def log(spark):
    """One run holds most rows; runs of one row, of nulls, and a null run are there too."""
    r = random.Random(5)
    rows = [("long", i, r.choice([1, 2, None]), r.random() < 0.8) for i in range(900)] + [(f"r{i}", 1, i, True) for i in range(40)]
    rows += [(None, i, 1, None if i == 3 else True) for i in range(9)] + [("none", i, None, False) for i in range(5)] + [("bad", i, 0, True) for i in range(300)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "run string, step long, x long, bad boolean")


def values(df, name):
    return {(r["run"], r["step"]): r[name] for r in df.collect()}


@pytest.mark.parametrize("size", [50, 1 << 18])
def test_running_values_equal_windows(log, size):
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert values(S.running_sum(log, "run", "step", "x", "v", size), "v") == values(log.withColumn("v", F.sum("x").over(w)), "v")
    assert values(S.running_last(log, "run", "step", "x", "v", size), "v") == values(log.withColumn("v", F.last("x", True).over(w)), "v")
    got, streak, before = values(S.running_streak(log, "run", "step", F.col("bad"), "v", size), "v"), 0, None
    rows = sorted(((r["run"], r["step"], r["bad"]) for r in log.collect()), key=lambda r: (r[0] or "", r[1]))
    for run, step, bad in rows:
        streak = (streak if run == before else 0) + 1 if bad else 0
        before = run
        assert got[run, step] == streak


def test_a_long_run_is_read_by_many_tasks(spark):
    steps = spark.range(400_000).select(F.lit("one").alias("run"), F.col("id").alias("step"), F.lit(1).alias("x"))
    chunks = S.chunked(steps, "run", "step", 20_000).groupBy("_chunk").agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi")).orderBy("_chunk").collect()
    assert len(chunks) >= 15 and max(c["n"] for c in chunks) < 60_000 and all(a["hi"] < b["lo"] for a, b in zip(chunks, chunks[1:], strict=False))
    assert S.running_sum(steps, "run", "step", "x", "v", 20_000).where("v <> step + 1").count() == 0


def test_stops_and_limits(spark, log):
    empty = log.where("false")
    assert S.running_sum(empty, "run", "step", "x", "v").count() == 0 and S.running_streak(empty, "run", "step", F.col("bad"), "v").count() == 0
    assert {r["run"]: r["stop_step"] for r in W.crossing(log, "run", "step", "x", 9).collect() if r["run"] != "long"} == {None: 8, **{f"r{i}": 1 for i in range(9, 40)}}
    cut = {r["run"]: r["n"] for r in W.budget_cut(log, "run", "step", "x", 5, strict=True).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert cut[None] == 5 and cut["bad"] == 300 and cut["none"] == 5 and cut["r5"] == 1 and "r6" not in cut
    assert {r["run"]: (r["used"], r["ran"], r["refused"]) for r in W.limited(log, "run", 7).collect()}["long"] == (900, 7, 893)
    calls = spark.createDataFrame([("e", 2, "b", "p"), ("e", 2, "a", "q"), ("e", 2, "c", "q"), ("e", 3, "z", "r"), ("f", 1, None, None), (None, 1, "x", "p")], "ep string, call int, event string, path string")
    assert sorted(map(tuple, W.latch(calls, "ep", "call", "event", "path", 2).collect())) == [("e", 2, ["a", "b"], 3), ("f", 1, [], 0)]


def all_prefixes(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_edit_distances():
    r = random.Random(11)
    for _ in range(400):
        letters = r.choice(["ab", "abcdefgh", "aé€😀"])
        a, b = ("".join(r.choices(letters, k=r.randrange(90))) for _ in "ab")
        if r.random() < 0.5:
            at = r.randrange(len(a) + 1)
            b = a[:at] + r.choice(letters) + a[at + r.randrange(3) :]
        x, y = (np.array([ord(c) for c in t], np.int64) for t in (a, b))
        want = all_prefixes(a, b)
        assert E.distance(a, b) == want
        if a and b:
            assert E._by_bits(x, y) == want and E._by_diagonals(x, y) in (None, want)
    assert E.distance("ab" * 20_000 + "x", "x" + "ab" * 20_000) == 2


def test_diagonals_of_texts_that_are_not_alike_are_left_early(monkeypatch):
    r = random.Random(5)
    a, b = ("".join(r.choices("abcdefghij klmn", k=3000)) for _ in "ab")
    x, y = (np.array([ord(c) for c in t], np.int64) for t in (a, b))
    want, steps, slide = E._by_bits(x, y), [], E._slide
    monkeypatch.setattr(E, "_slide", lambda *p: steps.append(1) or slide(*p))
    assert E.distance(a, b) == want and len(steps) < 20


def test_long_texts_with_few_changes_take_few_steps(monkeypatch):
    r = random.Random(3)
    a = r.choices("abcdefghij klmn", k=1_000_000)
    b = list(a)
    for at in r.sample(range(1_000_000), 100):
        b[at] = "X"
    steps, slide = [], E._slide
    monkeypatch.setattr(E, "_slide", lambda *x: steps.append(1) or slide(*x))
    assert E.distance("".join(a), "".join(b)) == 100 and len(steps) == 101


def test_files_that_an_instruction_mentions(spark):
    texts = [("t", "Fix notes.txt, then run; see /srv/in/data.csv2 and `käse` or .bashrc"), ("u", None), ("v", r"use a+b\E.c and x")]
    paths = [("t", p) for p in ("/a/notes.txt", "/a/notes", "/a/otes.txt", "/a/run", "/a/ru", "/srv/in/data.csv", "/srv/out/data.csv", "/a/käse", "/a/käs", "/a/.bashrc", "/a/notesxtxt", "/a/", None)]
    files = spark.createDataFrame([*paths, *paths, ("u", "/a/run"), (None, "/a/run"), ("v", r"/q/a+b\E.c"), ("v", "/q/aab"), ("v", "/q/x")], "task string, path string")
    got = {tuple(r) for r in J.mentioned(files, "task", "path", spark.createDataFrame(texts, "task string, said string"), "said").collect()}
    names = {(t, p) for t, p in map(tuple, files.collect()) if p and (said := dict(texts).get(t)) and ((n := p.split("/")[-1]) and re.search(rf"\b{re.escape(n)}\b", said) or p in said)}
    assert got == names and {("t", "/a/notes"), ("t", "/a/notes.txt"), ("t", "/srv/in/data.csv"), ("v", r"/q/a+b\E.c")} <= got and ("t", "/a/.bashrc") not in got
