"""Streaming exact de-duplication, source divergence and bit-plane centroids, against plain versions."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trialspark.llm import bpe, centroids, divergence, exact, fingerprint, pii
from trialspark.llm.registry import ORACLE, QUERIES
from trialspark.shared import materialise, new_path

BLANK = re.compile(r"[\x20\x09-\x0D]")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_streaming_exact_dedup", "op12_divergence_cube", "op13_bit_plane_centroids"])
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    mine = QUERIES[name](spark, sf)
    r = c.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(mine.columns)
    assert values(mine.select(*names)) == sorted(r.fetchall(), key=repr)


def exact_groups(rows):
    """(doc_id, keep_id, size, kept) of rows (doc_id, text)."""
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for members in groups.values():
        best = min(m[:3] for m in members)
        ids = [None if m[1] else m[2] for m in members]
        keep = None if best[1] else best[2]
        ties = sum(m[:3] == best for m in members)
        out += [(i, keep, len(members), m[:3] == best, ties) for i, m in zip(ids, members, strict=True)]
    return out


def same_decisions(got, want):
    """Equal but for which of several rows that are alike in id and length is kept: one is."""
    assert sorted(map(repr, ((g["doc_id"], g["keep_id"], g["group_size"]) for g in got))) == sorted(map(repr, (w[:3] for w in want)))
    kept = Counter((g["doc_id"], g["group_size"]) for g in got if g["kept"])
    assert kept == Counter({k: 1 for k in {(w[0], w[2]) for w in want if w[3]}}) or sum(kept.values()) == len({repr((w[1], w[2])) for w in want})


def saved(spark, rows, path, parts=3):
    spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long, digest string").repartition(parts, "n").write.mode("append").parquet(path)


def test_exact_dedup_of_odd_rows(spark, texts, tmp_path):
    rows = [(i, t) for i, t, _, _ in texts] + [(40, "Same  text"), (41, "Sametext"), (39, "Same\ttext\n"), (50, " "), (51, "")]
    saved(spark, rows, path := f"{tmp_path}/docs")
    exact.ingest(spark, path, home := new_path(spark, "exact"))
    got = exact.decisions(spark, path, home).collect()
    same_decisions(got, exact_groups(rows))
    by = {r["doc_id"]: r for r in got}
    assert by[39]["keep_id"] == by[41]["keep_id"] == 39 and by[39]["group_size"] == 3  # as long as 40, smaller id
    assert by[50]["group_size"] == 1 and {by[i]["keep_id"] for i in (1, 2, 3, 51)} == {3}
    twice = [r for r in got if r["doc_id"] == 14]
    assert len(twice) == 2 and sum(r["kept"] for r in twice) == 1
    assert all(bytes(r["digest"]).hex() == hashlib.sha256(BLANK.sub("", dict(rows)[r["doc_id"]] or "").encode()).hexdigest() for r in got)


def test_state_goes_on_over_batches_and_runs(spark, tmp_path):
    first = [(i, f"text {i % 7}") for i in range(20, 60)]
    later = [(i, f"text  {i % 9}") for i in range(1, 20)]
    saved(spark, first, path := f"{tmp_path}/docs", 4)
    home = new_path(spark, "exact")
    exact.ingest(spark, path, home, files=1)  # a file for each batch
    same_decisions(exact.decisions(spark, path, home).collect(), exact_groups(first))
    saved(spark, later, path, 2)
    exact.ingest(spark, path, home, files=1)
    exact.ingest(spark, path, home)  # nothing new
    got = exact.decisions(spark, path, home).collect()
    same_decisions(got, exact_groups(first + later))
    assert exact.seen(spark, home).agg(F.sum("n")).first()[0] == 59


def test_equal_digests_of_other_texts_are_held_apart(spark, tmp_path):
    rows = [(i, f"body {i % 6}" + " " * (i % 2)) for i in range(60)] + [(100, None), (101, "alone")]
    weak = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))  # noqa: E731  16 digests
    saved(spark, rows, path := f"{tmp_path}/docs")
    exact.ingest(spark, path, home := new_path(spark, "exact"), weak)
    same_decisions(exact.decisions(spark, path, home, weak).collect(), exact_groups(rows))


def test_exact_dedup_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path := f"{tmp_path}/docs")
    exact.ingest(spark, path, home := new_path(spark, "exact"))
    assert exact.decisions(spark, path, home).count() == 0


def brute_divergences(rows):
    """The contract with Python's whole numbers, for rows (text, lang, source)."""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, n, groups, all_n = defaultdict(Counter), defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for t, lang, source in rows:
        lang, source, w = lang or "", source or "", words(t)
        groups[lang].add(source)
        docs[lang].update(set(w))
        n[lang, source].update(w)
        all_n[lang].update(w)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= 3]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(all_n[lang])
        for s in sources:
            parts = {"pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s], "term": [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= 200]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32, 8192), (4, 25)])
def test_divergence_against_brute_force(spark, texts, blocks):
    r = np.random.Generator(np.random.PCG64(5))
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(60)] + ["Word", "WORD", "\U0001f600x", "a_b", "co-op"]
    rows = [(t, lang, s) for _, t, lang, s in texts[4:]] + [(" ".join(r.choice(vocabulary, int(r.integers(0, 80)))), *r.choice(["en", "de", ""], 1), None if k % 11 == 0 else f"s{k % 9}") for k in range(150)]
    rows += [(None, "xx", "a"), ("only once", "xx", "b"), (None, None, None), ("", "en", "no terms")]
    df = spark.createDataFrame([(str(t) if t is not None else None, str(g) if g is not None else None, str(s) if s is not None else None, 1, "t") for t, g, s in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = divergence.divergences(df, *blocks)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergences(rows)


def test_divergence_of_nothing(spark, none):
    assert divergence.divergences(none).count() == 0


def test_shares_beyond_64_bits(spark):
    x = spark.createDataFrame([(10**13, 3 * 10**13, 10**9)], "n long, of long, terms long").select(divergence._share("n", "of")).first()[0]
    assert x == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**9)


def lloyd(vectors, k=16, rounds=3):
    """The contract for (vec_id, whole-number vector), in Python's whole numbers."""
    order = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"1:{v[0]}".encode()).hexdigest()))
    cents = [list(v[1]) for v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((distance(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in vectors:
            mine[near(v)[1]].append(v)
        cents = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if mine[j] else c for j, c in enumerate(cents)]
    found = [(i, *reversed(near(v))) for i, v in vectors]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, j, d, per[j], sum(per.values()), digest[j]) for i, j, d in found)


@pytest.mark.parametrize("n", [3, 40, 400])
def test_centroids_against_whole_numbers(spark, n):
    r = np.random.Generator(np.random.PCG64(n))
    rows = [(i, [float(x) for x in r.normal(0, 10.0 ** (i % 4 - 1), 64)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)]  # one very common vector
    odd = [(9001, None), (9002, []), (9003, rows[0][1][:63]), (9004, [*rows[0][1], 0.0]), (9005, [None, *rows[0][1][1:]]), (9006, [math.nan, *rows[0][1][1:]]), (9007, [math.inf, *rows[0][1][1:]]), (9008, [-math.inf, *rows[0][1][1:]])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster int").repartition(4)
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    assert sorted(map(tuple, centroids.report(df).collect())) == lloyd(whole)


def test_centroids_of_nothing_and_of_one_id(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.report(df).count() == 0
    rows = [(1, [float(k)] * 64) for k in range(30)] + [(None, [0.5] * 64)]
    got = centroids.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 31 and len({r["inertia"] for r in got}) == 1
    with pytest.raises(Exception, match="not below"):
        centroids.report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


def test_planes_are_exact():
    r = np.random.Generator(np.random.PCG64(1))
    for scale in (1, 2, 100, 2**20, 2**26):
        x, y = r.integers(-scale, scale, (50, 64)), r.integers(-scale, scale, (1, 64))
        x[0], x[1] = -scale, scale - 1
        a, b = centroids.planes_of(x), centroids.planes_of(y)
        assert (centroids.numbers(a) == x).all()
        assert (centroids.dots(a, b[:, 0]) == (x * y).sum(axis=1)).all() and (centroids.squared(a) == (x * x).sum(axis=1)).all()


def test_long_identifiers_and_keys(spark):
    """Identifiers of any length are found; a long key is a seed, a long base span gives no span of its own."""
    keys = [hashlib.sha256(str(i).encode()).hexdigest() * (8 if i % 2 else 1) for i in range(30)]
    long = "Q7-" * 400
    rows = [(i, f"word{i} some api key = {k} end") for i, k in enumerate(keys)] + [(100, f"the api key = {long} end"), (101, f"the api key = {'a' * 300}1@mail.test end")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[100] == [("id", 14, 1214)] and got[101] == [("email", 14, 325)]
    assert all(got[i] == [("id", len(f"word{i} some api key = "), len(f"word{i} some api key = ") + len(k))] for i, k in enumerate(keys))
    assert len(pii.named("a1" * 200, True)) == 64 and pii.named("a1" * 200, False)[0] == "#" and pii.named("a1" * 20, False) == "a1" * 20


def scored_patterns(texts):
    """The bootstrap by plain sets: patterns and instances score each other, round by round."""
    graph = defaultdict(dict)
    for text in texts:
        for pattern, instance, _, _, seed in pii.instances(text, pii.base_spans(text)):
            graph[pattern][instance] = max(graph[pattern].get(instance, 0.0), float(seed))
    first = defaultdict(float)
    for held in graph.values():
        for instance, seed in held.items():
            first[instance] = max(first[instance], seed)
    trust = dict(first)
    for _ in range(pii.ROUNDS):
        scores = {p: (sum(trust[i] for i in held) / len(held), sum(trust[i] for i in held)) for p, held in graph.items()}
        good = {p: share for p, (share, support) in scores.items() if share >= pii.CONFIDENCE and support >= pii.SUPPORT}
        trust = dict(first)
        for p, share in good.items():
            for i in graph[p]:
                trust[i] = max(trust[i], share)
    return good


@pytest.mark.parametrize("rows", ["made", "sf"])
def test_bootstrap_against_plain_graph(spark, sf, rows):
    if rows == "sf":
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    else:
        ids = [f"ID-{i:08d}" for i in range(40)]
        texts = [f"mail me at user{i}@mail.test now" for i in range(12)] + [f"token is {hashlib.md5(str(i).encode()).hexdigest()} now" for i in range(20)] + ["token is NEW-123456 now"]
        texts += [f"badge of NEW-123456 and badge of {ids[i]}" for i in range(3)] + [f"room {i} ref {ids[i]}" for i in range(40)] + [None, ""]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = scored_patterns([r["text"] or "" for r in docs.collect()])
    scanned = docs.select("doc_id", "text").mapInArrow(pii._scanner(["doc_id"]), "doc_id long, " + pii.SPANS)
    got = {r["pattern"]: r["confidence"] for r in pii.confident_patterns(materialise(scanned, "scanned")).collect()}
    assert got.keys() == want.keys() and (want or rows == "sf") and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_fingerprint_beside_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "mine"), (2, None, None)], "doc_id long, text string, Hashes string")
    got = fingerprint.fingerprints(docs).collect()
    assert got[0]["Hashes"] == "mine" and got[0]["hashes_"] and got[1]["hashes_"] == [] and fingerprint.fingerprints(docs.drop("Hashes")).columns == ["doc_id", "text", "hashes"]


def test_words_forgotten_and_encoded_again():
    """A bucket's blocks come in batches; a task that forgets its known words gives the same ids."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    words = [["one", " two", " three"], [" two", " four"], ["one", " five", " two"]]
    packs = [pd.DataFrame({"block": [i], "bucket": [0], "words": [zlib.compress(json.dumps([[0] + [1] * (len(w) - 1), w]).encode())]}) for i, w in enumerate(words)]
    all_at_once, forgetful = (pd.concat(bpe._bucket_encoder(path, most)(iter(p))) for most, p in ((100, [pd.concat(packs)]), (0, packs)))
    assert all_at_once["ids"].tolist() == forgetful["ids"].tolist() and forgetful["of_block"].tolist() == [0, 1, 2]


def test_words_of_letters_are_encoded_without_marks_between():
    """Only words that are more than letters are held apart by an added token; a letter that is two once it is lower-cased gets its own ids."""
    import public_tokenizers

    from trialspark.llm import tokenfile

    real, seen = tokenfile.tokenizer(public_tokenizers.path(tokenfile.VOCABULARY)), []

    class Watched:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return real.encode_batch_fast(texts, **more)

    for words in (["bread", "größe", "été", "x", "猫"], ["bread", "İstanbul", "it's", "a1b22", "<|endoftext|>", "$$"]):
        want = [real.encode(w, add_special_tokens=False).ids for w in words]
        got = tokenfile._encode_words(Watched(), [w.encode() for w in words], "<u2")
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
        if words[-1] == "猫":
            assert not any("<|" in x for x in seen)
