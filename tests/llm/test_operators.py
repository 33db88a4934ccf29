"""The ten operators against brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trialspark.llm import bpe, fingerprint, licenses, minhash, mixing, pii, quality, substrings, tokenfile, toxicity
from trialspark.llm.registry import ORACLE, QUERIES
from trialspark.shared import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 ------------------------------------------------------------------------------------------------------------------


def base_counts(t):
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_quality(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf)
    got = sorted((r["doc_id"] or -1, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["base_failed"]) for r in quality.quality(docs).collect())
    want = sorted((i or -1, *(c := base_counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for i, t in pairs(docs))
    assert got == want
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept


def test_quality_keeps_good_labels(spark, sf):
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    q = quality.query(spark, sf).join(good, "doc_id").where("not base_failed")
    assert q.where("kept").count() >= 0.99 * q.count()


# 2 ------------------------------------------------------------------------------------------------------------------


def removals(texts, length=400):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        inside = np.cumsum(cover)[:-1] > 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        out.append((len(t), int(inside.sum()), len(starts), sha(bytes(np.frombuffer(t, np.uint8)[~inside]))))
    return out


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_repeated_substrings(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf)
    p = pairs(docs)
    want = sorted((i or -1, *x) for (i, _), x in zip(p, removals([t.encode() for _, t in p]), strict=True))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in substrings.remove_repeats(docs).collect())
    assert got == want


def test_repeats_beside_a_null_id(spark):
    """Ids above 2**53 stay exact where a batch has a null id too."""
    text, big = "".join(f"{i * 7919 % 1000003:08d}" for i in range(113))[:900], 2**53
    docs = spark.createDataFrame([(big + 1, text), (big + 3, text), (None, "short")], "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in substrings.remove_repeats(docs).collect())
    assert got == [(0, 0), (big + 1, 900), (big + 3, 900)]


def test_substring_segments(monkeypatch, spark):
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    t = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8))
    t = t[:3000] + t[200:900] + t[3000:]
    runs = [r for r in substrings._segments([t])]
    starts = sum(len(x[2][0]) - substrings.LENGTH + 1 for x in runs)
    assert starts == len(t) - substrings.LENGTH + 1


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_edited_texts(spark, sf, odd, rows, tmp_path):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]) if rows == "odd" else documents(spark, sf)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    p = dict(pairs(docs))
    order = sorted(p, reverse=True)
    for r in fingerprint.query(spark, str(tmp_path)).collect():
        t, following = p[r["doc_id"]], p[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(t) // 2
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + following[:half]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_sketches(spark, odd, none):
    f = {r["doc_id"]: r["hashes"] for r in fingerprint.fingerprints(odd.dropDuplicates(["doc_id"])).collect()}
    assert f[5] == f[6] and f[1] == f[2] == f[3] == [] and f[9] == f[10] and len(f[9]) == 1
    x = spark.createDataFrame([(f[5], f[7], f[4])], "a array<long>, b array<long>, c array<long>")
    r = x.select(fingerprint.likeness("a", "b").alias("near"), fingerprint.likeness("a", "c").alias("far"), fingerprint.containment("a", "b").alias("inside")).first()
    assert r["near"] > 0.5 > r["far"] and r["inside"] > 0.5
    assert fingerprint.fingerprints(none).count() == 0 and fingerprint.with_next(odd).count() == odd.count() and fingerprint.with_next(none).count() == 0


def test_sketch_estimates_follow_the_truth(spark):
    a = [f"t{i}" for i in range(4000)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:1000])), (3, " ".join(a[2000:] + [f"u{i}" for i in range(2000)]))], "doc_id long, text string")
    f = {r["doc_id"]: set(r["hashes"]) for r in fingerprint.fingerprints(docs).collect()}
    assert len(f[2] & f[1]) / len(f[2]) > 0.95 and abs(len(f[1] & f[3]) / len(f[1]) - 0.5) < 0.1


# 4 ------------------------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(digits[::-1])) % 10 == 0


def private(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y@z.w", "@b.c", "a@b..c", "1.2.3.4.5.6.7.8", "01.002.3.4", "1.2.3.4444", "4111-1111 1111 1111", "5 41111111 11111111", "+1 2 3", "++1 (017) 555-7713.", "+1-+1 017 555 7713 9", "é@b.c a%@b-.d-", ""])
def test_base_spans(text):
    assert pii.base_spans(text) == private(text)


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_private_data(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf)
    got = sorted(((r["doc_id"] or -1, [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]][: len(r["base"])]) for r in pii.with_spans(docs, ["doc_id"]).collect()), key=repr)
    assert got == sorted(((i or -1, private(t), private(t)) for i, t in pairs(docs)), key=repr)


def test_bootstrapping_finds_unseen_forms(spark, none):
    key = hashlib.sha1(b"1").hexdigest()
    rows = [(i, f"word{i} some api key = {hashlib.sha1(str(i).encode()).hexdigest()} end") for i in range(30)] + [(100, "the api key = ZX-9431-QQ-77 end"), (101, f"loose {key} and 12345678a"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.with_spans(docs, ["doc_id"]).collect()}
    assert got[100] == [("id", 14, 27)] and len(got[3]) == 1 and got[101] == [] and got[102] == []
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[100] == "the api key = [ID] end" and masked[102] is None
    assert pii.mask(none.select("doc_id", "text", "lang", "source", "n_chars")).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def near_groups(p):
    sets = defaultdict(list)
    for i, t in p:
        w = WORD.findall(t.translate(FOLD))
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(set)
    for i, many in sets.items():
        for s in many:
            for g in s:
                where[g].add(i)
    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
            u, v = sorted((find(a), find(b)))
            root[v] = u
    return sorted((i, len(s), find(i), find(i) == i) for i, many in sets.items() for s in many)


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_near_duplicates(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf)
    p = [(i, t) for i, t in pairs(docs) if i is not None]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == near_groups(p)


def test_near_duplicate_chains_and_hot_groups(spark):
    """A chain of texts of which only neighbours are close, and a group whose members are close to their source and not to each other."""
    base = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(base[14 * i : 14 * i + 200])) for i in range(8)]
    rng = np.random.default_rng(4)
    group = [(1000, " ".join(base[::-1]))]
    for k in range(300):
        w = base[::-1]
        for at in rng.choice(380, 12, replace=False):
            w[at] = f"c{k}x{at}"
        group.append((1001 + k, " ".join(w)))
    p = chain + group
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(p, "doc_id long, text string")).collect())
    assert got == near_groups(p)


def test_near_duplicates_of_nothing(spark, odd, none):
    assert minhash.near_duplicates(none).count() == 0
    r = minhash.near_duplicates(odd.where("doc_id is null")).first()
    assert r["component_id"] is None and r["kept"]


@pytest.mark.parametrize("size", [300, 600])
def test_large_families_send_rows_in_proportion(spark, monkeypatch, size):
    """Near copies of one text: two texts for each member at most, and blocks only for what stays apart."""
    base, sent = [f"w{i}" for i in range(200)], []
    rng, dealt, confirm = np.random.default_rng(size), minhash._dealt, minhash._confirm
    p = [(k, " ".join(w if i != at else f"c{k}" for i, w in enumerate(base))) for k, at in enumerate(rng.integers(0, 190, size))]
    monkeypatch.setattr(minhash, "_dealt", lambda rows, *a: sent.append(dealt(rows, *a).count()) or dealt(rows, *a))
    monkeypatch.setattr(minhash, "_confirm", lambda edges, texts: sent.append(edges.count()) or confirm(edges, texts))
    got = minhash.near_duplicates(spark.createDataFrame(p, "doc_id long, text string")).agg(F.count_distinct("component_id")).first()[0]
    assert got == 1 and sum(sent) <= 4 * size


# 6 and 7 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_bpe(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf)
    path = public_tokenizers.path(bpe.VOCABULARY)
    t = bpe.tokenizer(path)
    want = sorted((i or -1, ids := t.encode(x, add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for i, x in pairs(docs))
    got = sorted((r["doc_id"] or -1, list(r["ids"]), r["decoded"]) for r in bpe.encode_and_decode(docs, path).collect())
    assert got == want


def test_bpe_of_nothing(none):
    assert bpe.encode_and_decode(none, public_tokenizers.path(bpe.VOCABULARY)).count() == 0


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_token_files(spark, sf, odd, rows, tmp_path):
    docs = odd if rows == "odd" else documents(spark, sf)
    path, uri = public_tokenizers.path(tokenfile.VOCABULARY), f"file://{tmp_path}/set"
    manifest = tokenfile.write_tokens(docs, uri, path, parts=3)
    t = tokenfile.tokenizer(path)
    want, at = [], 0
    encoded = [(i, [*t.encode(x, add_special_tokens=False).ids, 1], x) for i, x in pairs(docs)]
    for i, ids, _ in sorted(encoded, key=lambda r: (r[0] is None, r[0] or 0, r[2])):  # rows without an id last
        want.append((i, at, ids))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenfile.read_tokens(spark, uri).collect()), key=lambda r: r[1])
    assert got == want and manifest["ids"] == at
    assert tokenfile.checksum([1, 2]) == zlib.crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0]))


def test_no_tokens(spark, none, tmp_path):
    tokenfile.write_tokens(none, f"file://{tmp_path}/none", public_tokenizers.path(tokenfile.VOCABULARY))
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_words_encoded_at_once():
    """Equal to each word alone, also next to letters that combine, added tokens and their parts."""
    path = public_tokenizers.path(tokenfile.VOCABULARY)
    t = tokenfile.tokenizer(path)
    rng = np.random.default_rng(5)
    signs = list("abcé日\u0301\u200d'’<|>1.٣İß#\U0001f600\u00a0")
    words = {"".join(rng.choice(signs, rng.integers(1, 7))).encode() for _ in range(4000)} | {b"<|endoftext|>", b"x<|endoftext|>y", b"", b"<|", b"|>", "\u0301".encode(), b"it's"}
    words = sorted(words)
    assert tokenfile._encode_words(t, words, "<u2") == [np.array(t.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes() for w in words]


# 8 ------------------------------------------------------------------------------------------------------------------


def targets(sizes):
    s = defaultdict(int)
    for source, n in sizes:
        s[source] += n
    order = sorted(s, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
    total, fixed, left = 1.5 * sum(s.values()), {}, set(order)
    while left:
        rest, w = total - sum(fixed.values()), sum(weight[x] for x in left)
        now = {x: rest * weight[x] / w for x in left}
        over = [x for x in left if now[x] > 2 * s[x]]
        if not over:
            return s, fixed | now
        for x in over:
            fixed[x] = 2 * s[x]
            left.discard(x)
    return s, fixed


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_mixing(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf)
    size, want = targets([(r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()])
    x = mixing.mix(docs).collect()
    assert len(x) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in x)
    for source in want:
        ours = [r for r in x if r["source_size"] == size[source] and abs(r["target"] - want[source]) <= 1e-6 * max(1, want[source])]
        assert ours
    assert sum(r["taken"] for r in x) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    assert sorted(map(repr, x)) == sorted(map(repr, mixing.mix(docs).collect()))


def test_each_source_comes_near_its_target(spark, sf):
    source = {r["doc_id"]: r["source"] for r in documents(spark, sf).collect()}
    taken, target = Counter(), {}
    for r in mixing.query(spark, sf).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in target)


def test_mixing_of_nothing(none, odd):
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text is null")).first()["taken"] == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


# 9 ------------------------------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    m = toxicity.Matcher({toxicity.fold("idiot"): 1.0, toxicity.fold("loser"): 1.0, "trash": 1.0, "réeux*": 1.0})
    assert [m.total(t) for t in ("an IDIOT", "1d10t!", "іdіоt", "an i-d", "idiots", "10ser l0ser", "trash can trash", "réeuxment", "véréeux", "")] == [1, 1, 1, 0, 0, 2, 1, 1, 0, 0]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in toxicity.query(spark, sf).where("held_out").join(label, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.8 and c.get((0, 1), 0) / (c[0, 0] + c.get((0, 1), 0)) < 0.01


def test_toxicity_of_odd_rows(spark, odd, none):
    model = ({"idiot": 3.0}, 4.0, -2.0)
    r = toxicity.score(odd, model).collect()
    assert len(r) == odd.count() and all(0 <= x["score"] <= 1 and x["held_out"] is not None for x in r)
    want = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 20)}
    assert all(x["held_out"] == want[x["doc_id"]] for x in r if x["doc_id"] is not None)
    assert toxicity.score(none, model).count() == 0
    labels = spark.createDataFrame([(5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, labels)).count() == odd.count()
    assert toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).count() == odd.count()


def test_mixed_documents_keep_null_and_repeated_ids(spark):
    rows = [(i if i % 3 else None, f"s{i % 2}", f"text {i} " + "word " * (i % 7)) for i in range(60)]
    rows += [(5, "s0", "other words under a known id " * k) for k in (1, 3)] + [(None, "s1", "the same row again")] * 4 + [(7, None, "no source")] + [(None, "s0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mark = {(r["doc_id"], r["source"], r["mark"]): (r["doc_id"], r["source"], r["text"]) for r in docs.withColumn("mark", F.xxhash64("text")).collect()}
    want = Counter()
    for r in mixing.mix_rows(docs).where("size > 0").collect():
        want[mark[r["doc_id"], r["source"], r["mark"]]] += int(r["taken"] / r["size"] + 0.5)
    got = Counter(map(tuple, mixing.mixed_documents(docs).collect()))
    assert got == +want and sum(n for r, n in got.items() if r[0] is None) > 10


# 10 -----------------------------------------------------------------------------------------------------------------


def test_every_known_sentence_is_hinted():
    assert all(re.search(licenses.HINT, s) for s in licenses.SENTENCES.values())
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


def test_licences(spark, odd, none):
    r = {x["doc_id"]: tuple(x)[1:] for x in licenses.licences(odd).collect()}
    assert r[17] == (2, "4,3", "Apache-2.0,MIT") and r[1] == r[2] == r[9] == (0, "", "")
    order = ". ".join(licenses.SENTENCES[i] for i in (11, 12, 1, 13))
    wrong = ". ".join(licenses.SENTENCES[i] for i in (13, 12, 11))
    x = spark.createDataFrame([(1, order), (2, wrong)], "doc_id long, text string")
    assert [y["licences"] for y in licenses.licences(x).orderBy("doc_id").collect()] == ["GPL-3.0,MIT", ""]
    assert licenses.licences(none).count() == 0 and licenses.licences(odd).count() == odd.count()


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
GPL = """;; This program is free software: you can redistribute it and/or modify
;; it under the terms of the GNU General Public License as published by
;; the Free Software Foundation, either version 3 of the License, or
;; (at your option) any later version.
;;
;; This program is distributed in the hope that it will be useful,
;; but WITHOUT ANY WARRANTY; without even the implied warranty of
;; MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
;; GNU General Public License for more details."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.\r
"""


def test_wrapped_licences(spark):
    import textwrap

    wrapped = lambda ids, n: "\n\n".join(textwrap.fill(licenses.SENTENCES[i].capitalize() + ".", n) for i in ids)
    texts = [APACHE, GPL, UNLICENSE, wrapped((11, 12, 13), 72), "\n".join("# " + x for x in wrapped((14, 15, 16, 17), 60).split("\n")), wrapped((30,), 20)]
    texts += ["Licensed under the Apache License, Version 2.0\n(the", "licensed under\n\nthe MIT license", "licensed under. the MIT license"]
    r = licenses.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["licences"] for x in r] == ["Apache-2.0", "GPL-3.0-or-later", "Unlicense", "MIT", "BSD-3-Clause", "ISC", "Apache-2.0", "", ""]
    assert r[0]["sentence_ids"] == "5,6,7,8,9,10" and r[1]["sentence_ids"] == "18,20,21"


def test_licence_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = c.execute(ORACLE["op10_license_rules"])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(n)] for n in ("doc_id", "n_known", "sentence_ids", "licences")) for r in cursor.fetchall())
    assert sorted(map(tuple, QUERIES["op10_license_rules"](spark, sf).select("doc_id", "n_known", "sentence_ids", "licences").collect())) == want


# all ----------------------------------------------------------------------------------------------------------------


def test_registered(spark, sf):
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 14))
    n = documents(spark, sf).count()
    for name in ("op3_scaled_sketches", "op9_folded_lexicon_toxicity"):
        assert QUERIES[name](spark, sf).count() == n


def test_pipeline(spark, sf):
    """Stage by stage against the operators' own definitions."""
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    docs = documents(spark, sf).withColumn("extra", F.lit(1))
    after = {}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        assert tuple(docs.columns) == c.COLUMNS
        after[name] = {r["doc_id"]: r["text"] for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    good = {r["doc_id"] for r in quality.query(spark, sf).where("kept").collect()}
    assert set(after["quality"]) == good
    assert set(after["near_duplicates"]) == {i for i, _, root, kept in near_groups([(i, t) for i, t in after["quality"].items()]) if kept}
    assert set(after["personal_data"]) == set(after["near_duplicates"]) and not any(private(t) for t in after["personal_data"].values() if "[" not in t)
    assert not any("@mail" in t for t in after["personal_data"].values())
    assert set(after["mixing"]) <= set(after["personal_data"])
    done = c.STAGES[-1][1](spark, docs, sf)
    assert done.count() == docs.count() and all(r["decoded"] == after["mixing"][r["doc_id"]] for r in done.collect())


# What the methods add, against independent versions --------------------------------------------------------------------


def gram_chars(text, k):
    """Characters of words in k-word windows found twice or more."""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    n = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(k)}
    return sum(len(words[i]) for i in inside)


@pytest.mark.parametrize("rows", ["odd", "sf"])
def test_quality_measures_and_verdict(spark, sf, odd, rows):
    docs = odd if rows == "odd" else documents(spark, sf).limit(400)
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality(docs).collect()}
    for i, text in pairs(docs):
        words = WORD.findall(text)
        r = got[i, len(words)]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dup = sum(len("".join(WORD.findall(x))) for k, x in enumerate(lines) if x in lines[:k])
        grams = {k: gram_chars(text, k) for k in quality.GRAM_LIMITS}
        assert r["dup_line_chars"] == dup and all(r[f"dup_{k}gram_chars"] == v for k, v in grams.items())
        chars = sum(map(len, words))
        bad = dup > 0.30 * chars or any(v > quality.GRAM_LIMITS[k] * chars for k, v in grams.items()) or r["n_symbols"] > 0.1 * len(words)
        assert r["kept"] == (not r["base_failed"] and not bad)


def independent_sketch(text):
    """Shingle hashes by the xxhash library, with the seeds that a chain of hashes has."""
    import struct

    import xxhash

    one = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)
    words = [one(w.encode(), 42) for w in re.split("[ \\t\\n\\x0b\\f\\r]+", text.lower()) if w]
    shingles = set()
    for window in [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else []):
        h = 42
        for w in window:
            h = one(struct.pack("<Q", w), h)
        shingles.add(h)
    low = {h for h in shingles if h >> 60 == 0}
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    return (low | {min(shingles, key=signed)} if shingles else set()), shingles


def test_sketches_and_likeness(spark, sf):
    docs = documents(spark, sf).limit(150)
    held = {r["doc_id"]: ({h % 2**64 for h in r["hashes"]}, r["text"]) for r in fingerprint.fingerprints(docs.select("doc_id", "text")).collect()}
    exact = {i: independent_sketch(t or "") for i, (_, t) in held.items()}
    assert all(held[i][0] == exact[i][0] for i in held)
    docs.write.mode("overwrite").parquet(f"{shared_dir(spark)}/few/documents.parquet")
    rows = fingerprint.query(spark, f"{shared_dir(spark)}/few").collect()
    order = sorted(held, reverse=True)
    errors = []
    for r in rows:
        at = order.index(r["doc_id"])
        mine, other = exact[r["doc_id"]], exact[order[(at + 1) % len(order)]]
        union = mine[0] | other[0]
        assert r["near_next"] == pytest.approx(len(mine[0] & other[0]) / len(union) if union else 1.0)
        text, nxt = held[r["doc_id"]][1] or "", held[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        edited = independent_sketch(text[: len(text) - half] + nxt[:half])
        union, every = mine[0] | edited[0], mine[1] | edited[1]
        assert r["near_edited"] == pytest.approx(len(mine[0] & edited[0]) / len(union) if union else 1.0)
        if len(every) > 400:
            errors.append(abs(r["near_edited"] - len(mine[1] & edited[1]) / len(every)))
    assert errors and sum(errors) / len(errors) < 0.1


def brute_mix(rows):
    """taken of each (sid, source_size, target, size) in the order of its source's stream, by the definition of the schedule."""
    phi, mod = int((5**0.5 - 1) / 2 * 2**40) | 1, 2**40
    sources = {r[0]: r[1:3] for r in rows if r[2] > 0}
    words = {s: max(1, min(size // 1024, 1024)) for s, (size, _) in sources.items()}
    wanted = {s: target / words[s] for s, (_, target) in sorted(sources.items())}
    total, up, ends = sum(wanted.values()), 0.0, []
    for s, w in wanted.items():
        up += w
        ends.append((up / total, s))
    times, rank = defaultdict(Counter), Counter()
    for k in range(-int(-total // 1)):
        point = (k * phi + mod // 2) % mod / mod
        s = next((s for hi, s in ends if point < hi), ends[-1][1])
        blocks = -(-sources[s][0] // words[s])
        if rank[s] < 2 * blocks:
            times[s][rank[s] % blocks] += 1
        rank[s] += 1
    at, out = Counter(), []
    for s, _, _, size in rows:
        out.append(sum(times[s][w // words[s]] for w in range(at[s], at[s] + size)) if size else 0)
        at[s] += size
    return out


def test_words_taken_equal_the_schedule(spark, sf):
    docs = documents(spark, sf)
    rows = mixing.mix_rows(docs).withColumn("h", F.xxhash64("doc_id", F.lit(8))).collect()
    names = sorted({r["source"] for r in rows})
    count = len(rows)
    stream = sorted(rows, key=lambda r: (names.index(r["source"]), r["h"] % (count // mixing.CHUNK + 1), r["h"], r["doc_id"]))
    want = brute_mix([(names.index(r["source"]), r["source_size"], r["target"], r["size"]) for r in stream])
    assert [r["taken"] for r in stream] == want


def test_small_sources_beside_a_large_one(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("large").alias("source"), F.repeat(F.lit("word "), 1000).alias("text"))
    docs = docs.union(spark.range(3000, 3003).select("id", F.lit("small"), F.repeat(F.lit("word "), 100))).union(spark.range(4000, 4001).select("id", F.lit("tiny"), F.lit("a b c")))
    by = {r["source"]: r for r in mixing.mix_rows(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] + 3 for r in by.values())


def test_matches_and_exceptions_against_brute_force():
    lexicon = {"trash": 1.0, "idiot": 2.0, "lose*": 0.5, "can": 0.25}
    m = toxicity.Matcher(lexicon)
    rng = np.random.default_rng(3)
    phrases = [toxicity.fold(x) for x in toxicity.EXCEPTIONS]
    for _ in range(200):
        text = toxicity.fold(" ".join(rng.choice(["trash", "can", "idiot", "loser", "lose", "x", *phrases], 12)))
        bound = lambda i: i < 0 or i >= len(text) or not text[i].isalnum()  # noqa: B023, E731
        at = lambda w: [i for i in range(len(text)) if text.startswith(w, i) and bound(i - 1)]  # noqa: B023, E731
        hidden = [(i, i + len(p)) for p in phrases if p not in lexicon for i in at(p) if bound(i + len(p))]
        want = 0.0
        for entry, weight in lexicon.items():
            w, stem = entry.rstrip("*"), entry.endswith("*")
            want += sum(weight for i in at(w) if (stem or bound(i + len(w))) and not any(a <= i and i + len(w) <= b for a, b in hidden))
        assert m.total(text) == pytest.approx(want)


def test_exceptions_take_time_in_proportion():
    import time

    m, text = toxicity.Matcher({"trash": 1.0}), toxicity.EXCEPTIONS[0] + " trash "
    began = time.time()
    m.total(text * (1_000_000 // len(text)))
    assert time.time() - began < 5


def test_masking_keeps_columns_of_any_name(spark):
    t = spark.createDataFrame([("call me at +1 212 555 0199 now", 1, "b", 2, 3, 4, 5, 6, 7)], "text string, doc_id long, base string, found int, spans int, row_id int, more int, salt int, pattern int")
    r = pii.mask(t).first()
    assert r.asDict() == {"text": r["text"], "doc_id": 1, "base": "b", "found": 2, "spans": 3, "row_id": 4, "more": 5, "salt": 6, "pattern": 7} and "212" not in r["text"]


def test_mixed_documents_keep_columns_of_any_name(spark):
    t = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c d").alias("text"), F.lit(1).alias("_n"), F.lit(2).alias("_times"), F.lit(3).alias("_m"))
    assert {tuple(r)[3:] for r in mixing.mixed_documents(t).collect()} == {(1, 2, 3)}


def test_stages_with_odd_rows(spark, odd):
    """Null and repeated ids, null and empty texts go through all stages; so does an empty table."""
    import corpus_pipeline as c

    docs = odd.select(*c.COLUMNS)
    sizes = []
    for name, stage in c.STAGES:
        before, docs = docs, stage(spark, docs, "")
        path = f"{shared_dir(spark)}/odd-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        assert docs.columns == list(c.COLUMNS) or name == "encoding"
        if name == "near_duplicates":
            assert docs.where("doc_id is null").count() == before.where("doc_id is null").count() == 1
        if name == "personal_data":
            assert docs.count() == before.count()
    assert sizes[0] > 0 and sizes[3] == sizes[4]
    empty = odd.limit(0).select(*c.COLUMNS)
    for _, stage in c.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_longest_rule_and_headers(spark):
    headers = {
        "MIT": " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n * copies of the Software, and to permit persons to whom the Software is\n * furnished to do so, subject to the following conditions:\n *\n * The above copyright notice and this permission notice shall be included in all\n * copies or substantial portions of the Software.\n *\n * THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.\n",
        "MPL-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.\n",
        "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are\npermitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of\n   conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of\n   conditions and the following disclaimer in the documentation and/or other materials\n   provided with the distribution.\n",
        "GPL-2.0-only": "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;\n",
    }
    headers["BSD-3-Clause"] = headers["BSD-2-Clause"].replace("1. R", "* R").replace("2. R", "* R") + "\n* Neither the name of the copyright holder nor the names of its contributors may be used\n  to endorse or promote products derived from this software without specific prior\n  written permission.\n"
    t = spark.createDataFrame(list(enumerate(headers.values())), "doc_id long, text string")
    assert [r["licences"] for r in licenses.licences(t).orderBy("doc_id").collect()] == list(headers)
