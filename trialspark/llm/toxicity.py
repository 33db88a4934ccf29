"""Toxicity from a weighted lexicon: texts are folded (case, homoglyphs, digits for letters), entries are found by Aho-Corasick,
exception phrases hide the entries inside them, and the weighted hits are normalised by length.

Weights come from labelled rows outside the held-out fold; a document's score depends on its text alone.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Look-alikes of Latin letters (Cyrillic, Greek and others), and signs written for letters. The letters i, j's
# dotless forms and l, and the signs for them, all become i, since 1 and | stand for either.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "н": "h",
    "т": "t", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
    "υ": "u", "ı": "i", "ⅼ": "i", "ⅰ": "i", "ℓ": "i", "Ӏ": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
}
#: Accented letters that tell words of the corpus' languages apart; they are kept.
OWN_LETTERS = "àâäáçéèêëíîïñóôöúùûüß"
#: Entries known beforehand; those that the labelled rows say nothing about keep PRIOR_WEIGHT.
LEXICON = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "asshole", "dumbass", "retard", "shithead", "scumbag", "dimwit", "halfwit")
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "idiot proof", "stupid simple", "clown fish", "sore loser rule", "pathetic fallacy")
PRIOR_WEIGHT = 3.0
#: Most labelled rows that weights are learned from; of more, a share chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Most candidates for learned entries.
LEARNED = 1024
#: Letters of a stem: an entry that ends in * stands for all words that begin so.
STEMS = range(4, 9)
#: A toxic row is explained by so many entries.
COVER = 3
LENGTH_POWER = 0.15


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c.upper()): c for c in OWN_LETTERS if len(c.upper()) == 1}
    for c in (c for c in map(chr, range(0xC0, 0x250)) if c.lower() not in OWN_LETTERS):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        table[ord(c)] = "".join(LOOKALIKES.get(x, x) or "" for x in plain)
    for c, to in LOOKALIKES.items():
        for form in {c, c.upper()}:
            if len(form) == 1:
                table[ord(form)] = to
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = LOOKALIKES.get(chr(c + 32), chr(c + 32))
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        plain = chr(c - 0xFEE0).lower()
        table[c] = LOOKALIKES.get(plain, plain)
    return table


FOLDING = _folding()


#: Signs that stand for letters only where a letter or digit follows.
_CLOSING = re.compile(r"[!|$@]+(?!\w)")


def fold(text: str) -> str:
    if any(c in text for c in "!|$@"):
        text = _CLOSING.sub(" ", text)
    return text.translate(FOLDING)


def entries(text: str) -> set[str]:
    """All words of the folded text, and the stems of those that are longer."""
    words = {w for x in fold(text).split() if 3 <= len(w := x.strip(".,;:?\"'()[]{}*#%&-_<>/\\")) <= 40}
    return words.union(f"{w[:n]}*" for w in words for n in STEMS if len(w) > n)


class Matcher:
    """Hits of a lexicon at word bounds, but not inside an exception phrase."""

    def __init__(self, weights: dict[str, float]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in EXCEPTIONS:
            if (f := fold(phrase)) not in weights:
                self.automaton.add_word(f, (len(f), False, None))
        whole = {}
        for entry, weight in weights.items():  # a word that is also a stem counts once, as the heavier
            word, stem = entry.rstrip("*"), entry.endswith("*")
            whole[word] = max(whole.get(word, (len(word), stem, weight)), (len(word), stem, weight), key=lambda x: (x[1], x[2]))
        for word, entry in whole.items():
            self.automaton.add_word(word, entry)
        self.automaton.make_automaton()

    def total(self, text: str) -> float:
        f = fold(text)
        hits, hidden = [], []
        for last, (length, stem, weight) in self.automaton.iter(f):
            first = last - length + 1
            if (first == 0 or not f[first - 1].isalnum()) and (stem or last + 1 == len(f) or not f[last + 1].isalnum()):
                (hidden if weight is None else hits).append((first, last, weight))
        hidden.sort()
        starts, reach = [x for x, _, _ in hidden], list(accumulate((y for _, y, _ in hidden), max))
        return sum(w for a, b, w in hits if not ((k := bisect_right(starts, a)) and reach[k - 1] >= b))


def strength(total: float, n_words: int) -> float:
    return total / max(n_words, 1) ** LENGTH_POWER


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in entries(text or ""):
                counts.setdefault(w, [0, 0])[toxic] += 1
        if len(counts) > 500_000:
            yield pa.RecordBatch.from_pydict({"word": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})
            counts = {}
    yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})


def _found(words: list[str]):  # noqa: ANN202
    place = {w: i for i, w in enumerate(words)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            found = [sorted(place[w] for w in entries(t) if w in place) for t in texts]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "found": pa.array(found, pa.list_(pa.int32())), "n_words": pa.array([len(t.split()) for t in texts], pa.int64())})

    return rows


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float, float]:
    """Folded entry -> weight, and slope and offset of the logistic curve over strength().

    Uses at most about SAMPLE_ROWS labelled rows; what reaches the driver is bounded by LEARNED words and that sample's hits.
    Entries are taken greedily: each must tell toxic rows that have fewer than COVER earlier entries from clean ones, so that
    a word that only rides along (in copies of one toxic text) gains nothing.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out("doc_id"))
    share = SAMPLE_ROWS / max(SAMPLE_ROWS, known.count())
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")  # bounded by SAMPLE_ROWS
    counts = rows.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    top = counts.where("toxic >= 3 and toxic > 4 * clean").orderBy(F.desc(F.col("toxic") - 4 * F.col("clean")), F.desc(F.length("word")), "word").limit(LEARNED).collect()
    base = [fold(w) for w in LEXICON]
    words = base + sorted((r["word"] for r in top if r["word"] not in set(base)), key=lambda w: (w.endswith("*"), -len(w), w))
    sample = rows.mapInArrow(_found(words), "toxic int, found array<int>, n_words long").collect()
    toxic = np.array([r["toxic"] for r in sample], bool)
    has = np.zeros((len(sample), len(words)), bool)
    for i, r in enumerate(sample):
        has[i, r["found"]] = True
    weights = {w: PRIOR_WEIGHT for w in base}
    covered, open_ = np.zeros(len(sample), int), np.ones(len(words), bool)
    least = max(4, 0.004 * toxic.sum())
    clean = has[~toxic].sum(axis=0)
    for _ in range(len(words)):
        gain = np.where(open_, has[(covered < COVER) & toxic].sum(axis=0) - 10.0 * clean, -np.inf)
        if not len(gain) or gain[best := int(gain.argmax())] < least:
            break
        weights[words[best]] = min(8.0, max(1.0, log((has[toxic, best].sum() + 0.5) / (toxic.sum() + 1)) - log((has[~toxic, best].sum() + 0.5) / ((~toxic).sum() + 1))))
        covered += has[:, best]
        taken = words[best].rstrip("*")
        open_ &= [not (w.startswith(taken) or taken.startswith(w.rstrip("*"))) for w in words]
    total = has @ np.array([weights.get(w, 0.0) for w in words])
    x = np.array([strength(a, r["n_words"]) for a, r in zip(total, sample, strict=True)])
    slope, offset = fit(x, toxic)
    return weights, slope, offset


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable, lightly regularised, classes weighed alike; a fixed curve if one class is missing."""
    if not y.any() or y.all():
        return 4.0, -2.0
    a = np.column_stack((x, np.ones(len(x))))
    w, beta = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + 1e-4 * beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(column: str) -> F.Column:
    """Rows that nothing is learned from; those without an id are among them."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, model: tuple[dict[str, float], float, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    A null or empty text scores as one without hits. A null doc_id counts as held out. Repeated rows are scored one by one;
    other columns are ignored; an empty table gives an empty one.
    """
    weights, slope, offset = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for batch in batches:
            x = np.array([strength(matcher.total(t or ""), len((t or "").split())) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
