"""Source divergence audit: how far the word use of each (lang, source) group lies from every other source of the language and
from the language as a whole, by a cube of cells over (group block, group block, term block)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.textnum import text_batches
from trialspark.shared import written

#: Fixed values of the contract: parts of a thousand millions, and documents of a language that a kept term is in.
SCALE, LEAST_DOCS = 1_000_000_000, 3
#: Groups of a block and terms of a block, on average: a cell holds about twice their product at most.
GROUP_BLOCK, TERM_BLOCK = 32, 8192
#: Ranks of part term.
TOP_TERMS = 200
#: Different terms that a task counts before it gives rows.
HELD = 400_000
#: A-Z are lowered, letters and all beyond ASCII stay, what is left is a blank.
FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), words in total.items():
            inside, n = docs[lang, source], len(words) + 1
            terms = pa.array([None, *(t.decode() for t in words)], pa.string())
            arrays = [pa.array([lang] * n), pa.array([source] * n), terms, pa.array([0, *words.values()]), pa.array([0, *(inside[t] for t in words)])]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in COUNTS.split(", ")])
        total.clear()
        docs.clear()

    for part, texts in text_batches(batches):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts, strict=True):
            words = text.translate(FOLD).split()
            total.setdefault((lang or "", source or ""), Counter()).update(words)
            docs.setdefault((lang or "", source or ""), Counter()).update(set(words))
        if sum(map(len, total.values())) > HELD:
            yield from rows()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group and the group's documents that have it; for each group
    also a row without a term. Tasks sum before anything is shuffled."""
    rows = docs.select("text", "lang", "source").mapInArrow(_counts, COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, of: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (of + terms)) in whole numbers of up to 38 digits."""
    return F.expr(f"1 + cast({n} + 1 as decimal(20, 0)) * {SCALE} div cast(greatest({of} + terms, 1) as decimal(20, 0))")


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Both directions of all pairs of one group of block a and one of block b, over the terms of one block."""
    lang, a, b, size = pdf["lang"].iloc[0], pdf["a"].iloc[0], pdf["b"].iloc[0], int(pdf["size"].max())
    code, terms = pd.factorize(pdf["term"])  # -1: the row that gives a group's share of a term it does not have

    def slice_of(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (pdf["block"] == block).to_numpy()
        group, names = pd.factorize(pdf["source"][at])
        p, term = pdf["p"].to_numpy()[at], code[at]
        none = np.zeros(len(names), np.int64)
        none[group[term < 0]] = p[term < 0]
        dense = np.repeat(none[:, None], len(terms), axis=1)
        dense[group[term >= 0], term[term >= 0]] = p[term >= 0]
        return np.asarray(names), none, dense

    left, right = slice_of(a), slice_of(b)
    absent = size - len(terms)
    out = []
    for one, other in ((left, right),) if a == b else ((left, right), (right, left)):
        for name, none, p in zip(*one, strict=True):
            value = ((p - other[2]) ** 2 // other[2]).sum(axis=1) + absent * ((none - other[1]) ** 2 // other[1])
            out += [(lang, name, item, int(v)) for item, v in zip(other[0], value, strict=True) if item != name]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source): part pair holds each other source of the language,
    part term the terms that the group uses more than its language does, up to rank top.

    Null text, lang and source are ''. A group without terms, or whose language keeps no term, has pairs of value 0 in the latter
    case, and no terms. Equal values are ranked by item, so repeated rows change counts only. An empty table gives no rows; other
    columns are ignored; a text of any length is counted whole.

    Groups and terms are dealt to blocks by hash. Each slice (group block, term block) goes to the cells of all pairs with its
    group block; a cell sums over its own terms, and the sums of the term blocks are added. Shares are at most SCALE + 1, so their
    differences squared fit into 64 bits.
    """
    counts, _ = written(term_counts(docs), "counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept, _ = written(by_term.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "all_n"), "terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_of"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left").na.fill(0, ["terms", "all_of"])
    langs = langs.withColumn("group_blocks", F.ceil(F.col("sources") / group_block)).withColumn("term_blocks", F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)))
    own = counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
    totals = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("of")), ["lang", "source"], "left").na.fill(0, ["of"]).join(langs, "lang")
    totals, _ = written(totals.withColumn("block", F.expr("pmod(xxhash64(source), group_blocks)")).withColumn("none", _share("0", "of")), "groups")
    term_at = F.expr("pmod(xxhash64(term), term_blocks)").alias("t")
    shares = own.join(totals, ["lang", "source"]).select("lang", "source", "term", "block", "group_blocks", term_at, _share("n", "of").alias("p"), _share("all_n", "all_of").alias("q"))
    shares, _ = written(shares, "shares")

    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    block_sizes = kept.join(langs, "lang").groupBy("lang", term_at).agg(F.count("*").alias("size"))
    base = totals.select("lang", "source", "block", "group_blocks", F.explode(F.expr("sequence(0, term_blocks - 1)")).alias("t"), F.col("none").alias("p")).join(block_sizes, ["lang", "t"], "left")
    slices = base.select("lang", "source", F.lit(None).cast("string").alias("term"), "block", "group_blocks", "t", "p", F.coalesce("size", F.lit(0)).alias("size"))
    slices = slices.union(shares.select("lang", "source", "term", "block", "group_blocks", "t", "p", F.lit(0).cast("long")))
    cells = slices.withColumn("c", F.explode(F.expr("sequence(0, group_blocks - 1)"))).select("lang", F.least("block", "c").alias("a"), F.greatest("block", "c").alias("b"), "t", "block", "source", "term", "p", "size")
    partial = cells.groupBy("lang", "a", "b", "t").applyInPandas(_cell, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(over.select("*", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term
), g AS (
  SELECT lang, source FROM d GROUP BY lang, source
), v AS (
  SELECT lang, count(*) AS terms, sum(ln) AS total FROM k GROUP BY lang
), gn AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.terms) AS p,
         1 + (1000000000::HUGEINT * (k.ln + 1)) // (v.total + v.terms) AS q
  FROM gn JOIN v ON gn.lang = v.lang JOIN k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
