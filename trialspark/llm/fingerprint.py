"""Document fingerprints: a threshold-scaled sketch of shingle hashes, in DataFrame functions alone.

Of the five-word shingles of a text, every hash below a fixed share of the hash range is kept, and the least hash in any case.
Sketches merge by union (and the least of the least hashes); the share of one sketch found in another estimates how much of
one document the other contains, however unequal their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = 5
#: One in 2**SCALE_BITS shingle hashes is kept.
SCALE_BITS = 4
SPACE = "[\\x20\\x09-\\x0D]+"


def word_hashes(text: str | Column) -> Column:
    """array<long>: a hash of each word of the lower-cased text."""
    return F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(hashes: str) -> Column:
    """Sorted kept shingle hashes of an array column of word hashes; fewer words are one shingle, no words an empty sketch."""
    n = F.size(hashes)
    shingles = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WORDS)))))
    shingles = shingles.when(n > 0, F.array(F.xxhash64(F.col(hashes)))).otherwise(F.array().cast("array<long>"))
    return shingles


def kept(shingles: str) -> Column:
    low = F.filter(shingles, lambda x: F.shiftrightunsigned(x, 64 - SCALE_BITS) == 0)
    least = F.array_compact(F.array(F.array_min(shingles)))
    return F.array_sort(F.array_distinct(F.concat(low, least)))


def merged(a: str | Column, b: str | Column) -> Column:
    """The sketch of two documents' shingles together (an extra least hash of either part may remain)."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity; of two empty sketches 1."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x))), ",")


def fingerprints(docs: DataFrame, name: str = "hashes") -> DataFrame:
    """docs with name array<long>, the sketch of text; a null text is empty, its sketch too. Other columns stay: where docs has a
    column of that name already, in any case, the sketch's name is lengthened by underscores until it has none. Texts are whole,
    however long; repeated rows get a sketch each, an empty table stays empty."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    held = docs.withColumn(name, word_hashes(F.coalesce("text", F.lit(""))))
    return held.withColumn(name, sketch(name)).withColumn(name, kept(name))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by descending doc_id (null ids last, ties by text), after the last one
    that of the first. Rows are dealt to ranges of ids of about equal counts; each range also gets the head of the next lower
    one, so that texts are shuffled once and no range needs another's rows."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), 20 * parts)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(marks)))) if marks else F.array().cast("array<long>")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("range", F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(-1)))
    heads = sorted(rows.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("head")).collect(), key=lambda r: r["range"])  # one row for each range
    above = [heads[(i + 1) % len(heads)]["range"] for i in range(len(heads))]
    head = spark.createDataFrame([(r["range"], r["head"]["doc_id"], r["head"]["h"], a) for r, a in zip(heads, above, strict=True)], "range int, head_id long, head_h long, above int")
    rows = rows.join(F.broadcast(head), "range")  # as many rows as ranges
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    here, there = (F.struct(F.col(c).alias("range"), F.lit(x).alias("guest")) for c, x in (("range", False), ("above", True)))
    dealt = rows.select("doc_id", "text", "h", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("h"))
    dealt = dealt.select("doc_id", "text", "h", "at.range", "at.guest")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("doc_id", "text", "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness and the next document's."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - half)"), F.expr("substring(next_text, 1, half)")))
    for name, text in (("own", "text"), ("changed", "edited"), ("following", "next_text")):
        rows = rows.withColumn(name, word_hashes(text))
    for f in (sketch, kept):
        rows = rows.withColumns({name: f(name) for name in ("own", "changed", "following")})
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"), containment("own", "changed").alias("contained_in_edited"),
    )
