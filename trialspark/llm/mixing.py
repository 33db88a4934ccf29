"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

Each source's documents, shuffled by a hash, form a stream of words cut into blocks of equal size. Slot k of the mix stands at
the golden-ratio point frac(k * 0.618...); cumulative target shares, counted in blocks, map it to a source, its rank among that source's
slots to a block of the stream, which is gone through twice at most. A document's words are taken as often as the blocks they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.shared import materialise

# Weights of the sources in order, the share of all words that the mix takes, and the most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: The golden ratio's fraction times 2**40, an odd number: multiples modulo 2**40 are exact at any number of slots.
MODULUS = 1 << 40
GOLDEN = int((5**0.5 - 1) / 2 * MODULUS) | 1
#: Most words of a block, and blocks that a source is cut into if it has as many words; so one slot more or less is little.
BLOCK, BLOCKS = 1024, 1024
#: Cells of the unit interval in which slots meet their source, and rows summed before the next level of a prefix sum.
CELLS, CHUNK = 4096, 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sized: DataFrame) -> DataFrame:
    """sid, source, source_size, target of each source: SHARE of all words by weight, at most PASSES times the source's own, what
    is above given to the others by weight until none is above. Works on one row for each source."""
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    one = one.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1))
    one = one.withColumn("most", PASSES * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    earlier = Window.orderBy("fills_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    before, lighter = F.coalesce(F.sum("most").over(earlier), F.lit(0)), F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = (SHARE * F.sum("source_size").over(everything) - before) / (F.sum("weight").over(everything) - lighter)
    one = one.withColumn("level", level).withColumn("full", F.col("fills_at") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct("fills_at", "sid", "level"))).over(everything)["level"]
    return one.select("sid", "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * rest).cast("double").alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark, size: the words of each row's text; a null text has none. The mark is a hash of the text."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def streams(rows: DataFrame, count: int) -> DataFrame:
    """rows with start: where the row's words begin in its source's shuffled stream. Two levels of sums: no source is one task."""
    rows = rows.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("mark", F.lit(8))).otherwise(F.xxhash64("doc_id", F.lit(8))))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(count // CHUNK + 1)))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(bases, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("h", "bucket", "inside", "base")


def block_words(size: Column) -> Column:
    """Words of each block of a source of that size."""
    return F.greatest(F.least(F.floor(size / BLOCKS), F.lit(BLOCK)), F.lit(1))


def points(slots: DataFrame) -> DataFrame:
    """slots (id) as slot with point: the golden-ratio sequence from one half on, in whole numbers below 2**40."""
    low = 1 << 20
    high = F.pmod(F.floor(F.col("id") / low) * F.lit(GOLDEN * low % MODULUS), F.lit(MODULUS))
    return slots.select(F.col("id").alias("slot"), (F.pmod(high + F.col("id") % low * F.lit(GOLDEN) + MODULUS // 2, F.lit(MODULUS)) / MODULUS).alias("point"))


def schedule(targets: DataFrame) -> DataFrame:
    """slot, sid, rank, block of every slot of the mix, where a source has a share of the slots as of its target in blocks of its
    own; ranks beyond PASSES over a source's blocks are no slots."""
    spark = targets.sparkSession
    whole, up = Window.partitionBy(), Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = targets.where("target > 0").withColumn("words", block_words(F.col("source_size"))).withColumn("wanted", F.col("target") / F.col("words"))
    slots = int(-(-(wanted.agg(F.sum("wanted")).first()[0] or 0.0) // 1))
    shares = wanted.select("sid", "source_size", "words", (F.sum("wanted").over(up) / F.sum("wanted").over(whole)).alias("hi"))
    shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    shares = shares.withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    cells = shares.select("sid", "source_size", "words", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    placed = points(spark.range(slots)).withColumn("cell", F.floor(F.col("point") * CELLS))
    placed = placed.join(cells, "cell").where("point >= lo and point < hi").select("slot", "sid", "source_size", "words")
    placed = placed.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    sums = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    bases = sums.select("sid", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = placed.withColumn("inside", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = placed.join(bases, ["sid", "chunk"]).withColumn("rank", F.col("base") + F.col("inside"))
    blocks = F.ceil(F.col("source_size") / F.col("words"))
    return ranked.where(F.col("rank") < PASSES * blocks).select("slot", "sid", "rank", (F.col("rank") % blocks).alias("block"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """What mix gives, with each row's source and mark."""
    rows = materialise(sized(docs), "sized")
    count = rows.count()
    targets = materialise(source_targets(rows), "targets")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select("doc_id", rows["source"], "mark", "size", "sid", "source_size", "target")
    rows = materialise(streams(rows, count), "streams")
    takes = schedule(targets).groupBy("sid", "block").agg(F.count("*").alias("times"))
    words = block_words(F.col("source_size"))
    first, last = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
    parts = rows.where("size > 0").select("sid", "start", "size", words.alias("words"), F.explode(F.sequence(first, last)).alias("block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("start"), F.col("block") * F.col("words"))
    taken = parts.join(takes, ["sid", "block"]).groupBy("sid", "start").agg(F.sum(inside * F.col("times")).alias("taken"))
    filled = rows.where("size > 0").join(taken, ["sid", "start"], "left").unionByName(rows.where("size = 0"), allowMissingColumns=True)
    return filled.select("doc_id", "source", "mark", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, source, text).

    A null text has size 0 and takes nothing; a null source is a source of its own, the last one; a row with a null doc_id is
    shuffled by its text; rows that repeat are taken one by one. Without any word all targets are 0. An empty table gives an empty
    one. Equal inputs give equal results: the shuffle is a hash of doc_id and the schedule has no random part.
    """
    return mix_rows(docs).drop("source", "mark")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them: the nearest whole number of times, so not, once or twice.

    Each row has its own count, also where doc_id is null or stands for several texts or sources; rows that share doc_id, source
    and text share out the counts of these rows among them.
    """
    key = ["doc_id", "source", "mark"]
    times = mix_rows(docs).where("size > 0").withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5))
    least = [F.count_if(F.col("times") >= k).alias(f"_{k}") for k in range(1, PASSES + 1)]
    groups = materialise(times.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.count("*").alias("_n"), *least).where("_1 > 0"), "times")
    # Columns of docs are renamed for the while, so that no name of theirs meets one of these.
    held = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    mine = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = held.withColumn("_m", F.xxhash64(mine["text"]))
    at = [F.col(mine["doc_id"]), F.col(mine["source"]), F.col("_m")]
    same = at[0].eqNullSafe(F.col("_doc_id")) & at[1].eqNullSafe(F.col("_source")) & (at[2] == F.col("_mark"))
    single = marked.join(groups.where("_n = 1"), same).withColumn("_rank", F.lit(1))
    several = marked.join(groups.where("_n > 1"), same).withColumn("_rank", F.row_number().over(Window.partitionBy(*at).orderBy("_m")))
    all_rows = single.unionByName(several)
    count = sum((F.col("_rank") <= F.col(f"_{k}")).cast("int") for k in range(1, PASSES + 1))
    taken = all_rows.withColumn("_times", count).where("_times > 0").select(*held.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("_i"))
    return taken.drop("_i").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
