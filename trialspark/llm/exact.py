"""Exact de-duplication by a stateful stream: disk-backed keyed state holds, for each digest ever seen, the row that stays, where
its content lies, and how many rows had that digest. Hits are held against the whole bytes at that place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators.prefilter import split_by_ids
from trialspark.shared import new_path, written

#: State lies in RocksDB on the executors' disks, and its changes in the query's folder; nothing in it expires.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves some MB of disk
}
BLANKS = "[ \t\n\x0b\f\r]+"


def normalised(text: Column) -> Column:
    """The text without any blank of U+0020 and U+0009 to U+000D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _place() -> Column:
    """Where a row's content lies: file and row of the file."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _rank() -> Column:
    """Least for the row that stays: most code points, then the smallest id (none is last), then file and row."""
    chars = F.coalesce(F.char_length("text"), F.lit(0))
    return F.struct((-chars).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), _place().alias("place"))


def ingest(spark: SparkSession, path: str, home: str, digest: Callable[[Column], Column] = sha256, batch: int = 1 << 40, files: int | None = None) -> None:
    """Take the Parquet files at path (doc_id, text) that are not yet in the state at home. A later call takes the files that came
    since then; a call that was cut short goes on where it stopped. batch: bytes of input of a micro-batch; files: files of one."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", batch) if files is None else reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(path).select(digest(normalised(F.col("text"))).alias("digest"), _rank().alias("rank"))
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("first"))  # one row of a task for each digest is shuffled
    with _conf(spark, STATE):
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", home).trigger(availableNow=True).start()
    run.awaitTermination()


def seen(spark: SparkSession, home: str) -> DataFrame:
    """digest, n, id, file, row: the state, one row for each digest; id, file and row are of the row that stays."""
    first = F.col("value.min")
    return spark.read.format("statestore").load(home).select("key.digest", F.col("value.count").alias("n"), first["id"].alias("id"), first["place"]["file"].alias("file"), first["place"]["row"].alias("row"))


def _at(file: str, row: str) -> Column:
    return F.concat_ws(" ", row, file)


def decisions(spark: SparkSession, path: str, home: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for each row at path, which ingest has taken into the state at home.

    Rows are equal when their normalised texts are, byte for byte. One row of each group is kept, keep_id is its id. A null text
    is an empty one, and empty and blank texts are one group. Rows that repeat, with an id or without, are rows of their own, of
    which one is kept; a null id stays null and is kept only if no equal text of that length has one. Texts may be as long as a
    row can be. An empty table gives no rows. Other columns are ignored.

    Only rows whose digest came twice are shuffled with their text: each meets the text at the place that the state holds for
    it, in an equi-join whose larger side Spark splits where one digest has very many rows. Rows with the digest but not the
    bytes of the one that stays are grouped again by all their bytes.
    """
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return docs.select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest(F.lit("")).alias("digest"))
    twice, _ = written(seen(spark, home).where("n > 1"), "seen")
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", _rank().alias("rank"), text.alias("text")).withColumn("digest", digest(F.col("text"))).withColumn("at", _at("rank.place.file", "rank.place.row"))
    hits, alone = split_by_ids(rows, "digest", twice.select("digest"))
    at = twice.select(_at("file", "row").alias("at"))
    stays = split_by_ids(rows.select("digest", "at", "text"), "at", at)[0].join(twice.withColumn("first", _at("file", "row")).drop("file", "row"), "digest").where("at = first").select("digest", F.col("text").alias("its"), "first", "n", "id")
    held = hits.join(stays, "digest", "left")  # without a partner: the digest came once, only its place in the bitmap is taken
    equal = F.col("its").isNull() | (F.col("its") == F.col("text"))
    checked, _ = written(held.select("doc_id", "digest", "rank", "id", F.col("n").alias("size"), (F.col("at") == F.coalesce("first", "at")).alias("kept"), equal.alias("equal"), F.when(~equal, F.col("text")).alias("text")), "hits")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    size = F.coalesce("size", F.lit(1)).cast("long")
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    other = checked.where(~F.col("equal"))
    if other.isEmpty():
        return single.union(checked.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), "kept", "digest"))
    fewer = other.groupBy("digest").agg(F.count("*").alias("less"))
    same = checked.where("equal").join(fewer, "digest", "left").select("doc_id", keep.alias("keep_id"), (size - F.coalesce("less", F.lit(0))).alias("group_size"), "kept", "digest")
    groups = other.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.min("rank").alias("best"))
    again = other.join(groups, ["digest", "text"]).select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"), "digest")
    return single.union(same).union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, home = f"{sf_dir}/documents.parque[t]", new_path(spark, "exact")  # a pattern: the stream takes a folder or a file by it
    ingest(spark, path, home)
    return decisions(spark, path, home).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
