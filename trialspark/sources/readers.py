"""Readers and writers: JSON lines, record folders, task bundles, archives, digests, write-once and resumable sinks."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

#: Most bytes of a text file that is read.
TEXT_LIMIT = 400_000


def json_lines(spark: SparkSession, path: str, schema: ty.StructType | str) -> DataFrame:
    """Frozen records: a line that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def record_folder(spark: SparkSession, path: str, schema: ty.StructType | str) -> DataFrame:
    """One JSON record for each file, with key, the file's stem."""
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    return r.withColumn("key", F.regexp_extract("_metadata.file_path", "([^/]+)\\.json$", 1))


def columns(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Only these columns are read from the Parquet files."""
    return spark.read.parquet(path).select(*names)


def text_files(spark: SparkSession, root: str, limit: int = TEXT_LIMIT) -> DataFrame:
    """path, text of files under root that are valid UTF-8 and shorter than limit; the size filter is pushed to the listing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") < limit)
    text = f.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return text.where(F.col("text").isNotNull())


def task_bundles(spark: SparkSession, root: str) -> DataFrame:
    """task_id, instruction, test_files of folders that hold instruction.md and tests/."""
    f = text_files(spark, root)
    parts = f.select(F.regexp_extract("path", "/([^/]+)/(instruction\\.md|tests/[^/]+)$", 1).alias("task_id"), F.regexp_extract("path", "/(instruction\\.md|tests/[^/]+)$", 1).alias("file"), "text").where("task_id <> ''")
    t = parts.groupBy("task_id").agg(F.max(F.when(F.col("file") == "instruction.md", F.regexp_replace("text", "^\\s+|\\s+$", ""))).alias("instruction"), F.count_if(F.col("file").startswith("tests/")).alias("test_files"))
    return t.where(F.col("instruction").isNotNull() & (F.col("test_files") > 0))


def overridden(versions: list[DataFrame], key: str, seq: str) -> DataFrame:
    """Later files and later lines (seq) win for each key."""
    ranked = None
    for i, v in enumerate(versions):
        v = v.withColumn("_file", F.lit(i))
        ranked = v if ranked is None else ranked.unionByName(v)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_file"), F.desc(seq)))
    return ranked.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_file")


def exclusive(versions: list[DataFrame], key: str) -> DataFrame:
    """The union; a key that stands in two of them is an error when the rows are read."""
    both = None
    for i, v in enumerate(versions):
        v = v.withColumn("_file", F.lit(i))
        both = v if both is None else both.unionByName(v)
    files = both.groupBy(key).agg((F.max("_file") != F.min("_file")).alias("_twice"))
    checked = both.join(files, key).withColumn("_twice", F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("key in two files: "), F.col(key).cast("string")))).otherwise(F.lit(False)))
    return checked.where(~F.col("_twice").cast("boolean")).drop("_file", "_twice")


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def refuse_other_identity(done: DataFrame, identity: dict[str, str]) -> None:
    """Raises if any stored identity differs from the current one; null counts as a difference."""
    now = F.struct(*(F.lit(v).alias(k) for k, v in identity.items()))
    stored = F.struct(*(F.col(f"identity.{k}").alias(k) for k in identity))
    if done.where(~stored.eqNullSafe(now)).limit(1).take(1):
        raise ValueError("stored rows come from another run identity")


def write_once(df: DataFrame, path: str) -> None:
    """An existing target is an error. The commit protocol publishes all files at once."""
    df.write.mode("errorifexists").parquet(path)


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, path: str) -> str:
    """Put df as the newest version of the JSON lines at path, and return that version's folder.

    A version is written once, under versions/; then a small pointer file of its name is put under current/ by a single rename.
    published() takes the last pointer, so at every moment readers find a whole version, the one before or this one; when it
    fails before the rename, the one before stays. Versions are numbered by their names; of two that are published at the same
    time both stay, and the larger name counts. Old versions stay until retire().
    """
    spark = df.sparkSession
    newest = _pointers(spark, path)[-1:]
    name = f"{int(newest[0].split('-')[0]) + 1 if newest else 0:012d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").json(f"{path}/versions/{name}")
    _point(spark, path, name)
    return f"{path}/versions/{name}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    store, fresh = _folder(spark, f"{path}/waiting/{name}")
    _, pointer = _folder(spark, f"{path}/current/{name}")
    store.create(fresh, False).close()
    store.mkdirs(pointer.getParent())
    if not store.rename(fresh, pointer):
        raise OSError(f"could not publish {path}")


def _pointers(spark: SparkSession, path: str) -> list[str]:
    store, at = _folder(spark, f"{path}/current")
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def published(spark: SparkSession, path: str) -> str:
    """The folder of the newest version at path; it does not change, so a reader may read it as often as it likes."""
    names = _pointers(spark, path)
    if not names:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{path}/versions/{names[-1]}"


def retire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all versions but the newest ones, pointers first; for when no reader has an older one any more."""
    for name in _pointers(spark, path)[: -max(keep, 1)]:
        for part in ("current", "versions"):
            store, at = _folder(spark, f"{path}/{part}/{name}")
            store.delete(at, True)


def _put(uri: str, content: bytes) -> None:
    """Write one file in a store that all executors reach."""
    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(content)


def write_bundles(tasks: DataFrame, root: str) -> DataFrame:
    """One folder for each row of tasks (task_id, instruction, test): instruction.md and, if test is not null, tests/test_state.py.
    Returns the task_ids written; a folder that exists is written over."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _put(f"{root}/{r.task_id}/instruction.md", (r.instruction or "").encode())
                if r.test is not None:
                    _put(f"{root}/{r.task_id}/tests/test_state.py", r.test.encode())
            yield pdf[["task_id"]]

    return tasks.select("task_id", "instruction", "test").mapInPandas(rows, "task_id string")


def write_archives(files: DataFrame, archive: str, root: str) -> DataFrame:
    """One zip archive root/<archive>.zip for each value of archive, with the files (member, text) of its rows; returns archive, members.
    An archive is written by one task, so it must fit into its memory."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        name, buf = pdf[archive].iloc[0], io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in sorted(zip(pdf["member"], pdf["text"], strict=True)):
                z.writestr(member, text or "")
        _put(f"{root}/{name}.zip", buf.getvalue())
        return pd.DataFrame({"archive": [str(name)], "members": [len(pdf)]})

    return files.groupBy(archive).applyInPandas(rows, "archive string, members long")


def row_digests(df: DataFrame) -> DataFrame:
    """n, digest: rows and an order-free digest of them: the sum of 60-bit hash prefixes, so that repeated rows count."""
    h = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns)))), 256)
    return df.select(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)").alias("x")).agg(F.count("*").alias("n"), F.sum("x").alias("digest"))


def tree_digest(files: DataFrame, tree: str, path: str, content: str) -> DataFrame:
    """tree, digest: of all files of a tree, ordered by path, their path and content digests; 16 characters. For trees whose list of
    files fits into a task (test folders); see large_tree_digest."""
    leaves = files.select(tree, F.struct(F.col(path).alias("p"), F.sha2(content, 256).alias("h")).alias("leaf"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("leaf")), lambda x: F.concat(x["p"], F.lit(":"), x["h"])), "\n")
    return leaves.groupBy(tree).agg(F.substring(F.sha2(joined, 256), 1, 16).alias("digest"))


def large_tree_digest(files: DataFrame, tree: str, path: str, content: str, digits: int = 4) -> DataFrame:
    """tree, digest as tree_digest of a tree of any size, on two levels: leaves are dealt to 16**digits folders by the hash of their
    path, a folder's digest is that of its leaves in order, the tree's that of its folders' in order."""
    named = files.select(tree, F.substring(F.sha2(F.col(path), 256), 1, digits).alias("_part"), F.struct(F.col(path).alias("p"), F.sha2(content, 256).alias("h")).alias("leaf"))
    lines = lambda leaves: F.array_join(F.transform(F.array_sort(F.collect_list(leaves)), lambda x: F.concat(x["p"], F.lit(":"), x["h"])), "\n")
    parts = named.groupBy(tree, "_part").agg(F.sha2(lines("leaf"), 256).alias("h")).select(tree, F.struct(F.col("_part").alias("p"), "h").alias("leaf"))
    return parts.groupBy(tree).agg(F.substring(F.sha2(lines("leaf"), 256), 1, 16).alias("digest"))


def drift(recorded: DataFrame, files: DataFrame, path: str, content: str) -> DataFrame:
    """path, state (missing, changed) of files that are not what was recorded (path, digest)."""
    j = recorded.join(files.select(path, F.sha2(content, 256).alias("now")), path, "left")
    return j.select(path, F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("digest"), "changed").alias("state")).where("state is not null")


def public_export(df: DataFrame, names: dict[str, str], prefix: str, reasons: dict[str, str], nested: str) -> DataFrame:
    """Columns renamed, the private prefix taken from keys, reason codes mapped, everything beside the key in one JSON column."""
    codes = F.create_map(*(F.lit(x) for kv in reasons.items() for x in kv))
    out = df.select(*(F.col(old).alias(new) for old, new in names.items())).withColumn("key", F.regexp_replace("key", f"^{prefix}", "")).withColumn("reason", F.try_element_at(codes, F.col("reason")))
    return out.select("key", F.to_json(F.struct(*(c for c in out.columns if c != "key"))).alias(nested))
