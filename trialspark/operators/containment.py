"""Literals anywhere in texts: an index of locally least byte grams gives candidates, contains() decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.prefilter import split_by_ids
from trialspark.shared import materialise

#: Bytes of a gram, and neighbouring grams of which the least is an index key: every literal of GRAM + WINDOW - 1 bytes has one.
GRAM, WINDOW = 8, 24
#: Bits of the bitmap of wanted keys (2 MB, whatever the number of literals), and bytes of text that are looked at at once.
BITS, BYTES = 1 << 24, 4_000_000
U = np.uint64
KEYS = "id long, size int, key long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit: grams are ordered by it, so that no letter is preferred."""
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    x = (x ^ (x >> U(28))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def grams(buf: np.ndarray, size: int) -> np.ndarray:
    """Values of all windows of size bytes: the bytes themselves, mixed; equal values are equal bytes."""
    out = np.zeros(max(0, len(buf) - size + 1), U)
    for k in range(size):
        out |= buf[k : k + len(out)].astype(U) << U(8 * k)
    return mixed(out)


def least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each window of so many neighbours, by doubling."""
    have = 1
    while have < window:
        step = min(have, window - have)
        values, have = np.minimum(values[: len(values) - step], values[step:]), have + step
    return values


def kinds(size: int) -> tuple[int, int]:
    """(bytes of a gram, window) of the index that a literal of so many bytes is in: windows for long ones, all grams for others,
    and grams of its own length for those shorter than a gram."""
    return (GRAM, WINDOW) if size >= GRAM + WINDOW - 1 else (GRAM, 1) if size >= GRAM else (size, 1)


def keys_of(text: bytes, gram: int, window: int) -> np.ndarray:
    values = grams(np.frombuffer(text, np.uint8), gram)
    return np.unique(least(values, window)) if len(values) >= window else values[:0]


def _literal_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, *kinds(len(t)), t) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        keys = [keys_of(t, gram, window) for _, gram, window, t in found]
        n = [len(k) for k in keys]
        sizes = np.array([gram * 64 + window for _, gram, window, _ in found], np.int32)
        yield _keys(np.repeat([i for i, *_ in found], n), np.repeat(sizes, n), keys)


def _keys(ids: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    key = np.concatenate(keys) if keys else np.zeros(0, U)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(key.view(np.int64))], ["id", "size", "key"])


def _text_keys(wanted: bytes, sizes: list[int]):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            ids, of, keys = [], [], []
            held = 0
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for size in sizes:
                    parts = []
                    for first in range(0, len(text), BYTES):  # pieces overlap, so that no window is lost
                        v = keys_of(text[first : first + BYTES + 64], *divmod(size, 64))
                        at = v % U(BITS)
                        parts.append(v[(bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1])
                    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U)
                    ids.append(np.full(len(found), i))
                    of.append(np.full(len(found), size))
                    keys.append(found)
                    held += len(found)
                if held > 100_000:
                    yield _keys(np.concatenate(ids), np.concatenate(of), keys)
                    ids, of, keys, held = [], [], [], 0
            if ids:
                yield _keys(np.concatenate(ids), np.concatenate(of), keys)

    return rows


def _bitmap(keys: DataFrame) -> bytes:
    """The keys as a bitmap of BITS bits on the driver, made of one row for each 32,768 bits."""
    at = F.col("key").bitwiseAND(BITS - 1)
    rows = keys.select(F.floor(at / 32768).alias("bucket"), (at % 32768).alias("bit")).distinct().groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["bits"]
    return bytes(out)


def index_rows(texts: DataFrame, literals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, wanted): id, size, key of texts (id, text) whose key some literal (id, text) has, and those of the literals."""
    wanted = materialise(literals.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_literal_keys, KEYS), "keys")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # GRAM + 1 kinds at most
    hits = texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_text_keys(_bitmap(wanted.select("key")), sizes), KEYS)
    return hits.join(wanted.select("size", "key").distinct(), ["size", "key"], "left_semi"), wanted


def containing(texts: DataFrame, key: str, text: str, literals: DataFrame, literal: str) -> DataFrame:
    """(key, literal) for each row of texts and each distinct literal that lies anywhere in its text, exact.

    Index keys are grams of 8 bytes. Of a literal of 31 bytes or more, and of a text, only the least of each 24 neighbouring grams is
    one: a text that holds the literal has all its windows, so all its keys, and two in 25 places are keys at most. Shorter literals
    are sought by all grams, and those of less than 8 bytes by grams of their own length. A text gives only keys that a bitmap of the
    literals' keys lets through, each once. The key of a literal that is rarest in the texts gives its candidates, contains() decides.
    Null texts hold nothing; null keys are kept; empty literals are left out; texts that are equal are sought once.
    """
    t = texts.select(F.col(key), F.col(text).alias("_text")).where("_text is not null").withColumn("_h", F.xxhash64("_text"))
    wanted = materialise(literals.select(F.col(literal).alias("_literal")).where("_literal <> ''").distinct().withColumn("_id", F.monotonically_increasing_id()), "literals")
    hits, keys = index_rows(t.select(F.col("_h").alias("id"), F.col("_text").alias("text")), wanted.select(F.col("_id").alias("id"), F.col("_literal").alias("text")))
    hits = materialise(hits.distinct(), "hits")
    counts = hits.groupBy("size", "key").agg(F.count("*").alias("n"))
    rare = keys.join(counts, ["size", "key"], "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "key")).alias("best")).where("best.n > 0")
    rare = rare.select(F.col("id").alias("_id"), "best.size", "best.key")
    candidates = materialise(hits.withColumnRenamed("id", "_h").join(rare, ["size", "key"]).join(wanted, "_id").select("_h", "_literal"), "candidates")
    maybe, _ = split_by_ids(t, "_h", candidates.select("_h"))
    return maybe.join(candidates, "_h").where(F.col("_text").contains(F.col("_literal"))).select(key, F.col("_literal").alias(literal))
