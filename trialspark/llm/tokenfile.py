"""Token ids as flat files: unsigned integers plus 64-bit document offsets, memory-mapped when read.

A set is a folder in a store that all executors reach: part-N-<attempt>.bin holds the ids of the documents of range N one
after another as little-endian unsigned integers of the smallest fitting width, part-N-<attempt>.idx holds, for each document, three
64-bit integers: whether it has a doc_id, the doc_id, and its end offset. Ranges ascend by doc_id, without one last; a part's base, the number of ids in all parts before it, is a prefix
sum over the parts. manifest.json names the parts that count, so that files of failed or repeated attempts do no harm.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialspark.llm.bpe import open_store, tokenizer
from trialspark.llm.textnum import text_batches
from trialspark.shared import new_path

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Bytes of text in a part, and the least that a part is made of to use all tasks.
PART_BYTES, SMALL_PART = 512 << 20, 8 << 20
#: Distinct words whose ids a worker remembers before it begins a new memory; of the last one, words that come again are kept.
REMEMBERED = 600_000
#: Words that are encoded as one text.
GROUP = 1000
_MARKS = b".,;:!?#$%&*"
_memory: dict[tuple[str, str], tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
_lasts: dict[int, tuple[Tokenizer, np.ndarray]] = {}


def _last_pieces(t: Tokenizer) -> np.ndarray:
    """For each id whether it ends a piece; none for a vocabulary that does not mark that."""
    if id(t) not in _lasts:
        mark = getattr(t.model, "end_of_word_suffix", None)
        vocabulary = t.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        ends[[i for x, i in vocabulary.items() if mark and x.endswith(mark)]] = True
        _lasts[id(t)] = t, ends  # held, so that no other gets its id
    return _lasts[id(t)][1]


def _encode_letters(t: Tokenizer, words: list[bytes], dtype: str) -> dict[bytes, bytes]:
    """The ids of those words that are letters only, many at once: each is one piece, whose last id says so. A word has a piece at least, so as
    many ends as words are one for each; groups with more (letters that are none once they are lower-cased) are left out."""
    ends, width, out = _last_pieces(t), np.dtype(dtype).itemsize, {}
    if not ends.any() or any(x.content[:1].isalpha() or x.content[-1:].isalpha() for x in t.get_added_tokens_decoder().values()):
        return out
    letters = [w for w in words if w.decode("utf-8").isalpha()]
    groups = [letters[i : i + GROUP] for i in range(0, len(letters), GROUP)]
    for group, x in zip(groups, t.encode_batch_fast([b" ".join(g).decode("utf-8") for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(x.ids, dtype)
        last = np.flatnonzero(ends[ids])
        if len(last) == len(group) and last[-1] == len(ids) - 1:
            data, cuts = ids.tobytes(), ((last + 1) * width).tolist()
            out.update(zip(group, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
    return out


def _encode_words(t: Tokenizer, words: list[bytes], dtype: str) -> list[bytes]:
    """The ids of each word. Those of letters only go first. The others are encoded many at once, held apart by an added token: these are taken
    out of a text before all else. Words that may hold part of one are encoded alone, as all are if there is no such token."""
    apart = next(((i, x.content) for i, x in t.get_added_tokens_decoder().items() if x.special and not (x.normalized or x.single_word or x.lstrip or x.rstrip)), None)
    if apart is None:
        return [np.array(x.ids, dtype).tobytes() for x in t.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
    mark, between = apart
    signs = {x.content[0].encode() for x in t.get_added_tokens_decoder().values()} | {x.content[-1].encode() for x in t.get_added_tokens_decoder().values()}
    out = _encode_letters(t, words, dtype)
    others = [w for w in words if w not in out]
    alone = {w for w in others if any(x in w for x in signs)}
    out |= {w: np.array(t.encode(w.decode("utf-8"), add_special_tokens=False).ids, dtype).tobytes() for w in alone}
    rest = [w for w in others if w not in alone]
    groups = [rest[i : i + GROUP] for i in range(0, len(rest), GROUP)]
    width = np.dtype(dtype).itemsize
    for group, x in zip(groups, t.encode_batch_fast([b" ".join(g).decode("utf-8").replace(" ", between) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(x.ids, dtype)
        data, cuts = ids.tobytes(), (np.flatnonzero(ids == mark) * width).tolist()
        out.update(zip(group, [data[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(data)], strict=True)], strict=True))
    return [out[w] for w in words]


def encode(texts: list[bytes], path: str, dtype: str) -> list[bytes]:
    """The ids of each text as integers of dtype. This vocabulary lower-cases, drops white space and merges inside words only, so
    a text's ids are those of its words, and those of a word followed by punctuation marks are the word's and the marks'. A
    text that may hold an added token is encoded as a whole."""
    t = tokenizer(path)
    known, before = _memory.setdefault((path, dtype), ({}, {}))
    if len(known) > REMEMBERED:
        known, before = _memory[path, dtype] = ({}, known)
    added = [x.content[:2].encode() for x in t.get_added_tokens_decoder().values()]
    words = [x.lower().split() for x in texts]
    parts = []
    fresh = set().union(*words).difference(known)
    known.update((w, before[w]) for w in fresh.intersection(before))
    for w in fresh.difference(known):
        stem = w.rstrip(_MARKS)
        # after an ASCII letter or digit the marks begin a new piece
        parts.append((w, stem, w[len(stem) :]) if len(stem) < len(w) and stem[-1:].isalnum() else (w, w, b""))
    new = list({x for _, stem, marks in parts for x in (stem, marks)}.difference(known))
    known.update(zip(new, _encode_words(t, new, dtype), strict=True))
    known.update((w, known[stem] + known[marks]) for w, stem, marks in parts if marks)
    out = []
    for text, own in zip(texts, words, strict=True):
        if any(x in text for x in added):
            out.append(np.array(t.encode(text.decode("utf-8"), add_special_tokens=False).ids, dtype).tobytes())
        else:
            out.append(b"".join(map(known.__getitem__, own)))
    return out


def _writer(uri: str, path: str, dtype: str, end: int):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, folder = open_store(uri)
        tail = np.array([end], dtype).tobytes()
        width, n, at = np.dtype(dtype).itemsize, 0, 0
        with store.open_output_stream(f"{folder}/{name}.bin") as data, store.open_output_stream(f"{folder}/{name}.idx") as index:
            for part, texts in text_batches(batches):
                encoded = encode(texts, path, dtype)
                data.write(tail.join(encoded) + tail)
                doc_id = part.column("doc_id").cast(pa.int64())
                ends = at + np.cumsum([len(x) // width + 1 for x in encoded])
                index.write(np.column_stack((doc_id.is_valid().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(), ends)).astype("<i8").tobytes())
                n, at = n + len(texts), int(ends[-1])
        if n:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [n], "ids": [at]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return rows


def write_tokens(docs: DataFrame, uri: str, path: str, end: int = END, parts: int | None = None) -> dict:
    """Encode docs (doc_id, text) in ascending doc_id order into a set of files at uri; returns its manifest.

    A null or empty text is the end id alone. Rows without a doc_id come last. Rows that repeat a doc_id are written one after
    another, in the order of their texts. Other columns are ignored; an empty table gives a set without parts. Without a number of
    parts there is one for PART_BYTES of text, but as many as shuffle partitions where each then still has SMALL_PART. The driver sees one row for each part, never ids.
    """
    spark = docs.sparkSession
    dtype = "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SMALL_PART))
    order = F.col("doc_id").asc_nulls_last()
    ordered = rows.repartitionByRange(parts, order).sortWithinPartitions(order, "text")
    store, folder = open_store(uri)
    store.create_dir(folder, recursive=True)
    found = sorted(ordered.mapInArrow(_writer(uri, path, dtype, end), "part int, name string, docs long, ids long").collect(), key=lambda r: r["part"])
    base, listed = 0, []
    for r in found:
        listed.append({"name": r["name"], "docs": r["docs"], "ids": r["ids"], "base": base})
        base += r["ids"]
    manifest = {"dtype": dtype, "end": end, "ids": base, "parts": listed}
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(uri: str, name: str, dtype: str) -> np.ndarray:
    """A file's integers: mapped into memory where the store is a local or mounted folder, else read."""
    store, folder = open_store(uri)
    at = f"{folder}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.zeros(0, dtype)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the set at uri, one task for each part; ids are little-endian unsigned 32-bit."""
    store, folder = open_store(uri)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.load(io.BytesIO(f.read()))
    dtype = manifest["dtype"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, index = _mapped(uri, f"{name}.bin", dtype), _mapped(uri, f"{name}.idx", "<i8").reshape(-1, 3)
                begin = np.concatenate(([0], index[:-1, 2]))
                for i in range(0, len(index), 1000):
                    block = index[i : i + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[:, 1], mask=block[:, 0] == 0), pa.array(base + begin[i : i + 1000]), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(begin[i : i + 1000], block[:, 2], strict=True)], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    parts = [(p["name"], p["base"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "name string, base long").repartition(max(1, len(parts)), "name")
    return listed.mapInArrow(rows, "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    uri = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri, path or public_tokenizers.path(VOCABULARY))
    return read_tokens(spark, uri).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def checksum(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
