"""BPE encoding and decoding through a table of distinct words, each encoded once.

Texts are split into the words on which the merges work, and written as word numbers of their block (about BLOCK_BYTES of
text). A block's distinct words are dealt to buckets by hash, packed; each bucket of the table encodes every word once, whatever
number of blocks it came from, and writes the ids for each block to the shared folder. A task that lays out texts reads the
packs of their block from there, so that texts are never shuffled: it places the ids by position, and decodes by looking up
every id in the id-to-piece table, which is as long as the vocabulary file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.textnum import text_batches
from trialspark.shared import materialise, new_path

BLOCK_BYTES = 32_000_000
#: Buckets of the table of distinct words for each shuffle partition.
BUCKETS = 2
VOCABULARY = "byte_bpe_50k.json"
#: Beyond this letter the splitting library and the tokenizer know different versions of Unicode.
AGREED_END = 0x558
AGREED = re.compile(f"[^\\u0000-{chr(AGREED_END - 1)}]")


def _letters(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(AGREED_END) if regex.match(kind, chr(c)))


#: public_tokenizers.PATTERN for letters below AGREED_END, with its classes written out: the plain library is the faster one.
_L, _N, _S = map(_letters, ("\\p{L}", "\\p{N}", "\\s"))
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> np.ndarray:
    """The bytes of every id, by id; as many as the vocabulary file has."""
    letters = byte_letters()
    known = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.full(max(known.values()) + 1, b"", object)
    for piece, i in known.items():
        out[i] = bytes(letters[c] for c in piece)
    return out


def split(text: str, path: str) -> list[str]:
    """The words that are encoded apart from each other; added tokens in the text are words of their own."""
    t = tokenizer(path)
    parts = [text]
    for token in t.get_added_tokens_decoder().values():
        parts = [x for part in parts for x in regex.split(f"({regex.escape(token.content)})", part)] if token.content in text else parts
    words = []
    for part in parts:
        if AGREED.search(part):
            words += [part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)]
        elif len(parts) > 1 and t.token_to_id(part) in t.get_added_tokens_decoder():
            words.append(part)
        else:
            words += WORDS.findall(part)
    return words


CODED = "block long, doc_id long, codes binary, bucket int, words binary"


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _coded(path: str, buckets: int):  # noqa: ANN202
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary())])

    def block_rows(doc_ids: list[pa.Array], codes: list[np.ndarray], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
        block = int.from_bytes(os.urandom(8), "little", signed=True)
        words = list(number)
        # The commonest words get the smallest numbers, so that the bytes of a text's numbers, plane by plane, pack well.
        common = np.argsort(-np.bincount(np.concatenate(codes), minlength=len(words)), kind="stable")
        final = np.empty(len(words), np.uint32)
        final[common] = np.arange(len(words), dtype=np.uint32)
        for i in range(0, len(codes), 1000):
            packed = [zlib.compress(_planes(final[c]), 1) for c in codes[i : i + 1000]]
            n = len(packed)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(doc_ids[i : i + 1000], pa.int64()), pa.array(packed, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        dealt = defaultdict(list)
        for at, i in enumerate(common.tolist()):
            dealt[zlib.crc32(words[i].encode()) % buckets].append((at, words[i]))
        packs = [zlib.compress(json.dumps([np.diff([at for at, _ in own], prepend=0).tolist(), [w for _, w in own]]).encode(), 6) for own in dealt.values()]
        n = len(packs)
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(list(dealt), pa.int32()), pa.array(packs, pa.binary())], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> defaultdict:
            d: defaultdict = defaultdict()
            d.default_factory = d.__len__
            return d

        doc_ids, codes, number, size = [], [], fresh(), 0
        for part, texts in text_batches(batches):
            doc_ids += part.column("doc_id").to_pylist()
            for text in texts:
                words = split(text.decode("utf-8"), path)
                codes.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                size += len(text)
            if size >= BLOCK_BYTES:
                yield from block_rows(doc_ids, codes, number)
                doc_ids, codes, number, size = [], [], fresh(), 0
        if codes:
            yield from block_rows(doc_ids, codes, number)

    return rows


#: Words whose ids a task keeps at most; beyond, it forgets them and encodes those that come again once more.
KNOWN = 1 << 21


def _bucket_encoder(path: str, most: int = KNOWN):  # noqa: ANN202
    def encoded(packs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each distinct word of one bucket is encoded once; its ids go to every block that has it. The bucket comes in batches of
        blocks, so that a task holds one batch and the known words, however many blocks there are."""
        t, known = tokenizer(path), {}
        for batch in packs:
            out = []
            for pack in batch["words"]:
                steps, words = json.loads(zlib.decompress(pack))
                if len(known) > most:
                    known.clear()
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(x.ids, np.uint32) for x in t.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                ids = [known[w] for w in words]
                length = np.fromiter(map(len, ids), np.uint32, len(ids))
                out.append(zlib.compress(_planes(np.concatenate(([len(ids)], steps, length, *ids))), 1))
            yield pd.DataFrame({"of_block": batch["block"], "bucket": batch["bucket"], "ids": out})

    return encoded


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder as Spark names it; s3a is s3 here. A scheme that only Spark knows is an error."""
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _layout(path: str, packs: str):  # noqa: ANN202
    """Ids by position and decoded text of each row, with the packs of its block, which stand in a folder of the table at packs."""

    def block_ids(block: int) -> tuple[np.ndarray, ...]:
        """Of each word number of the block: how many ids, where they begin; and all ids."""
        store, folder = open_store(packs)
        table = dataset.dataset(f"{folder}/of_block={block}", filesystem=store, format="parquet").to_table(columns=["ids"])
        numbers, lengths, flats = ([np.zeros(0, np.uint32)] for _ in range(3))
        for pack in table.column("ids").to_pylist():
            a = _from_planes(zlib.decompress(pack))
            n = a[0]
            numbers.append(np.cumsum(a[1 : 1 + n]))
            lengths.append(a[1 + n : 1 + 2 * n])
            flats.append(a[1 + 2 * n :])
        number, packed = np.concatenate(numbers).astype(np.int64), np.concatenate(lengths).astype(np.int64)
        length, begin = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        length[number], begin[number] = packed, np.cumsum(packed) - packed
        return length, begin, np.concatenate(flats).astype(np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, at = pieces(path), None
        for batch in batches:
            blocks, ids, texts, size, first = batch.column("block").to_pylist(), [], [], 0, 0
            for i, codes in enumerate(batch.column("codes")):
                if blocks[i] != at:
                    at = blocks[i]
                    length, begin, flat = block_ids(at)
                c = _from_planes(zlib.decompress(codes.as_py()))
                n = length[c]
                own = flat[np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                ids.append(own)
                texts.append(b"".join(piece[own]).decode("utf-8", "replace"))
                size += len(own)
                if size >= 500_000 or i + 1 == len(blocks):
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first : i + 1], lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                    ids, texts, size, first = [], [], 0, i + 1

    return rows


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for each row of docs (doc_id, text), as the tokenizer file at path has them.

    A null or empty text has no ids and decodes to an empty string; a null doc_id stays null; repeated rows are encoded one
    by one; other columns are ignored; an empty table gives an empty one. path must be readable on every executor.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = materialise(docs.select("doc_id", "text").mapInArrow(_coded(path, buckets), CODED), "coded")
    packs = coded.where("words is not null").select("block", "bucket", "words")
    encoded = packs.groupBy("bucket").applyInPandas(_bucket_encoder(path), "of_block long, bucket int, ids binary")
    place = new_path(docs.sparkSession, "packs")
    encoded.repartition("of_block").write.partitionBy("of_block").parquet(place)
    return coded.where("codes is not null").select("block", "doc_id", "codes").mapInArrow(_layout(path, place), "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)
    done = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
