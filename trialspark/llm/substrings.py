"""Exact repeated substrings: every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

A suffix array by difference cover sorts a sample of all suffixes, names them, and places the other suffixes by the next
sampled one. The cover only has to make sure that equal strings are sampled at equal places. Here it is chosen by content: in
each window of LENGTH bytes the sampled position is the one whose GRAM-byte string has the least hash, so equal windows sample
equally wherever they stand, and about one position in a hundred is sampled. Sampled strings are named by their hashes; the
starts that share a sampled position form a run, named by the hash of all bytes that its windows cover (the triple of what
lies before, at and after the sampled position). Names that occur once cannot belong to a repeated string. Starts of runs
whose name occurs again are settled together; at the ends of a match the remaining starts are merged one by one by the name
of their LENGTH bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.textnum import Hashes, mix, text_batches
from trialspark.operators.prefilter import split_by_ids
from trialspark.shared import materialise

LENGTH, GRAM = 400, 128
WINDOW = LENGTH - GRAM + 1
#: Bits that hold a position while the least hash is looked for; longer texts are gone through in segments.
PLACE_BITS = 24
SEGMENT = 1 << 23
#: Starts of a group, when runs are taken apart.
GROUP = 8
RUNS = "doc_id long, mark long, start long, length int, lead int, sampled long, name long, name2 long"


def least_of_windows(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every stretch of width values."""
    m, have = v, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - have :]) if have < width else m


def _names(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of data[first:end] as rows of two integers: bytes decide, so unequal strings do not share a name."""
    digests = b"".join(blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def runs_of(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts in a buffer of texts that end at ends: text number, first start, number of starts, how far ahead the
    sampled position is, names of the sampled string (64 bits, a filter alone) and of the run (128 bits)."""
    hashes = Hashes(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    sampled = (least_of_windows((gram & ~low) | at.astype(np.uint64), WINDOW) & low).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - begins)[: len(sampled)]
    valid = np.flatnonzero(np.arange(len(sampled)) + LENGTH <= ends[text])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
    fresh = np.concatenate(([True], (np.diff(valid) != 1) | (np.diff(sampled[valid]) != 0) | (np.diff(text[valid]) != 0)))
    first = valid[fresh]
    last = valid[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(valid) - 1]))]
    return text[first], first - begins[text[first]], last - first + 1, sampled[first] - first, gram[sampled[first]], _names(buf.tobytes(), first, last + LENGTH)


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts of one batch; one that is longer than SEGMENT in overlapping segments: numbers, offsets, bytes."""
    if len(texts) == 1 and len(texts[0]) > SEGMENT:
        for i in range(0, len(texts[0]) - LENGTH + 1, SEGMENT):
            yield [0], [i], [texts[0][i : i + SEGMENT + LENGTH - 1]]
    else:
        yield list(range(len(texts))), [0] * len(texts), texts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_batches(batches):
        doc_id, mark = part.column("doc_id").cast(pa.int64()), part.column("mark")
        for number, offset, pieces in _segments(texts):
            buf = np.frombuffer(b"".join(pieces), np.uint8)
            if len(buf) < LENGTH:
                continue
            text, start, length, lead, sampled, name = runs_of(buf, np.cumsum([len(x) for x in pieces]))
            text, offset = np.array(number)[text], np.array(offset)[text]
            yield pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(text)), mark.take(pa.array(text)), pa.array(start + offset), pa.array(length.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(sampled.view(np.int64)), pa.array(name[:, 0]), pa.array(name[:, 1])],
                [x.split()[0] for x in RUNS.split(", ")],
            )


def _parts(group: int):  # noqa: ANN202
    """Rows of RUNS for the listed runs of each text, taken apart into groups of starts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            for i, runs in enumerate(part.column("runs").to_pylist()):
                hashes = Hashes(np.frombuffer(texts[i], np.uint8))
                start = np.concatenate([np.arange(r["start"], r["start"] + r["length"]) for r in runs])
                sampled_at = np.repeat([r["start"] + r["lead"] for r in runs], [r["length"] for r in runs])
                run = np.repeat(np.arange(len(runs)), [r["length"] for r in runs])
                number = (start - sampled_at) // group  # counted from the sampled position, so alike in equal windows
                fresh = np.flatnonzero(np.concatenate(([True], (np.diff(number) != 0) | (np.diff(run) != 0))))
                first = start[fresh]
                length = np.diff(np.concatenate((fresh, [len(start)])))
                core = sampled_at[fresh] + number[fresh] * group  # the bytes that the windows of a whole group have in common
                names = hashes.of(core + group - 1, core + LENGTH) + number[fresh].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                exact = _names(texts[i], first, first + length + LENGTH - 1)
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("doc_id")[i].as_py()] * n, pa.int64()), pa.array(np.full(n, part.column("mark")[i].as_py())), pa.array(first), pa.array(length.astype(np.int32)),
                        pa.array((sampled_at[fresh] - first).astype(np.int32)), pa.array(mix(names).view(np.int64)), pa.array(exact[:, 0]), pa.array(exact[:, 1]),
                    ],
                    [x.split()[0] for x in RUNS.split(", ")],
                )

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept: what is left of each text when the listed stretches of starts are taken out."""
    for part, texts in text_batches(batches):
        out = []
        for text, runs in zip(texts, part.column("runs").to_pylist(), strict=True):
            spans, kept, last = [], [], 0
            for r in sorted(runs or (), key=lambda r: r["start"]):
                first, end = r["start"], r["start"] + r["length"] + LENGTH - 1
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([first, end])
            for a, b in spans:
                kept.append(text[last:a])
                last = b
            out.append((len(text), sum(b - a for a, b in spans), len(spans), b"".join([*kept, text[last:]])))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


PLACE = ("doc_id", "mark", "start", "length", "lead")


def _settle(runs: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Runs whose name occurs again; and of those left under a sampled name that several run names share, one of each name.

    Counts are summed before they are shuffled, joins are to one row for each name; a name that very many rows have is no more
    than a skewed join."""
    again = runs.groupBy("sampled").agg(F.count("*").alias("n")).where("n > 1").select("sampled")
    runs = materialise(runs.join(again, "sampled"), "candidates")
    name = ["sampled", "name", "name2"]
    names = materialise(runs.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")), "names")
    settled = runs.join(names.where("n > 1").select(*name), name).select(*PLACE)
    if last:
        return settled, None
    mixed = names.groupBy("sampled").agg(F.count("*").alias("names"), F.count_if(F.col("n") == 1).alias("single")).where("names > 1 and single > 0")
    return settled, names.join(mixed.select("sampled"), "sampled").select("first.*")


def _of_texts(texts: DataFrame, runs: DataFrame, how: str = "inner") -> DataFrame:
    """texts (doc_id, mark, text) with the array of their runs (a written table). Only texts that may have runs are shuffled."""
    lists = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "length", "lead")).alias("runs"))
    same = F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.mark") == F.col("r.mark"))
    maybe, without = split_by_ids(texts, "mark", runs.select("mark"))
    joined = maybe.alias("t").join(lists.alias("r"), same, how).select("t.doc_id", "t.mark", "t.text", "r.runs")
    return joined if how == "inner" else joined.union(without.withColumn("runs", F.lit(None).cast(joined.schema["runs"].dataType)))


def repeated_starts(texts: DataFrame) -> DataFrame:
    """PLACE of stretches of starts of LENGTH-byte strings that also start elsewhere in texts (doc_id, mark, text)."""
    settled, rest = _settle(texts.mapInArrow(_runs, RUNS))
    open_ = materialise(_of_texts(texts, materialise(rest, "rest")), "open")
    grouped, rest = _settle(open_.mapInArrow(_parts(GROUP), RUNS))
    single, _ = _settle(_of_texts(open_.drop("runs"), materialise(rest, "rest")).mapInArrow(_parts(1), RUNS), last=True)
    return settled.union(grouped).union(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs (doc_id, text).

    Every byte covered by a string of LENGTH bytes that also starts elsewhere, in any row's text, is removed; strings are judged
    on the input and never cross texts. A null text is empty; texts under LENGTH bytes are kept whole; a null doc_id is a
    document as any other; rows that repeat are each other's elsewhere. Other columns are ignored; an empty table gives an
    empty one. kept is binary because a cut may fall inside a letter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text")).select("doc_id", "mark", "text")
    return _of_texts(texts, materialise(repeated_starts(texts), "starts"), "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
