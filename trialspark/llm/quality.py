"""Quality rules from repetition coverage: characters inside duplicated word n-grams of several lengths and duplicated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trialspark.llm.textnum import Batch, mix, repeated, seen_before, text_batches

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Most share of a text's word characters that may lie inside duplicated n-grams, by n.
GRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Most share of a text's word characters in lines that equal an earlier line.
LINE_LIMIT = 0.30
#: Most symbols for each word.
SYMBOL_LIMIT = 0.1
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in GRAM_LIMITS) + ", base_failed boolean, kept boolean"
)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts of SCHEMA but the verdicts, for a batch of texts."""
    b = Batch(texts)
    n = b.n
    letter = (b.buf & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(letter & ~b.space)))
    word_chars = chars[b.end] - chars[b.start]
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": b.words_per_text(), "word_chars": b.per_text(letter & ~b.space), "n_symbols": b.per_text(SYMBOL[b.buf])}

    line_end = np.flatnonzero(b.buf == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    line_doc = np.searchsorted(b.off, line_start, "right") - 1
    in_line = chars[line_end] - chars[line_start]
    has_word = in_line > 0
    line_start, line_end, line_doc, in_line = (x[has_word] for x in (line_start, line_end, line_doc, in_line))
    dup = seen_before(b.hashes.of(line_start, line_end) ^ salt[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[dup], in_line[dup], n).astype(np.int64)

    at = None
    for k in GRAM_LIMITS:  # a repeated window of more words begins at a repeated one of fewer
        at, h = b.grams(k, at)
        at = at[repeated(h ^ salt[b.doc[at]])]
        edges = np.zeros(len(b.word) + 1, np.int64)
        edges[at] += 1
        edges[at + k] -= 1
        inside = np.cumsum(edges[:-1]) > 0
        if k == 5:
            out["n_repeat_words"] = np.bincount(b.doc[inside], minlength=n)
        out[f"dup_{k}gram_chars"] = np.bincount(b.doc[inside], word_chars[inside], n).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    limits = {"dup_line_chars": LINE_LIMIT} | {f"dup_{k}gram_chars": x for k, x in GRAM_LIMITS.items()}
    too_much = np.any([m[name] > share * m["word_chars"] for name, share in limits.items()], axis=0)
    too_much |= m["n_symbols"] > SYMBOL_LIMIT * m["n_words"]
    return base_failed, ~base_failed & ~too_much


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_batches(batches):
        m = measure(texts)
        m["base_failed"], m["kept"] = verdicts(m)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(m[x]) for x in names[1:])], names)


def quality(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text).

    A null or empty text has no words: its counts are 0, base_failed is true and kept false. A null doc_id stays null; rows
    that repeat are measured one by one; other columns of docs are ignored; an empty table gives an empty one. No shuffle:
    each text is measured where it is read.
    """
    return docs.select("doc_id", "text").mapInArrow(_rows, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that quality() keeps; without a join, in one pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            yield part.filter(pa.array(verdicts(measure(texts))[1]))

    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
