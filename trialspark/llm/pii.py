"""Personal data: fixed forms, and identifiers of other forms found from their context by bootstrapping.

Base spans follow fixed forms (email, ip, card, phone). Seeds are the base spans and key-like strings of a known form. Each
identifier-like word is an instance, the words before it and the sign it stands behind are its pattern; in the graph of
patterns and instances, patterns gain confidence from the known instances they hold, instances from the patterns that hold
them, round by round. Patterns of high confidence give the spans of kind "id".
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.shared import materialise

KINDS = ("email", "ip", "card", "phone")
LABEL = {"id": "[ID]"} | {k: f"[{k.upper()}]" for k in KINDS}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = regex.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = regex.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = regex.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = regex.compile("[0-9]")
#: An identifier-like word: letters, digits and joining signs, at least 8 of them and a digit among them.
_INSTANCE = regex.compile(r"(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{8,}(?![A-Za-z0-9_\-])")
_CONTEXT = regex.compile(r"[^\x20\x09-\x0D]+")
#: A seed beside the base kinds: a long run of hexadecimal digits with letters and digits.
_KEY = regex.compile(r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{24,}")
#: Instances with more letters go into the graph as digests, so that its keys stay short; their spans are whole.
LONG = 256
#: Letters before an instance in which its pattern is looked for, and words that form it.
REACH, CONTEXT_WORDS = 64, 2
#: Parts into which the rows of one context are dealt when they are joined.
SALTS = 16
ROUNDS = 3
#: A pattern counts if so much of what it holds is known, over so many known instances at least.
CONFIDENCE, SUPPORT = 0.9, 5
BASE = "array<struct<kind:string,start:int,end:int>>"


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email form, found from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at) if first < at else None
        if m:
            last = m.end()
            yield first, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in KINDS, then by start; code points, end exclusive."""
    spans = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return spans
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return spans


def pattern_of(text: str, start: int) -> str | None:
    """The words before an instance, lower-cased, with the letters it directly stands behind."""
    words = _CONTEXT.findall(text[max(0, start - REACH) : start].lower())
    return " ".join(words[-CONTEXT_WORDS - (not text[start - 1].isspace()) :]) if words else None


def named(instance: str, key: bool) -> str:
    """The instance in the graph: itself, or the digest of a long one (hexadecimal digits alone only for a key)."""
    if len(instance) <= LONG:
        return instance
    return ("" if key else "#") + hashlib.sha256(instance.encode("utf-8", "surrogatepass")).hexdigest()


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int, bool]]:
    """(pattern, instance, start, end, seed) of every identifier-like word, however long; a base span is an instance and a seed. The
    pattern comes from the REACH letters before it."""
    if not base and not _DIGIT.search(text):
        return []
    taken = sorted((a, b) for _, a, b in base)
    found = [(a, b, True, False) for a, b in taken]
    at = 0
    for m in _INSTANCE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            key = bool(_KEY.fullmatch(m[0]))
            found.append((m.start(), m.end(), key, key))
    return [(p, named(text[a:b], key), a, b, seed) for a, b, seed, key in found if (p := pattern_of(text, a))]


SPANS = "row_id string, base " + BASE + ", found array<struct<pattern:string,instance:string,start:int,end:int,seed:boolean>>"


def _scanner(keep: list[str]):  # noqa: ANN202
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    hit = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = os.urandom(12).hex()
            base, found = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base.append(base_spans(text))
                found.append([dict(zip(("pattern", "instance", "start", "end", "seed"), x, strict=True)) for x in instances(text, base[-1])])
            own = [pa.array([f"{mark}{i}" for i in range(len(base))]), pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in b] for b in base], span), pa.array(found, hit)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], [*keep, "row_id", "base", "found"])

    return rows


def salt(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def salted(patterns: DataFrame) -> DataFrame:
    """One row for each salt, so that the instances of a very common context are joined in as many tasks."""
    return patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def confident_patterns(scanned: DataFrame) -> DataFrame:
    """(pattern, confidence): the bootstrap over the graph of patterns and instances; every round is joins and sums."""
    graph = scanned.select(F.explode("found").alias("f")).groupBy("f.pattern", "f.instance").agg(F.max(F.col("f.seed").cast("double")).alias("seed"))
    graph = materialise(graph.select("pattern", "instance", "seed"), "graph")
    trust = graph.groupBy("instance").agg(F.max("seed").alias("trust"))
    for i in range(ROUNDS):
        scored = graph.join(trust, "instance").groupBy("pattern").agg(F.avg("trust").alias("confidence"), F.sum("trust").alias("support"))
        scored = scored.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        if i < ROUNDS - 1:
            reached = graph.withColumn("salt", salt("instance")).join(salted(scored), ["pattern", "salt"]).groupBy("instance").agg(F.max("confidence").alias("reached"))
            seeds = graph.groupBy("instance").agg(F.max("seed").alias("seed"))
            trust = seeds.join(reached, "instance", "left").select("instance", F.greatest("seed", F.coalesce("reached", F.lit(0.0))).alias("trust"))
    return scored.select("pattern", "confidence")


def with_spans(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of rows (which has text), base and spans: array<struct<kind,start,end>> with the base spans by kind and
    start, in spans followed by those of kind "id" by start.

    A null or empty text has no spans; null ids and repeated rows stay as they are; an empty table gives an empty one. keep
    may not hold row_id, base, found, spans or more. Rows are told apart by marks written with them, not by their ids.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), SPANS])
    scanned = materialise(rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scanner(keep), schema), "scanned")
    hits = scanned.select("row_id", F.explode("found").alias("f")).where("not f.seed or f.instance rlike '^[0-9a-f]{24,}$'")
    hits = hits.select("row_id", F.col("f.pattern").alias("pattern"), F.struct(F.lit("id").alias("kind"), F.col("f.start").alias("start"), F.col("f.end").alias("end")).alias("span"))
    known = salted(confident_patterns(scanned))
    more = hits.withColumn("salt", salt("row_id")).join(known, ["pattern", "salt"], "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_list("span")).alias("more"))
    # Rows without a possible further span stay where they are.
    open_ = F.exists("found", lambda f: ~f["seed"] | f["instance"].rlike("^[0-9a-f]{24,}$"))
    joined = scanned.where(open_).join(more, "row_id", "left").select(*keep, "base", F.concat("base", F.coalesce("more", F.array().cast(BASE))).alias("spans"))
    return joined.union(scanned.where(~open_).select(*keep, "base", F.col("base").alias("spans")))


def mask(rows: DataFrame) -> DataFrame:
    """rows with every span of text replaced by its kind in brackets (of spans that overlap, the first one's kind), and n_chars
    set anew where there is such a column; a null text stays null."""
    keep = rows.columns
    others = {c: f"_{i}" for i, c in enumerate(keep) if c != "text"}  # so that no column's name meets one of with_spans
    marked = with_spans(rows.select("text", *(F.col(f"`{c}`").alias(a) for c, a in others.items())), ["text", *others.values()])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    parts, last, done = [], 0, texts[i]
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= last:
                            parts += [done[last : s["start"]], LABEL[s["kind"]]]
                        last = max(last, s["end"])
                    texts[i] = "".join([*parts, done[last:]])
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in keep:
                new["n_chars"] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field(others["n_chars"]).type)
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(others[c]) for c in keep], keep)

    return marked.select("text", *others.values(), "spans").mapInArrow(replaced, rows.schema)


def as_text(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(docs, ["doc_id"])

    def of(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
