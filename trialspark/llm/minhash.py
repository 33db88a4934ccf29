"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on the full shingle sets.

A document's set holds its distinct five-word shingles. One permutation (the mixer of the shingle hash, folded to UNIVERSE
slots) places each shingle; a second one, PI, shifted circularly by k, gives signature coordinate k. Read along the shifts,
a shingle's coordinates are one contiguous stretch of PI, so a signature is the minimum of such stretches.

Candidates come from bands of the signature. Pairs are never listed within a bucket: first each member is held against one
pivot of its bucket, then what stays apart from most of the bucket is held against it block by block, of which only a spanning
forest of likely links is kept. The forests' trees are families. A family of up to BLOCK members is compared in one task, exactly. In
a larger one each member is first confirmed on full sets against members that it likely goes with; only those that stay apart from
most of the family are held against all of it. So a family of N members, of which S stay apart, sends about N * (2 + S / BLOCK)
texts; where near copies do link up, that is in proportion to N.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.textnum import STEP, Batch, mix, text_batches
from trialspark.operators.components import connected_components
from trialspark.operators.prefilter import split_by_ids
from trialspark.shared import materialise

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
K = BANDS * ROWS
UNIVERSE = 1 << 20
#: Members of a block, and rows that a block is held against at once.
BLOCK, CHUNK = 256, 2048
#: Of K coordinates, so many agree at least in a pair at the threshold, but for about one pair in a hundred thousand.
LEAST_AGREE = 75
_PI = np.random.Generator(np.random.PCG64(5)).permutation(UNIVERSE).astype(np.uint32)
_STRETCHES = np.lib.stride_tricks.sliding_window_view(np.concatenate((_PI, _PI[: K - 1])), K)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; a text of fewer words is one shingle, without words none."""
    b = Batch(texts, lower=True)
    n_words = b.words_per_text()
    at, h = b.grams(WORDS)
    cut = np.searchsorted(b.doc[at], np.arange(b.n + 1))
    first = np.searchsorted(b.doc, np.arange(b.n + 1))
    sets = []
    for i in range(b.n):
        if n_words[i] >= WORDS:
            sets.append(np.unique(h[cut[i] : cut[i + 1]]))
        else:
            words = b.word[first[i] : first[i + 1]]
            sets.append(mix(np.sum(words * STEP[32 : 32 + len(words)], keepdims=True)) if len(words) else words)
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """K coordinates; of nothing, all ones."""
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    slots = (mix(shingles) >> np.uint64(44)).astype(np.int64)
    for i in range(0, len(slots), 16384):
        np.minimum(out, _STRETCHES[slots[i : i + 16384]].min(axis=0), out=out)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_batches(batches):
        sets = shingle_sets(texts)
        signatures = np.stack([signature(s) for s in sets])
        keys = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
        bands = np.zeros((len(sets), BANDS), np.uint64)
        for r in range(ROWS):
            bands += keys[:, :, r] * STEP[r]
        bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * STEP[40])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([np.sum(s, dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                pa.array(np.array([np.sum(mix(s ^ STEP[41]), dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64))),
                pa.array([s.astype(np.uint8).tobytes() for s in signatures], pa.binary()),
            ],
            ["doc_id", "n_shingles", "key1", "key2", "bands", "signature"],
        )


def _fits(a: str, b: str) -> F.Column:
    """Sets of these sizes can be similar enough."""
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


class Forest:
    """Labels that merge; of two, the smaller root stays."""

    def __init__(self, labels: np.ndarray) -> None:
        self.root = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root[i], self.root[j]))
        self.root[self.root == b] = a


def _alike(sig: np.ndarray, i: int, others: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of others, those whose sizes and signatures (one byte of each coordinate) go with i's."""
    others = others[(100 * n[others] >= PERCENT * n[i]) & (100 * n[i] >= PERCENT * n[others])]
    return others[(sig[others] == sig[i]).sum(axis=1) >= LEAST_AGREE]


def _against_pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), K) for c in ("of_u", "of_v"))
            pdf = pdf[(a == b).sum(axis=1) >= LEAST_AGREE]
        yield pdf[["u", "v"]]


def _pivot_links(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Likely links between the members of each bucket and its smallest one."""
    pivots = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("p")).select("bucket", F.col("p.id").alias("v"), F.col("p.n").alias("m"))
    pairs = members.join(pivots, "bucket").where((F.col("id") != F.col("v")) & _fits("n", "m")).select(F.col("id").alias("u"), "v").distinct()
    one, other = (signatures.select(F.col("id").alias(x), F.col("signature").alias(f"of_{x}")) for x in "uv")
    return pairs.join(one, "u").join(other, "v").select("u", "v", "of_u", "of_v").mapInPandas(_against_pivots, "u long, v long")


def _minor(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, id, label) with minor: whether the row's label is another than the one most rows of its group have."""
    most = rows.groupBy(group, "label").agg(F.count("*").alias("n")).groupBy(group).agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major"))
    return rows.join(most.where("labels > 1").select(group, "major"), group).withColumn("minor", F.col("label") != F.col("major")).drop("major")


def _dealt(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Minor rows of each group in blocks, each block beside all rows of the group in chunks: block, chunk, left (whether the row is
    there as one of the block). Rows of the major label are not held against each other."""
    sizes = rows.groupBy(group).agg(F.greatest(F.ceil(F.count_if("minor") / BLOCK), F.lit(1)).cast("int").alias("blocks"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    m = rows.join(sizes, group)
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = m.where("minor").withColumn("block", place(77, "blocks")).withColumn("chunk", every("chunks")).withColumn("left", F.lit(True))
    right = m.withColumn("chunk", place(78, "chunks")).withColumn("block", every("blocks")).withColumn("left", F.lit(False))
    return left.unionByName(right).select(group, "id", "label", *columns, "block", "chunk", "left")


def _across(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Places of the block's rows and of the chunk's rows, and what is of one label already."""
    left = pdf["left"].to_numpy()
    return np.flatnonzero(left), np.flatnonzero(~left), Forest(pdf["label"].to_numpy())


def _likely(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the likely links between a block and a chunk of a bucket, over what is not yet of one family."""
    ids, n = pdf["id"].to_numpy(), pdf["n"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), K)
    left, right, forest = _across(pdf)
    found = []
    for i in left:
        for j in _alike(sig, i, right[forest.root[right] != forest.root[i]], n):
            if forest.root[i] != forest.root[j]:
                forest.join(i, j)
                found.append((ids[i], ids[j]))
    return pd.DataFrame(found, columns=["u", "v"]).astype("int64")


class Sets:
    """Shingle sets of texts, their sizes and signatures."""

    def __init__(self, texts: pd.Series) -> None:
        self.sets = shingle_sets([x.encode() for x in texts])
        self.n = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        self.sig = np.stack([signature(s) for s in self.sets]).astype(np.uint8)

    def similar(self, i: int, j: int) -> bool:
        both = np.concatenate((self.sets[i], self.sets[j]))
        both.sort(kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= PERCENT * (len(both) - common)

    def links(self, left: np.ndarray, right: np.ndarray, forest: Forest) -> Iterator[tuple[int, int]]:
        """Links confirmed on the full sets, as many as join something."""
        for i in left:
            for j in _alike(self.sig, i, right[forest.root[right] != forest.root[i]], self.n):
                if forest.root[i] != forest.root[j] and self.similar(i, j):
                    forest.join(i, j)
                    yield i, j


def _pairs(ids: np.ndarray, found: Iterator[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["u", "v"]).astype("int64")


def _confirmed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within a family of at most BLOCK members."""
    ids, every = pdf["id"].to_numpy(), np.arange(len(pdf))
    return _pairs(ids, Sets(pdf["text"]).links(every, every, Forest(ids)))


def _confirmed_across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between a block and a chunk of a larger family."""
    return _pairs(pdf["id"].to_numpy(), Sets(pdf["text"]).links(*_across(pdf)))


def _confirmed_with(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of some members to one of their family, whose text comes along."""
    ids, own = pdf["id"].to_numpy(), (pdf["id"] == pdf["v"]).to_numpy()
    sets, ones = Sets(pdf["text"]), np.flatnonzero(own)
    return _pairs(ids, ((i, ones[0]) for i in np.flatnonzero(~own) if any(sets.similar(i, j) for j in ones)))


def _confirm(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (u, v) that hold on the full sets. Each u travels once for an edge, v once for every BLOCK of its edges."""
    sizes = edges.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    ends = edges.join(sizes, "v").select("v", F.col("u").alias("id"), F.pmod(F.xxhash64("u"), F.col("chunks")).alias("chunk"))
    pivots = sizes.select("v", F.col("v").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - F.lit(1).cast("long"))).alias("chunk"))
    both = ends.where("id <> v").unionByName(pivots).join(texts.select("id", "text"), "id")
    return both.groupBy("v", "chunk").applyInPandas(_confirmed_with, "u long, v long")


def _large_family_links(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of families with more than BLOCK members (texts: id, component, text), enough to connect what can be connected.

    First each member is confirmed against one that it likely goes with, then the other likely links between what is still
    apart; both in proportion to the links. Only members that are then still apart from most of their family are held
    against all of it."""
    edges = edges.join(texts.select(F.col("id").alias("u")), "u", "left_semi").distinct()
    first = materialise(edges.groupBy("u").agg(F.min("v").alias("v")), "first")
    links = materialise(_confirm(first, texts), "links")

    def labels() -> DataFrame:
        return connected_components(links)

    named = labels()
    u, v = (named.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "uv")
    rest = edges.join(first, ["u", "v"], "left_anti").join(u, "u", "left").join(v, "v", "left").where(~F.coalesce("of_u", "u").eqNullSafe(F.coalesce("of_v", "v")))
    links = links.union(materialise(_confirm(rest.select("u", "v"), texts), "links"))
    named = labels()
    members = texts.join(named, texts["id"] == named["node"], "left").select(texts["component"], "id", F.coalesce(named["component"], "id").alias("label"))
    apart = materialise(_minor(materialise(members, "labelled"), "component"), "apart").join(texts.select("id", "text"), "id")
    return links.union(_dealt(apart, "component", "text").groupBy("component", "block", "chunk").applyInPandas(_confirmed_across, "u long, v long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links, component_id, kept for each row of docs (doc_id, text).

    Equal sets form a class, named by its smallest doc_id; classes are linked where 100 * intersection >= 75 * union on the
    full sets. n_links counts the class's confirmed links that joined something; not all of its links are tried.
    component_id is the smallest doc_id reachable through classes and links; kept is doc_id = component_id.
    A null or empty text, or one without words, has n_shingles 0 and is linked with nothing. A null doc_id is linked with
    nothing: class_id and component_id are null and kept is true. Rows that repeat a doc_id are one document: their texts'
    links count together, and each row is returned. Other columns are ignored. An empty table gives an empty one.
    """
    schema = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, signature binary"
    sketches = materialise(docs.select("doc_id", "text").mapInArrow(_sketch, schema), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = materialise(classes, "classes")
    signatures = classes.select("id", "signature")
    members = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(members.join(shared, "bucket").select("bucket", "id", "n", "size"), "members")

    likely = materialise(_pivot_links(members, signatures), "likely")
    trees = connected_components(likely)
    apart = members.where("size > 2").join(trees, members["id"] == trees["node"], "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("label"))
    apart = materialise(_minor(materialise(apart, "labelled"), "bucket"), "apart").join(signatures, "id")
    more = materialise(_dealt(apart, "bucket", "n", "signature").groupBy("bucket", "block", "chunk").applyInPandas(_likely, "u long, v long"), "more")
    likely = likely.union(more)
    families = connected_components(likely) if more.take(1) else trees

    # Only texts of families are shuffled, and by the same plan at every size.
    named = families.select(F.col("node").alias("doc_id"), "component")
    texts, _ = split_by_ids(docs.select("doc_id", "text").where("text is not null"), "doc_id", named.select("doc_id"))
    sizes = named.groupBy("component").agg(F.count("*").alias("members"))
    texts = materialise(texts.hint("merge").join(named.join(sizes, "component"), "doc_id").select(F.col("doc_id").alias("id"), "component", "members", "text"), "texts")
    links = texts.where(F.col("members") <= BLOCK).groupBy("component").applyInPandas(_confirmed, "u long, v long")
    large = texts.where(F.col("members") > BLOCK)
    if large.take(1):
        links = links.union(_large_family_links(likely, large))
    links = materialise(links, "links")
    copies = filled.join(classes.select("key1", "key2", "n_shingles", "id"), ["key1", "key2", "n_shingles"])
    copies = materialise(copies.select("doc_id", "n_shingles", F.col("id").alias("class_id")), "copies")
    # Copies are of one class already; only an id that repeats with several texts links the classes of these.
    ids = copies.groupBy("doc_id").agg(F.min("class_id").alias("v"), F.max("class_id").alias("last")).where("v <> last")
    links_of_ids = copies.join(ids, "doc_id").select(F.col("class_id").alias("u"), "v")
    labels = connected_components(links.union(links_of_ids))
    ends = links.select("u", "v").distinct()
    degree = ends.select("u").union(ends.select("v")).groupBy(F.col("u").alias("class_id")).agg(F.count("*").alias("n_links"))
    in_class = copies.join(degree, "class_id", "left").join(labels, F.col("class_id") == labels["node"], "left")
    in_class = in_class.select("doc_id", "n_shingles", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    rest = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return in_class.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document stands for its group of near copies; all columns; repeated rows of it stay."""
    gone = materialise(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    maybe, stays = split_by_ids(docs, "doc_id", gone)
    return maybe.hint("merge").join(gone, "doc_id", "left_anti").select(docs.columns).union(stays)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
