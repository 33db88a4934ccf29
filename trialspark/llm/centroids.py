"""Centroid clustering of whole-number vectors by bit planes: plane i of a vector is one 64-bit word with bit i of each of its 64
components, so that weighted popcounts of ANDed planes are exact dot products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.shared import written

#: Fixed values of the contract.
COMPONENTS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 16, 3, 64, "1:"
#: Components are below 2**LARGEST in size, so that every distance fits into 64 bits.
LARGEST = 27
#: Vectors whose planes are counted at once.
CHUNK = 4096
PACKED = "vec_id long, planes array<long>, norm long"


def whole_numbers(df: DataFrame, vector: str) -> DataFrame:
    """vec_id, x: the vectors with exactly 64 finite components, as whole numbers floor(64 * component)."""
    double = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = df.where((F.size(vector) == COMPONENTS) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(double, lambda v: F.floor(v * SCALE)).alias("x"))


def planes_of(x: np.ndarray) -> np.ndarray:
    """(planes, n) words of (n, 64) whole numbers in two's complement: the last plane holds the signs and weighs negative."""
    width = 1 + max(int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length(), 1)
    bits = (x[None] >> np.arange(width)[:, None, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(width: int) -> np.ndarray:
    w = np.int64(1) << np.arange(width)
    w[-1] = -w[-1]
    return w


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of n vectors with one, from planes (planes, n) and (planes,)."""
    wa, wb = weights(len(a)), weights(len(b))
    out = np.zeros(a.shape[1], np.int64)
    for i in range(len(a)):
        counts = np.bitwise_count(a[i][None] & b[:, None]).astype(np.int64)
        out += wa[i] * (wb @ counts)
    return out


def squared(a: np.ndarray) -> np.ndarray:
    """Squared norms from planes: a pair of planes is counted once and weighs twice."""
    w = weights(len(a))
    out = np.zeros(a.shape[1], np.int64)
    for i in range(len(a)):
        for k in range(i, len(a)):
            out += (1 if i == k else 2) * w[i] * w[k] * np.bitwise_count(a[i] & a[k])
    return out


def numbers(a: np.ndarray) -> np.ndarray:
    """(n, 64) whole numbers of planes (planes, n)."""
    bits = np.unpackbits(np.ascontiguousarray(a)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return np.tensordot(weights(len(a)), bits.astype(np.int64), 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, CHUNK):
            part = batch.slice(first, CHUNK)
            x = part.column("x").flatten().to_numpy().reshape(-1, COMPONENTS)
            if len(x) and max(int(x.max()), -1 - int(x.min())) >> LARGEST:
                raise ValueError(f"a component is not below 2**{LARGEST}")
            planes = planes_of(x)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(planes), np.ascontiguousarray(planes.T).reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), lists, pa.array(squared(planes))], ["vec_id", "planes", "norm"])


def packed(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """PACKED: the planes and the squared norm of each kept vector; vectors read together have equally many planes."""
    return whole_numbers(df, vector).mapInArrow(_pack, PACKED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Stretches of rows with equally many planes."""
    for batch in batches:
        width = batch.column("planes").value_lengths().to_numpy()
        edges = np.flatnonzero(np.diff(width, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for first in range(lo, hi, CHUNK):
                part = batch.slice(first, min(CHUNK, hi - first))
                planes = part.column("planes").flatten().to_numpy().view(np.uint64).reshape(len(part), -1).T
                yield part, np.ascontiguousarray(planes), part.column("norm").to_numpy()


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; of equal ones the smallest number."""
    best, cluster = None, np.zeros(len(norm), np.int64)
    for k, c in enumerate(centroids):
        own = planes_of(c[None])
        d = norm - 2 * dots(planes, own[:, 0]) + squared(own)[0]
        cluster = cluster if best is None else np.where(d < best, k, cluster)
        best = d if best is None else np.minimum(best, d)
    return cluster, best


def _sums(centroids: np.ndarray):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), COMPONENTS), np.int64)
        for _, planes, norm in _runs(batches):
            cluster, _ = nearest(planes, norm, centroids)
            x = numbers(planes)
            for k in np.unique(cluster):
                n[k] += (cluster == k).sum()
                total[k] += x[cluster == k].sum(axis=0)
        k, i = np.divmod(np.arange(total.size), COMPONENTS)
        full = n[k] > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[full]) for v in (k, i, n[k], total.reshape(-1))], ["k", "i", "n", "total"])

    return rows


def _assign(centroids: np.ndarray):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, planes, norm in _runs(batches):
            cluster, d = nearest(planes, norm, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return rows


def first_centroids(table: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order; k rows come to the driver."""
    order = table.withColumn("h", F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "planes").limit(k)
    return np.array([numbers(np.array(r["planes"], np.int64).view(np.uint64)[:, None])[0] for r in order.select("planes").collect()], np.int64).reshape(-1, COMPONENTS)


def cluster(df: DataFrame, vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector, final centroids).

    Vectors of another length, null vectors and those with a null, NaN or infinite component are left out. Rows with one vec_id
    are vectors of their own; ids that are null come last when the first centroids are chosen, equal ids by their planes. With
    fewer than k vectors there are as few centroids, without any no rows. Other columns are ignored. Components of 2**LARGEST
    and more (64 times the given ones) are an error, as their distances would not fit.

    Each round reads the packed vectors, an eighth to a quarter of the input, and shuffles one row of each task for each centroid
    and component; the driver gets k times 64 sums. The planes are written once, so a lost executor costs a re-read.
    """
    table, _ = written(packed(df, vector), "planes")
    centroids = first_centroids(table, k)
    for _ in range(rounds if len(centroids) else 0):
        sums = table.mapInArrow(_sums(centroids), "k long, i long, n long, total long").groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        centroids = centroids.copy()
        for r in sums.collect():
            centroids[r["k"], r["i"]] = r["total"] // r["n"]
    return table.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), centroids


def report(df: DataFrame, vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """cluster() with cluster_inertia, inertia and the digest of each centroid; a table of k rows is broadcast."""
    assigned, centroids = cluster(df, vector, k, rounds)
    assigned, _ = written(assigned, "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    known = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    rounds = """
, a{r} AS (
  SELECT vec_id, k, d FROM (
    SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d,
           row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.k) AS best
    FROM v JOIN c{r} AS c ON v.i = c.i GROUP BY v.vec_id, c.k
  ) AS q WHERE best = 1
)"""
    moved = """
, m{r} AS (
  SELECT a.k, v.i, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x FROM a{r} AS a JOIN v ON v.vec_id = a.vec_id GROUP BY a.k, v.i
), c{n} AS (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m ON m.k = c.k AND m.i = c.i
)"""
    start = """
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64
), v AS (
  SELECT vec_id, unnest(range(1, 65)) AS i, unnest([floor(64 * x::DOUBLE)::BIGINT for x in embedding]) AS x FROM e
), s AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS k FROM e
), c0 AS (
  SELECT s.k, v.i, v.x FROM s JOIN v ON v.vec_id = s.vec_id WHERE s.k < 16
)"""
    body = "".join(rounds.format(r=r) + moved.format(r=r, n=r + 1) for r in range(ROUNDS)) + rounds.format(r=ROUNDS)
    end = """
, h AS (
  SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{r} GROUP BY k
)
SELECT a.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{r} AS a JOIN h ON h.k = a.k
"""
    return start + body + end.format(r=ROUNDS)


SQL = _sql()
