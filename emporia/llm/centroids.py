"""Operator 13: centroid clustering over subvector dictionaries.

Vectors become integers once. Their dimensions are cut into blocks of
``WIDTH``; within a chunk of vectors each block is stored, without loss, as a
dictionary of its distinct subvectors and one code per vector. A chunk is one
row of a written table, so a dictionary never has more entries than its chunk
has vectors, and nothing of it is broadcast or collected.

In a round every dictionary entry's exact squared distance to each centroid's
block is computed once, and a vector's distance is the sum of its codes'
partial distances. New centroids come from the dictionaries as well: how often
a cluster holds a code, times the subvector. A task returns one row per
cluster; only the centroids (clusters x dimensions) pass through the driver.

All arithmetic is in integers. Defined results: vectors of another length, or
with a null or non-finite component, are left out, null vectors too; repeated
vectors and ids count row by row, and between starting vectors with one id the
smaller components come first; a null id is clustered but never starts a
centroid; with fewer vectors than centroids there are as many centroids as
vectors; ties go to the smaller number, and a centroid without vectors stays
where it is; no vector gives no row. A component whose integer needs more than
27 bits is an error that names it, as its distance may not fit a long. Only
the key and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, session_conf, table

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
WIDTH = 2
CHUNK = 16_384       # vectors whose subvectors share dictionaries
_LARGEST = 1 << 27
_CHUNK_SCHEMA = "ids array<{id}>, codes array<binary>, entries array<binary>"


def whole(vector: Column, dimensions: int) -> Column:
    """Vectors of that length whose components are all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (F.size(vector) == dimensions) & F.forall(vector, finite)


def block_dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct subvectors, code per row) of the rows of a block."""
    code = np.zeros(len(block), np.int64)
    for column in block.T:
        _, at = np.unique(column, return_inverse=True)
        _, first, code = np.unique(code * (at.max(initial=0) + 1) + at, return_index=True, return_inverse=True)
    return block[first], code


def _encode(dimensions: int, scale: int, width: int, chunk: int):
    def packed(ids: list, vectors: list) -> pa.RecordBatch:
        v = np.concatenate(vectors)
        codes, entries = [], []
        for b in range(0, dimensions, width):
            d, c = block_dictionary(v[:, b:b + width])
            codes.append(c.astype(np.uint32 if chunk > 65_536 else np.uint16).tobytes())
            entries.append(np.ascontiguousarray(d).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)),
                                           pa.array([codes], pa.list_(pa.binary())), pa.array([entries], pa.list_(pa.binary()))],
                                          ["ids", "codes", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                x = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.abs(x).max(initial=0) > _LARGEST:
                    raise ValueError(f"component {x[np.abs(x).argmax()] / scale} is too large for exact distances")
                if held + part.num_rows > chunk:
                    yield packed(ids, vectors)
                    ids, vectors, held = [], [], 0
                ids.append(part.column("k"))
                vectors.append(x.astype(np.int32).reshape(-1, dimensions))
                held += part.num_rows
        if held:
            yield packed(ids, vectors)
    return run


def _blocks(row: pa.RecordBatch, i: int, width: int, dimensions: int, chunk: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(dimensions, entries, codes) of each block of a chunk."""
    kind = np.uint32 if chunk > 65_536 else np.uint16
    for b, (c, e) in enumerate(zip(row.column("codes")[i].values, row.column("entries")[i].values)):
        at = slice(b * width, min((b + 1) * width, dimensions))
        yield (at, np.frombuffer(e.as_buffer(), np.int32).reshape(-1, at.stop - at.start).astype(np.int64),
               np.frombuffer(c.as_buffer(), kind))


def nearest(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector."""
    total = 0
    for at, entries, codes in blocks:
        partial = ((entries[:, None, :] - centroids[None, :, at]) ** 2).sum(2)     # once per distinct subvector
        total = total + partial[codes]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def _sums(centroids: np.ndarray, width: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = list(_blocks(batch, i, width, dims, chunk))
                best, _ = nearest(blocks, centroids)
                n += np.bincount(best, minlength=k)
                for at, entries, codes in blocks:
                    held = np.bincount(best * len(entries) + codes, minlength=k * len(entries))
                    sums[:, at] += held.reshape(k, -1) @ entries
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])
    return run


def _assign(centroids: np.ndarray, width: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                best, distance = nearest(list(_blocks(batch, i, width, centroids.shape[1], chunk)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(best, pa.int32()), pa.array(distance)],
                                                 ["k", "cluster", "distance"])
    return run


def first_centroids(vectors: DataFrame, clusters: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; at most ``clusters`` rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")), 256)
    exact = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    rows = (vectors.where("k is not null").select(h.alias("h"), exact.alias("v")).orderBy("h", "v").limit(clusters).collect())
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, width: int = WIDTH,
            chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) per kept vector, written; and the centroids."""
    spark = vectors.sparkSession
    kept = vectors.where(whole(F.col(vector), dimensions)).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    kind = kept.schema["k"].dataType.simpleString()
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}):
        chunks = materialize(kept.mapInArrow(_encode(dimensions, scale, width, chunk), _CHUNK_SCHEMA.format(id=kind)), "centroid-chunks")
    centroids = first_centroids(kept, clusters, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long"), centroids
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):      # a row is a chunk
        for _ in range(rounds):
            each = chunks.select("codes", "entries").mapInArrow(_sums(centroids, width, chunk), "cluster int, n long, sums array<long>")
            sums = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(dimensions)]).alias("sums"))
            for r in sums.collect():      # one row per centroid
                centroids[r.cluster] = [s // r.n for s in r.sums]
        found = materialize(chunks.mapInArrow(_assign(centroids, width, chunk), f"k {kind}, cluster int, distance long"), "centroid-found")
    return found.withColumnRenamed("k", key), centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, with what its cluster and all clusters sum up to."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    sums = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")      # one row per centroid
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = """a{i} AS (SELECT rid, c, d FROM (
  SELECT rid, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
    move = """s{j} AS (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (rid), range(1, {dims} + 1) r(j) GROUP BY c, j),
m{j} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{j} GROUP BY c),
c{j} AS (SELECT c, coalesce(m{j}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{j} USING (c))"""
    steps = []
    for i in range(ROUNDS):
        steps += [near.format(i=i), move.format(i=i, j=i + 1, dims=DIMENSIONS)]
    steps.append(near.format(i=ROUNDS))
    return f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) <= {CLUSTERS}),
{", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (rid) JOIN c{ROUNDS} USING (c)
"""


SQL = _sql()
