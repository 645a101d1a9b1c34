"""Operator 2: SimHash near-duplicates through a Gray-order hierarchical index.

Top of the index: five masks cover the 64 bits. Two fingerprints that differ
in at most four bits agree on a whole mask, so every link lies inside a top
node, the group of fingerprints with one shared masked pattern. A group above
``GROUP`` members is factored further: the bits outside its mask are cut into
five again, and by the same argument each link stays inside one of the child
nodes. No group is capped: what still exceeds the size after ``DEPTH`` levels
is searched as it is.

Inside a group the fingerprints are sorted by Gray rank, which puts neighbours
that share many bits side by side. Runs of them become leaves and runs of
leaves upper nodes, each with the mask of the bits that all below it share and
their pattern. Pairs of nodes are compared from the top; the differences on
the bits that both nodes share add up on the way down, and a pair of whole
groups is pruned once they exceed the distance. What remains is compared bit
by bit. A group returns at most one link per member (a spanning forest of its
links), never its pairs; components of these links are found by Spark.

Equal fingerprints are collapsed first, so copies cost one entry.

Defined results: null or empty text has fingerprint zero and is linked like any
other; repeated rows share a component; a null id never names a component and
:func:`deduplicate` keeps such rows; an empty table gives an empty result.
Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, fresh, materialize, small_batches, table

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
GROUP = 8192     # members of a group that are searched without factoring it further
DEPTH = 3        # levels of shared masks
LEAF = 32
FAN = 16
PAIRS = 4096     # leaf pairs compared at a time
HASHES = 65_536  # shingle hashes counted at a time


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned SimHash of a whole text over its word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    k = min(size, len(words))
    stops = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), HASHES):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + HASHES], stops[at:at + HASHES])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(stops)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(fp)], ["k", "h", "fp"])
    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Written table (k, h, fp): key, a hash of the text that tells rows of one
    key apart, and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), _text_hash(F.col(text)).alias("h"), F.col(text).alias("t"))
    return materialize(rows.mapInArrow(_fingerprints(size), f"k {kind}, h long, fp long"), "simhash-fp")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def masks(bits: list[int], parts: int) -> list[list[int]]:
    """Bits cut into consecutive parts of near equal size."""
    return [list(x) for x in np.array_split(bits, parts)]


def _signed(bits: list[int]) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _children(paths: list[list[int]], distance: int) -> list[list[int]]:
    """Masks of all children of the nodes with these fixed bits, in order."""
    out = []
    for fixed in paths:
        free = [b for b in range(BITS) if b not in fixed]
        out += [sorted(fixed + part) for part in masks(free, distance + 1)]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each word in the reflected Gray order."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _level(ands: np.ndarray, ors: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(0, len(ands), fan)
    return np.bitwise_and.reduceat(ands, cuts), np.bitwise_or.reduceat(ors, cuts)


def _expand(i: np.ndarray, j: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Child pairs (first <= second) of node pairs."""
    k = np.arange(fan)
    a = np.repeat(i[:, None] * fan + k, fan, axis=1).ravel()
    b = np.tile(j[:, None] * fan + k, (1, fan)).ravel()
    keep = (a <= b) & (b < n)
    return a[keep], b[keep]


class _Forest:
    """Labels of connected members, updated by arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, label[label]):
                label[:] = label[label]


def local_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what lies within the distance."""
    fps = np.unique(fps)
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    forest = _Forest(n)
    levels = [_level(fps, fps, LEAF)]
    while len(levels[-1][0]) > FAN:
        levels.append(_level(*levels[-1], FAN))
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        ands, ors = levels[depth]
        shared = ~(ands ^ ors)     # bits on which all below agree
        keep = np.bitwise_count((ands[i] ^ ands[j]) & shared[i] & shared[j]) <= distance
        i, j = i[keep], j[keep]
        if depth:
            i, j = _expand(i, j, FAN, len(levels[depth - 1][0]))
    for at in range(0, len(i), PAIRS):
        a, b = _expand(i[at:at + PAIRS], j[at:at + PAIRS], LEAF, n)
        hit = (np.bitwise_count(fps[a] ^ fps[b]) <= distance) & (a < b)
        forest.link(a[hit], b[hit])
    other = np.flatnonzero(forest.label != np.arange(n))
    return fps[other], fps[forest.label[other]]


def _search_groups(distance: int):
    """Rows sorted by node: the links of each group; a group may span batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def result(groups: list[np.ndarray]) -> pa.RecordBatch:
            links = [local_links(g, distance) for g in groups if len(g) > 1]
            cols = [np.concatenate([x[c] for x in links] or [np.empty(0, np.uint64)]).view(np.int64) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
            groups = np.split(fp, cuts)
            if last == node[0]:
                held.append(groups[0])
                groups = groups[1:]
                if not groups:
                    continue
            done = [np.concatenate(held)] if held else []
            held, last = [groups[-1]], node[-1]
            yield result(done + groups[:-1])
        if held:
            yield result([np.concatenate(held)])
    return run


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP, depth: int = DEPTH) -> DataFrame:
    """Written table (a, b): links that connect distinct fingerprints (column
    fp, signed long) exactly as all pairs within the distance would."""
    nodes = _children([[]], distance)
    level = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_signed(m)) for m in nodes])).alias("path", "v"))
    level = level.select("fp", "path", F.xxhash64("path", "v").alias("node"))
    ready, out = [], None
    for d in range(1, depth + 1):
        if d == depth:
            ready.append(level.select("fp", "node"))
            break
        large = materialize(level.groupBy("node").count().where(F.col("count") > group).select("node"), "simhash-large")
        if large.isEmpty():
            ready.append(level.select("fp", "node"))
            break
        ready.append(level.join(large, "node", "left_anti").select("fp", "node"))
        nodes = _children(nodes, distance)
        each = distance + 1
        patterns = F.array(*[F.array(*[F.lit(_signed(m)) for m in nodes[p:p + each]]) for p in range(0, len(nodes), each)])
        level = materialize(
            level.join(large, "node", "left_semi")
            .select("fp", "node", "path", F.posexplode(F.get(patterns, F.col("path"))).alias("part", "mask"))
            .select("fp", (F.col("path") * each + F.col("part")).alias("path"),
                    F.xxhash64("node", "part", F.col("fp").bitwiseAND(F.col("mask"))).alias("node")), "simhash-level")
    for r in ready:
        out = r if out is None else out.unionByName(r)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = out.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(
        _search_groups(distance), "a long, b long")
    return materialize(found, "simhash-links")


def components(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Written table (fp, component_id, keep_h): for each distinct fingerprint the
    smallest key it reaches and the text hash of the row that stands for it."""
    best = F.min(F.when(F.col("k").isNotNull(), F.struct("k", "h"))).alias("best")
    fps = materialize(rows.groupBy("fp").agg(best), "simhash-distinct")
    roots = connected_components(links(fps.select("fp"), distance))
    of = materialize(fps.join(roots, fps["fp"] == roots["node"], "left")
                     .select("fp", F.coalesce("root", "fp").alias("root"), "best"), "simhash-roots")
    low = materialize(of.groupBy("root").agg(F.min("best").alias("low")), "simhash-low")
    return materialize(of.join(low, "root").select("fp", F.col("low.k").alias("component_id"),
                                                   F.col("low.h").alias("keep_h")), "simhash-components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id) per row of ``docs``."""
    rows = fingerprints(docs, key, text, size)
    return (rows.join(components(rows, distance), "fp")
            .select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: its smallest key (of rows that
    share that key the one with the smallest text hash). Rows without a key stay."""
    rows = fingerprints(docs, key, text, size)
    keep = components(rows, distance)
    k, h, th = (fresh(x, docs) for x in ("_keep_k", "_keep_h", "_text_h"))
    keep = materialize(keep.where("component_id is not null").select(F.col("component_id").alias(k), F.col("keep_h").alias(h))
                       .distinct(), "simhash-keep")
    discard(rows)
    hashed = docs.withColumn(th, _text_hash(F.col(text)))
    kept = (hashed.join(keep, (F.col(key) == F.col(k)) & (F.col(th) == F.col(h)), "left_semi")
            .dropDuplicates([key, th]).drop(th))
    return kept.unionByName(docs.where(F.col(key).isNull()))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
