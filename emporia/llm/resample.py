"""Operator 11: resampling documents towards a target distribution.

Words are what delimiters bound. A dictionary of distinct words, each between
two delimiters and with its CRC-32 and its length in bytes as payload, is one
Aho-Corasick automaton; a scan over a text emits the payloads in order. The
CRC-32 of a run of words follows from the payloads of its neighbours alone
(``crc(a b)`` is ``crc(a )`` moved on by ``len(b)`` bytes, xor ``crc(b)``), so
no run is ever spelled out. A run's bucket is its CRC modulo the number of
buckets; buckets are written per document once, counted over all documents and
all target texts, and summed up as gains.

The dictionary is broadcast, so it is bounded: up to ``DICTIONARY`` distinct
words of at most ``LONGEST`` bytes, the most frequent ones, counted over the
whole corpus and the whole target. Every other word shows as a gap between two payloads and has
its payload computed from its own bytes there, so the dictionary's size decides
speed only, never a result.

The drawn documents are ranked by a distributed sort: range partitions are
numbered in order and offset by the sizes of the partitions before them.

Defined results: null, empty and wordless texts have no features and weight 0
and are never drawn; a null key is hashed as the empty string and comes after
every other one among equal scores; repeated rows are scored and drawn row by
row; without target texts every bucket has the target count 0; an empty table
gives no row. Very long texts are scanned in segments cut at delimiters. Only
the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_az, materialize, session_conf, table

NGRAMS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
DICTIONARY = 65_536     # words of the automaton
LONGEST = 64            # bytes of a word of the automaton
SEGMENT = 1 << 20       # bytes scanned at a time
BATCH = 256             # texts handed to a Python worker at a time
DELIMITERS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A-Z to a-z, delimiters to a space, all other bytes as they are.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_POLY = 0xEDB88320


def _shift_tables() -> np.ndarray:
    """[k][byte][value]: what a CRC's byte becomes after 2^k zero bytes."""
    def times(matrix: list[int], x: int) -> int:
        out = 0
        for m in matrix:
            if x & 1:
                out ^= m
            x >>= 1
        return out

    matrix = [_POLY] + [1 << i for i in range(31)]      # one zero bit
    for _ in range(3):                                  # 2, 4, 8 bits: one byte
        matrix = [times(matrix, m) for m in matrix]
    out = np.empty((32, 4, 256), np.uint32)
    for k in range(32):
        for byte in range(4):
            out[k, byte] = [times(matrix, v << (8 * byte)) for v in range(256)]
        matrix = [times(matrix, m) for m in matrix]
    return out


_SHIFT = _shift_tables()


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the joined strings, from the CRCs of both parts and the
    length of the right one in bytes."""
    out = left.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        c, t = out[at], _SHIFT[k]
        out[at] = t[0][c & 0xFF] ^ t[1][(c >> 8) & 0xFF] ^ t[2][(c >> 16) & 0xFF] ^ t[3][c >> 24]
    return out ^ right.astype(np.uint32)


def automaton(words: list[str]):
    """Automaton over UTF-8 bytes (as Latin-1 characters); payload: CRC and length."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        b = w.encode()
        out.add_word(f" {b.decode('latin-1')} ", zlib.crc32(b) << 32 | len(b))
    if len(out):
        out.make_automaton()
    return out


def _segments(raw: bytes, size: int) -> Iterator[bytes]:
    """Pieces that begin and end with a delimiter and cut no word."""
    at = 0
    while at < len(raw):
        end = len(raw) if at + size >= len(raw) else raw.rfind(b" ", at, at + size) + 1
        if end <= at:       # a word longer than a segment
            end = raw.find(b" ", at + size) + 1 or len(raw)
        yield b" " + raw[at:end] + b" "
        at = end


def payloads(text: str | None, known, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32, length in bytes) of the words of a whole text, in order."""
    raw = (text or "").encode().translate(_BYTES)
    crcs, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for piece in _segments(raw, size):
        b = np.frombuffer(piece, np.uint8)
        edge = np.diff((b != 0x20).view(np.int8))
        first, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        if not len(first):
            continue
        hits = list(known.iter(piece.decode("latin-1"))) if len(known) else []
        crc, length = np.empty(len(first), np.uint32), last - first
        at = np.searchsorted(last, np.fromiter((end for end, _ in hits), np.int64, len(hits)))
        crc[at] = np.fromiter((found for _, found in hits), np.uint64, len(hits)) >> np.uint64(32)
        if len(hits) < len(first):      # words that the dictionary does not have
            gap = np.ones(len(first), bool)
            gap[at] = False
            for i in np.flatnonzero(gap).tolist():
                crc[i] = zlib.crc32(piece[first[i]:last[i]])
        crcs.append(crc)
        lengths.append(length)
    return np.concatenate(crcs), np.concatenate(lengths)


def run_hashes(crc: np.ndarray, length: np.ndarray, ngrams: int) -> np.ndarray:
    """CRC-32 of every run of 1 to ``ngrams`` words, joined by one space."""
    out, run = [crc], crc
    space, one = np.full(len(crc), zlib.crc32(b" "), np.uint32), np.ones(len(crc), np.int64)
    for n in range(1, min(ngrams, len(crc))):
        run = compose(compose(run[:-1], space[n:], one[n:]), crc[n:], length[n:])
        out.append(run)
    return np.concatenate(out)


def dictionary(texts: DataFrame, text: str = "text", most: int = DICTIONARY, longest: int = LONGEST) -> list[str]:
    """Frequent distinct words of all texts: all above a count that at most
    ``most`` of them reach, and of ``longest`` bytes at most, so they may be
    collected and broadcast. The count is found by a histogram, so no task and
    no driver holds more words than those."""
    split = F.split(lower_az(F.coalesce(F.col(text), F.lit(""))), DELIMITERS)
    found = texts.select(F.explode(split).alias("w")).where((F.col("w") != "") & (F.octet_length("w") <= longest))
    level = F.floor(F.log2("c") * 16)
    counted = materialize(found.groupBy("w").agg(F.count(F.lit(1)).alias("c")).select("w", level.alias("level")), "resample-words")
    sizes = sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)     # 16 a doubling
    total, lowest = 0, None
    for at, n in sizes:
        total += n
        if total > most:
            break
        lowest = at
    out = [] if lowest is None else sorted(r.w for r in counted.where(F.col("level") >= lowest).select("w").collect())
    discard(counted)
    return out


def _scan(known, ngrams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(known.value)
        for batch in batches:
            n_words, found = [], []
            for text in batch.column("text"):
                crc, length = payloads(text.as_py(), machine)
                n_words.append(len(crc))
                found.append((run_hashes(crc, length, ngrams) % np.uint32(buckets)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], ["k", "n_words", "runs"])
    return run


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for runs in batch.column("runs"):
                total += np.bincount(np.frombuffer(runs.as_buffer(), np.uint32), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    return run


def bucket_counts(runs: DataFrame, buckets: int) -> list[int]:
    """Features of each bucket over all rows: one row per task and bucket is shuffled."""
    got = runs.select("runs").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in got.collect():      # at most one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    b, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))))
            for s, t in zip(source, target)]


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("runs")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("n_words"), pa.array([len(r) for r in runs], pa.int64()),
                 pa.array([int(gain[r].sum()) for r in runs], pa.int64())], ["k", "n_words", "n_features", "weight"])
    return run


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in that order, without one task that
    sees them all: a row's place in its range partition plus the sizes of the
    partitions before it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()      # partition << 33 | place
    rows = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", place), "resample-sorted")
    part = F.shiftright("_at", 33)
    sizes = sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())     # one row per partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "_p long, _before long")
    return (rows.join(F.broadcast(offsets), part == F.col("_p"))
            .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_p", "_before"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, most: int = DICTIONARY) -> DataFrame:
    """(key, n_features, weight, score, rank) per row of ``docs``; rank is null
    for documents that are not drawn."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    wanted = target.select(F.lit(None).cast(narrow.schema["k"].dataType).alias("k"), F.col(text).alias("text"))
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        known = spark.sparkContext.broadcast(dictionary(narrow.unionByName(wanted), most=most))
        kind = narrow.select("k").schema["k"].dataType.simpleString()
        scan = lambda df: df.mapInArrow(_scan(known, ngrams, buckets), f"k {kind}, n_words long, runs binary")
        runs = materialize(scan(narrow), "resample-runs")
        gain = np.array(gains(bucket_counts(runs, buckets), bucket_counts(scan(wanted), buckets)), np.int64)
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
        noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
        scored = materialize(runs.mapInArrow(_weigh(gain), f"k {kind}, n_words long, n_features long, weight long")
                             .withColumn("score", F.col("weight") + noise), "resample-scored")
    able = scored.where(F.col("n_words") >= least_words)
    draw = percent * able.count() // 100
    order = ranked(able, F.desc("score"), F.asc_nulls_last("k"))
    out = order.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(
        scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("k").alias(key), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 byte by byte over a table that its polynomial gives; words are hashed once each.
SQL = rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLY}) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
texts AS (SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
          UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT side, rid, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, rid, unnest(w) AS w FROM split),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(1, length(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % {BUCKETS} AS bucket
           FROM (SELECT DISTINCT w FROM features), crc_table),
counted AS (SELECT bucket, sum((side = 's')::INT)::DOUBLE AS s, sum((side = 't')::INT)::DOUBLE AS t FROM features JOIN hashed USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + {BUCKETS})
                / ((s + 1) * ((SELECT sum(t) FROM counted) + {BUCKETS}))))::BIGINT AS g FROM counted),
weights AS (SELECT rid, sum(g) AS w FROM features JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1),
scored AS (
  SELECT rid, doc_id, len(split.w)::BIGINT AS n_features, coalesce(weights.w, 0)::BIGINT AS weight,
         (coalesce(weights.w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
                                                        / 4294967296.0))))::BIGINT AS score
  FROM split LEFT JOIN weights USING (rid) WHERE side = 's'),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
           FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (rid)
"""
