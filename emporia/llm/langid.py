"""Operator 4: language ID by multinomial naive Bayes over hashed character
n-grams.

A text is lower-cased, everything but letters becomes a space, and runs of
``1..MAX_N`` code points are hashed into ``BUCKETS`` buckets. Training counts
the buckets of every labelled row (partial counts per task, summed by Spark);
the smoothed log-probability matrix is broadcast. Its size is fixed by
``BUCKETS`` and ``MAX_LANGUAGES``: more languages than that are an error, not
a larger broadcast. Scoring treats a batch as a sparse matrix (the bucket of
each n-gram, the row of each text), gathers the matrix rows and sums them per
text. Whole texts are used; long ones pass through in slices.

Defined results: null texts and texts without a letter are ``und`` with score
0; so is everything if nothing was learned; equal scores go to the language
that sorts first; repeated rows get equal results. A row with a null id is
neither learned from nor held out. Only id, text and, to learn, the label are
read, so other columns cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

MAX_N = 4
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MAX_LANGUAGES = 256   # bound of the broadcast: BUCKETS * MAX_LANGUAGES floats
SMOOTHING = 0.1
SLICE = 500_000       # code points hashed at a time
FOLDS = 5


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


@cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], bool)


def _chars(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other characters than
    letters as one space, with a space at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]     # the first of a run of others stays, as a space
    return np.where(letter, c, np.uint32(32))[keep]


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, which positions begin n-grams, first n-gram of each piece,
    its row): texts laid end to end, each followed by what its last n-grams
    need, and cut where a slice is full."""
    parts, counts, rows, held = [], [], [], 0
    pad = np.full(MAX_N - 1, 32, np.uint32)

    def close():
        n = np.array(counts)
        valid = np.repeat(np.tile([True, False], len(n)), np.column_stack([n, np.full(len(n), MAX_N - 1)]).ravel())
        return np.concatenate(parts), valid[:len(valid) - MAX_N + 1], np.cumsum(n) - n, np.array(rows)

    for i, text in enumerate(texts):
        if text is None:
            continue
        c = _chars(text)
        if not (c != 32).any():
            continue
        for at in range(0, len(c), SLICE):
            n = min(SLICE, len(c) - at)
            parts.append(np.concatenate([c[at:at + n + MAX_N - 1], pad])[:n + MAX_N - 1])
            counts.append(n)
            rows.append(i)
            held += n
            if held >= SLICE:
                yield close()
                parts, counts, rows, held = [], [], [], 0
    if parts:
        yield close()


def _buckets(chars: np.ndarray, valid: np.ndarray) -> Iterator[np.ndarray]:
    """For each length, the buckets of the n-grams that begin at valid positions."""
    n = len(chars) - MAX_N + 1
    h = np.zeros(n, np.uint32)
    for k in range(MAX_N):
        h = (h + chars[k:k + n] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        yield ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))[valid]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        texts = b.column("t").to_pylist()
        for lang in dict.fromkeys(langs.tolist()):
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for chars, valid, _, _ in _slices([texts[i] for i in np.flatnonzero(langs == lang)]):
                for bucket in _buckets(chars, valid):
                    total += np.bincount(bucket, minlength=BUCKETS)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(total[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang",
          max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probability matrix of buckets by languages; its
    last row holds the log priors). Learns from all given rows."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("t"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages or merge labels")
    langs = sorted(r["lang"] for r in sizes)
    counts = np.zeros((BUCKETS, len(langs)))
    summed = (rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")))   # at most BUCKETS a language
    for lang_name, at, n in summed.select("lang", "c.bucket", "c.n").collect():
        counts[at, langs.index(lang_name)] = n
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    prior = np.array([{r["lang"]: r["n"] for r in sizes}[x] for x in langs], float)
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
    return langs, np.vstack([logs, np.log(prior / prior.sum())]).astype(np.float32)


def score(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its posterior probability, per text."""
    sums = np.tile(logs[BUCKETS].astype(np.float64), (len(texts), 1))
    seen = np.zeros(len(texts), bool)
    for chars, valid, starts, rows in _slices(texts):
        seen[rows] = True
        for bucket in _buckets(chars, valid):
            np.add.at(sums, rows, np.add.reduceat(logs[bucket], starts, axis=0, dtype=np.float64))
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = sums.argmax(axis=1)
    p = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return ([langs[b] if s else "und" for b, s in zip(best, seen)], [float(x) if s else 0.0 for x, s in zip(p, seen)])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shared.value
        for b in batches:
            best, p = score(b.column("t").to_pylist(), langs, logs)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(best, pa.string()), pa.array(p, pa.float64())],
                                             ["k", "lang_pred", "score"])

    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
            .mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                                       "lang_pred", "score")
