"""Operator 10: toxicity by a subsequence string-kernel SVM with Nystroem
landmarks.

The kernel of two words sums, over all sequences of ``ORDER`` characters that
both contain in order, ``DECAY`` to the length they span in each word: gaps and
inserted characters lower it a little instead of breaking the match. It is
normalised and raised to ``POWER`` (still a kernel); the kernel of two
sentences is the sum over their word pairs. ``LANDMARKS`` words that tell the
classes apart map a sentence to the Nystroem features, on which a linear SVM
with squared hinge loss is trained.

Labels belong to documents, sentences inherit them: from a toxic document only
its highest-scoring sentences count as toxic, chosen anew in each round. A
document's score is a logistic function of its ``TOP`` highest sentence
margins and its number of sentences, fitted on the training documents.

Because the sentence kernel is a sum, a sentence's margin is the sum of one
weight per word: a task weighs each distinct word once (a bounded cache) and
adds up. Words longer than ``LONGEST`` characters are weighed by windows, the
highest counts; runs of four or more single characters are also read as one
word. Texts are scored whole.

Training uses at most ``SAMPLE`` labelled documents of each class (those whose
ids hash lowest, none above ``TRAIN_CHARS`` characters); the sample is the only
thing collected, and it is bounded.

Defined results: null and empty texts have no sentence and get the score of a
sentence without words; without labels of both classes every score is 0;
conflicting labels of one document count as toxic; repeated rows score alike.
A row with a null id is neither learned from nor held out. Only id and text
(and the labels to learn) are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

ORDER = 3
DECAY = 0.7
POWER = 3
LANDMARKS = 64
LONGEST = 24
SAMPLE = 1500
TRAIN_CHARS = 20_000
ROUNDS = 4
TOP = 3             # highest sentences of a document that decide
PENALTY = 1e-3
FOLDS = 5
CACHE = 400_000     # distinct words that a task keeps weighed
CHUNK = 1 << 19     # subsequences looked up at a time

_SENTENCE = re.compile(r"[.!?\n]+\s+|\n+")
_SPELLED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—¿¡"


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence of a whole text, in lower case; words spelled out
    letter by letter (``a b c d``) are added joined."""
    text = (text or "").lower()
    spelled = _SPELLED.search(text) is not None
    out = []
    for s in _SENTENCE.split(text):
        ws = s.split()
        if ws:
            if spelled:
                ws += [x.group().replace(" ", "") for x in _SPELLED.finditer(s)]
            out.append(ws)
    return out


def bare(word: str) -> str:
    """A word without the marks at its edges."""
    return word.strip(_EDGES)


@cache
def _choices(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of a word of this length, and the decay to
    the length that each spans."""
    at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1).astype(np.float64)


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, decays) of words of one length: one row per word; a key packs the
    code points of a subsequence."""
    at, decay = _choices(len(words[0]))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = codes.reshape(len(words), -1)
    keys = np.zeros((len(words), len(at)), np.uint64)
    for k in range(ORDER):
        keys = (keys << np.uint64(21)) | codes[:, at[:, k]]
    return keys, decay


def _norms(words: list[str]) -> np.ndarray:
    """Kernel of each word (all of one length) with itself, by the usual
    recurrence over pairs of prefixes."""
    n, size = len(words), len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T
    match = (codes[:, None] == codes[None]) * DECAY ** 2
    prime = [np.ones((size + 1, n))] + [np.zeros((size + 1, n)) for _ in range(ORDER - 1)]
    total = np.zeros(n)
    for i in range(size):
        total += (match[i] * prime[ORDER - 1][:-1]).sum(axis=0)
        for p in range(ORDER - 1, 0, -1):
            step = match[i] * prime[p - 1][:-1]
            run = np.zeros(n)
            for j in range(size):
                run = DECAY * run + step[j]
                prime[p][j + 1] = DECAY * prime[p][j + 1] + run
    return total


class Kernel:
    """Normalised kernel of words with a fixed set of landmark words.

    The landmarks' subsequences are a sparse table; a word's subsequences are
    looked up in it, so only shared ones cost more than a bit test."""

    _BITS = 18

    def __init__(self, landmarks: list[str], power: int = POWER):
        self.landmarks, self.power = landmarks, power
        keys, values, cols, own = [], [], [], []
        for i, w in enumerate(landmarks):
            k, decay = _subsequences([w])
            keys.append(k[0])
            values.append(decay)
            cols.append(np.full(len(decay), i))
            own.append(_norms([w])[0])
        keys, cols = np.concatenate(keys), np.concatenate(cols)
        values = np.concatenate(values) / np.sqrt(np.array(own))[cols]
        order = np.argsort(keys, kind="stable")
        self.cols, self.values = cols[order], values[order]
        self.keys, self.starts, self.sizes = np.unique(keys[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << self._BITS, bool)
        self.maybe[self._bit(self.keys)] = True

    def _bit(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def features(self, words: list[str]) -> np.ndarray:
        """(words, landmarks); zero for words shorter than the order."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                by_size.setdefault(len(w), []).append(i)
        for size, all_ in by_size.items():
            step = max(1, min(4096, CHUNK // len(_choices(size)[0])))
            for at in range(0, len(all_), step):
                idx = np.array(all_[at:at + step])
                keys, decay = _subsequences([words[i] for i in idx])
                row, col = np.nonzero(self.maybe[self._bit(keys)])
                place = np.minimum(np.searchsorted(self.keys, keys[row, col]), len(self.keys) - 1)
                hit = self.keys[place] == keys[row, col]
                row, col, place = row[hit], col[hit], place[hit]
                if not len(row):
                    continue
                # every landmark that has the subsequence gets its share
                many = self.sizes[place]
                ends = np.cumsum(many)
                entry = np.repeat(self.starts[place] - (ends - many), many) + np.arange(ends[-1])
                m = len(self.landmarks)
                k = np.bincount(np.repeat(row * m, many) + self.cols[entry], self.values[entry] * np.repeat(decay[col], many),
                                minlength=len(idx) * m).reshape(len(idx), m)
                met = np.unique(row)
                own = _norms([words[i] for i in idx[met]])
                out[idx[met]] = (k[met] / np.sqrt(own)[:, None]) ** self.power
        return out


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Model:
    """Weights of words; picklable, a few kilobytes."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, final: np.ndarray):
        self.kernel, self.weights, self.bias, self.final = Kernel(landmarks), weights, bias, final

    def weigh(self, words: list[str]) -> list[float]:
        parts = [_windows(w) for w in words]
        flat = self.kernel.features([p for x in parts for p in x]) @ self.weights
        starts = np.cumsum([0, *(len(x) for x in parts)])[:-1]
        return np.maximum.reduceat(flat, starts).tolist() if words else []

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.final[:-1] + self.final[-1], -500, 500)))


def pick_landmarks(docs: list[list[list[str]]], toxic: np.ndarray, count: int = LANDMARKS) -> list[str]:
    """Words whose presence tells the classes apart best, without near repeats."""
    pos, neg = Counter(), Counter()
    for d, t in zip(docs, toxic):
        (pos if t else neg).update(w for w in {bare(w) for s in d for w in s} if ORDER <= len(w) <= LONGEST)
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    gain = {w: abs(pos[w] / n_pos - neg[w] / n_neg) / np.sqrt((pos[w] + neg[w]) / (n_pos + n_neg) + 1e-9)
            for w in pos.keys() | neg.keys() if pos[w] + neg[w] >= 3}
    order = sorted(gain, key=lambda w: (-gain[w], w))[:count * 8]
    chosen: list[str] = []
    if not order:
        return chosen
    like = Kernel(order, 1).features(order)
    at = []
    for i in range(len(order)):
        if len(at) < count and (not at or like[i, at].max() < 0.7):
            at.append(i)
    return [order[i] for i in at]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ridge = np.full(x.shape[1], penalty * weight.sum())
    ridge[-1] = 1e-9 * weight.sum()
    for _ in range(30):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge * w - (x[on] * (weight[on] * y[on] * gap[on])[:, None]).sum(axis=0)
        hess = (x[on] * weight[on, None]).T @ x[on] + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: list[bool]) -> Model | None:
    """The model of labelled documents; None without both classes."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    docs = [sentences(t) for t in texts]
    landmarks = pick_landmarks(docs, y)
    if not landmarks:
        return None
    vocab = sorted({w for d in docs for s in d for w in s})
    where = {w: i for i, w in enumerate(vocab)}
    parts = [_windows(bare(w)) for w in vocab]
    words = Kernel(landmarks).features([p for x in parts for p in x])
    if len(words) > len(vocab):
        words = np.maximum.reduceat(words, np.cumsum([0, *(len(x) for x in parts)])[:-1], axis=0)
    gram = Kernel(landmarks).features(landmarks).astype(np.float64)
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T     # Nystroem map
    rows, owner = [], []
    for i, d in enumerate(docs):
        for s in d:
            rows.append(words[[where[w] for w in s]].sum(axis=0))
            owner.append(i)
    x = np.column_stack([np.array(rows, np.float64) @ root, np.ones(len(rows))])
    owner = np.array(owner)
    from_toxic = y[owner]
    w, use = None, np.ones(len(owner), bool)
    for _ in range(ROUNDS):
        label = np.where(from_toxic, 1.0, -1.0)[use]
        share = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label < 0).sum())) * len(label)
        w = _svm(x[use], label, share, PENALTY, w)
        margin = x @ w
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, owner, margin)
        use = ~from_toxic | (margin >= np.minimum(top[owner], 0.5))
    by_doc = np.split(x @ w, np.cumsum(np.bincount(owner, minlength=len(docs)))[:-1])
    final = _logistic(np.array([_document(m, w[-1]) for m in by_doc]), y.astype(float))
    return Model(landmarks, root @ w[:-1], float(w[-1]), final)


def _document(margins: np.ndarray, bias: float) -> np.ndarray:
    """Features of a document: its highest sentence margins and how many
    sentences they were picked from."""
    top = np.full(TOP, bias)
    best = np.sort(margins)[::-1][:TOP]
    top[:len(best)] = best
    return np.append(np.clip(top, -3, 3), np.log1p(len(margins)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, longest: int = TRAIN_CHARS) -> Model | None:
    """Fit on a bounded sample of the labelled documents that are given."""
    lab = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k"))
           .agg(F.max(label).alias("_toxic")).withColumn("_toxic", F.col("_toxic") == 1))
    lab = lab.select("_k", "_toxic", F.xxhash64("_k").alias("_o"))
    # twice as many ids as documents, as some labelled ids are long or absent; at most 4 * sample rows
    ids = None
    for kind in (True, False):
        part = lab.where(F.col("_toxic") == kind).orderBy("_o", "_k").limit(2 * sample)
        ids = part if ids is None else ids.union(part)
    rows = (docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
            .where(F.col("_t").isNotNull() & (F.length("_t") <= longest)).join(F.broadcast(ids), "_k"))
    picked = None
    for kind in (True, False):
        part = rows.where(F.col("_toxic") == kind).orderBy("_o", "_k", "_t").limit(sample).select("_t", "_toxic")
        picked = part if picked is None else picked.union(part)
    got = picked.collect()
    return fit([r[0] for r in got], [r[1] for r in got])


def score_texts(texts: list[str | None], model: Model | None, known: dict[str, float]) -> np.ndarray:
    """Scores of whole texts; ``known`` caches word weights across calls."""
    if model is None:
        return np.zeros(len(texts))
    docs = [sentences(t) for t in texts]
    new = {w for d in docs for s in d for w in s if w not in known}
    if len(known) + len(new) > CACHE:
        known.clear()
        new = {w for d in docs for s in d for w in s}
    forms = list({bare(w) for w in new}.difference(known))
    known.update(zip(forms, model.weigh(forms)))
    for w in new:
        known[w] = known[bare(w)]
    weight = known.__getitem__
    margins = [np.array([model.bias + sum(map(weight, s)) for s in d]) for d in docs]
    return model.probability(np.array([_document(m, model.bias) for m in margins]).reshape(len(texts), TOP + 1))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(score_texts(b.column("t").to_pylist(), shared.value, known))],
                                             ["k", "score"])

    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double")
            .withColumnRenamed("k", key))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
