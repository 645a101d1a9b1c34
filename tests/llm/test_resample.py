import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emporia.llm import resample as R

from .cases import CLASHING, ODD, documents, prose
from .helpers import same, write

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_runs(text, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20):
    """doc_id -> (n_features, weight, score, rank); one row per id."""
    of = {k: [h % buckets for h in brute_runs(t, n)] for k, t in docs}
    s, t = Counter(b for x in of.values() for b in x), Counter(h % buckets for x in target for h in brute_runs(x, n))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = {}
    for k, text in docs:
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, of[k]))
        out[k] = [len(of[k]), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((k for k, text in docs if len(words(text)) >= least), key=lambda k: (-out[k][2], k))
    for i, k in enumerate(able[:percent * len(able) // 100]):
        out[k][3] = i + 1
    return {k: tuple(v) for k, v in out.items()}


TEXTS = ODD + [prose(s, 30 + s) for s in range(40)] + [prose(3, 33)] * 3
TARGET = ["A question of w1x1, w2x2 and w3x3?", None, "", prose(1, 50)]


def test_query_equals_sql_and_brute_force(spark, tmp_path):
    write(spark, tmp_path, "documents", documents(TEXTS), files=3)
    write(spark, tmp_path, "benchmark", list(enumerate(TARGET)))
    got = same(R.op11_importance_resampling, R.SQL, spark, tmp_path)
    names = ["doc_id", "n_features", "rank", "score", "weight"]
    ours = {r[0]: dict(zip(names, r)) for r in got}
    want = brute(list(enumerate(TEXTS)), TARGET)
    assert {k: (v["n_features"], v["weight"], v["score"], v["rank"]) for k, v in ours.items()} == want
    assert sum(v[3] is not None for v in want.values()) == len([t for t in TEXTS if len(words(t)) >= 20]) // 10


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_longer_runs_and_any_dictionary_give_the_same(spark, most):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = R.resample(docs, target, ngrams=3, buckets=97, percent=50, least_words=2, most=most)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == brute(list(enumerate(TEXTS)), TARGET, 3, 97, 50, 2)


@given(st.text("aB9é日🙂 .-_Z\n\x7f\x00", max_size=60), st.integers(1, 4), st.integers(1, 40), st.randoms())
@settings(max_examples=200, deadline=None)
def test_payloads_compose_to_the_crc_of_the_joined_words(text, n, segment, r):
    known = R.automaton([w for w in sorted(set(words(text))) if r.random() < 0.5])
    crc, length = R.payloads(text, known, segment)
    assert length.tolist() == [len(w.encode()) for w in words(text)]
    assert R.run_hashes(crc, length, n).tolist() == brute_runs(text, n)


def test_compose_moves_over_long_strings():
    r = random.Random(0)
    a, b = r.randbytes(70), r.randbytes(200_001)
    got = R.compose(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


def test_null_keys_repeated_rows_clashing_names_and_empty_tables(spark, tmp_path):
    long = prose(5, 40)
    rows = [(1, long), (1, long), (None, long), (None, None), (2, prose(6, 40))]
    docs = spark.createDataFrame([(*r, None, None, None, 1, "t", 2, 3, 4, 5, 6) for r in rows], CLASHING)
    got = R.resample(docs, docs.select("text", "k"), percent=100)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted(got.collect(), key=lambda r: (r.rank is None, r.rank))
    assert [r.rank for r in rows] == [1, 2, 3, 4, None]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    write(spark, tmp_path, "documents", [])
    write(spark, tmp_path, "benchmark", [])
    assert R.op11_importance_resampling(spark, str(tmp_path)).count() == 0


def test_rank_is_spread_over_partitions(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("v"), "id")
    got = [(r.v, r.id, r["rank"]) for r in R.ranked(rows, F.desc("v"), F.asc("id")).collect()]
    want = sorted(((v, i) for v, i, _ in got), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(v, i, n + 1) for n, (v, i) in enumerate(want)]


def test_session_settings_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    R.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).count()
    assert spark.conf.get(key) == before
