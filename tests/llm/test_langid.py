import zlib

import numpy as np
import pytest

from emporia.llm import langid as G

from .cases import CLASHING, ODD, documents
from .helpers import write

SF01 = "/root/testdata/sf0.01"


def brute_counts(texts):
    """Bucket counts by plain loops."""
    out = {}
    for t in texts:
        s = G._chars(t).tolist()
        if all(c == 32 for c in s):
            continue
        s += [32] * (G.MAX_N - 1)
        for i in range(len(s) - G.MAX_N + 1):
            h = 0
            for k in range(G.MAX_N):
                h = (h + s[i + k] + k + 1) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
                b = (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - G.BUCKET_BITS)
                out[b] = out.get(b, 0) + 1
    return out


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = {r.doc_id: r for r in G.op4_language_id(spark, SF01).collect()}
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert sum(held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_model_equals_plain_loops(spark):
    rows = [("en", "The cat and the dog"), ("de", "Der Hund und die Katze"), ("en", "a dog"), (None, "x"), ("de", None), ("en", "12")]
    langs, logs = G.train(spark.createDataFrame(rows, "lang string, text string"))
    assert langs == ["de", "en"]
    for j, x in enumerate(langs):
        counts = brute_counts([t for a, t in rows if a == x and t])
        total = sum(counts.values()) + G.SMOOTHING * G.BUCKETS
        for b in [*counts, 0, 1]:
            assert logs[b, j] == pytest.approx(np.log((counts.get(b, 0) + G.SMOOTHING) / total), abs=1e-5)
        assert logs[G.BUCKETS, j] == pytest.approx(np.log([1, 3][j] / 4), abs=1e-5)


def test_slices_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(0)
    logs = np.log(rng.random((G.BUCKETS + 1, 3))).astype(np.float32)
    texts = [t for t in ODD if t is None or len(t) < 20_000]
    whole = G.score(texts, ["a", "b", "c"], logs)
    monkeypatch.setattr(G, "SLICE", 37)
    cut = G.score(texts, ["a", "b", "c"], logs)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])
    assert [x for x, t in zip(whole[0], texts) if not any(c.isalpha() for c in t or "")] == \
        ["und"] * sum(not any(c.isalpha() for c in t or "") for t in texts)


def test_odd_rows_and_nothing_learned(spark, tmp_path):
    write(spark, tmp_path, "documents", [(*r, 1, "t", 2, 3, 4, 5, 6) for r in documents(ODD)] + [(None, "abc") + (None,) * 10], CLASHING)
    rows = G.op4_language_id(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) + 1 and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    write(spark, tmp_path / "n", "documents", [(1, "some text", None), (2, None, "en")])
    assert {(r.lang_pred, r.score) for r in G.op4_language_id(spark, str(tmp_path / "n")).collect()} == {("und", 0.0)}
    write(spark, tmp_path / "e", "documents", [])
    assert G.op4_language_id(spark, str(tmp_path / "e")).count() == 0


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(f"l{i}", "text") for i in range(5)], "lang string, text string")
    with pytest.raises(ValueError):
        G.train(df, max_languages=4)
