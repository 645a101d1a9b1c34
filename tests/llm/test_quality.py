import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from emporia.llm import quality as Q

from .cases import CLASHING, ODD, documents, prose
from .helpers import same, write


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


TEXTS = ODD + ["a b c a b c", "a b c d a b c", "a a a a a", "x y\nx y\n x y\nz # | *", "p q r s\n" * 40, prose(1, 80), prose(2, 200)]


def test_counts_equal_brute_force(spark, tmp_path):
    write(spark, tmp_path, "documents", documents(TEXTS))
    write(spark, tmp_path, "labels", [])
    got = {r.doc_id: r for r in Q.op8_quality_rules(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)          # no labels: nothing is certified


def _corpus(n):
    """Good prose, and bad documents full of symbols; ten good ones have some."""
    good = [prose(i, 60, 5000) for i in range(n)]
    bad = [" ".join(w + " %%" for w in prose(10 ** 6 + i, 60, 5000).split()) for i in range(n // 4)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good + bad)]
    labels = [(i, 1, 0) for i in range(n)] + [(n + i, 0, 0) for i in range(n // 4)]
    return rows, labels


def test_certified_cutoffs_equal_sql(spark, tmp_path):
    rows, labels = _corpus(1600)
    labels += [(None, 1, 0), (3, None, 1), (5, 0, 0), (10 ** 9, 0, 1)]     # nulls, a conflict, an unknown id
    write(spark, tmp_path, "documents", rows + [(None, "x " * 60, None, None, None)])
    write(spark, tmp_path, "labels", labels)
    got = same(Q.op8_quality_rules, Q.SQL, spark, tmp_path)
    names = sorted(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    kept = {r[names.index("doc_id")]: r[names.index("kept")] for r in got}
    assert all(kept[i] for i in range(1600)) and not any(kept[1600 + i] for i in range(400))


def test_too_few_labels_certify_nothing(spark, tmp_path):
    rows, labels = _corpus(100)
    write(spark, tmp_path, "documents", rows)
    write(spark, tmp_path, "labels", labels)
    assert all(r[names_kept] for r in same(Q.op8_quality_rules, Q.SQL, spark, tmp_path) for names_kept in (2,))


@pytest.mark.parametrize("k,n,p", [(0, 10, .3), (3, 50, .1), (40, 2000, .01), (7, 7, .5), (0, 0, .2)])
def test_binomial_tail_is_exact(spark, k, n, p):
    got = spark.range(1).select(Q.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), F.lit(p))).first()[0]
    want = math.log(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert got == pytest.approx(want, abs=1e-9)


def test_stage_keeps_columns_and_agrees_with_the_query(spark, tmp_path):
    rows, labels = _corpus(1600)
    write(spark, tmp_path, "labels", labels)
    docs = [(*r, 1, "t", 2, 3, 4, 5, 6) for r in rows + [(9999, None, None, None, None)]]
    write(spark, tmp_path, "documents", docs, CLASHING)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = Q.judge(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert out.columns == df.columns
    want = sorted(r.doc_id for r in Q.op8_quality_rules(spark, str(tmp_path)).collect() if r.kept)
    assert sorted(r.doc_id for r in out.collect()) == want


def test_empty_tables_and_given_table(spark, tmp_path):
    write(spark, tmp_path, "documents", [])
    write(spark, tmp_path, "labels", [])
    assert Q.op8_quality_rules(spark, str(tmp_path)).count() == 0
    same(Q.op8_quality_rules, Q.SQL, spark, "/root/testdata/sf0.001")
