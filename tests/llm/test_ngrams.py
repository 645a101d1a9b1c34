import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emporia.llm import ngrams as N
from emporia.llm.common import connected_components

from .cases import CLASHING, ODD, Groups, documents, edited, prose
from .helpers import same, write


def brute_sets(texts, size=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out.append({" ".join(w[i:i + size]) for i in range(len(w) - size + 1)} or ({" ".join(w)} if w else set()))
    return out


def brute(texts, least=85):
    """doc number -> (n_shingles, component)."""
    sets, g = brute_sets(texts), Groups(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                g.join(i, j)
    return {i: (len(s), g.find(i)) for i, s in enumerate(sets)}


#: families of near copies, chains in which only neighbours link, copies, a passage that unlike texts share, short texts.
FAMILIES = [edited(prose(s, 120), 50 * s + c, c % 4) for s in range(8) for c in range(5)]
CHAIN = [prose(77, 400)]
for _i in range(12):
    CHAIN.append(edited(CHAIN[-1], _i, 5))
PASSAGE = [prose(200 + s, 60) + " " + prose(99, 60) for s in range(10)]
SHORT = ["one", "One", "one two", "one two three", "one  two\tthree", "one two three four", "one two three four", "a b c d e f g", "a b c d e f h"]
TEXTS = ODD + FAMILIES + CHAIN + PASSAGE + SHORT + [FAMILIES[0]] * 3


def test_query_equals_sql_and_brute_force(spark, tmp_path):
    write(spark, tmp_path, "documents", documents(TEXTS), files=3)
    got = same(N.op12_ngram_jaccard_join, N.SQL, spark, tmp_path)
    want = brute(TEXTS)
    assert {(c, d, n) for c, d, n in got} == {(c, i, n) for i, (n, c) in want.items()}
    assert max(np.bincount([c for _, c in want.values()])) == len(CHAIN)


@pytest.mark.parametrize("options", [{"tile": 3, "queries": 1, "rounds": 2}, {"tile": 2, "queries": 3, "rounds": 0},
                                     {"tile_shingles": 500}])
def test_blocks_dealt_out_in_tiles_lose_no_link(spark, options):
    texts = FAMILIES + CHAIN + PASSAGE + [edited(CHAIN[0], 1000 + c, 3) for c in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(docs, **options).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("least,extra", [(60, 30), (95, 0), (100, 10)])
def test_other_thresholds(spark, least, extra):
    texts = FAMILIES[:20] + CHAIN + SHORT
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(docs, least=least, extra=extra).collect()}
    assert got == brute(texts, least)


@given(st.integers(0, 10 ** 9), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_search_finds_every_set_with_the_required_overlap(seed, least_common):
    r = random.Random(seed)
    common = r.sample(range(10 ** 6), 30)
    sets = [np.unique(np.array(r.sample(common, r.randint(0, 30)) + r.sample(range(60), r.randint(1, 40)), np.int64)) for _ in range(25)]
    lists = N.Lists(sets, np.array([len(s) for s in sets]))
    query = sets[r.randrange(25)]
    found, counts = lists.search(query, least_common)
    want = {i: len(np.intersect1d(query, s)) for i, s in enumerate(sets)}
    assert dict(zip(found.tolist(), counts.tolist())) == {i: c for i, c in want.items() if c >= least_common}


@given(st.lists(st.lists(st.integers(0, 60), min_size=20, max_size=40, unique=True), min_size=2, max_size=25), st.sampled_from([60, 75, 85]))
@settings(max_examples=100, deadline=None)
def test_one_block_connects_what_is_connected(sets, least):
    group = pa.table({"gid": pa.array(range(len(sets)), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                      "shingles": pa.array(sets, pa.list_(pa.int64()))})
    ours, want = Groups(range(len(sets))), Groups(range(len(sets)))
    out = N._search_block(least)(group)
    for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()):
        ours.join(a, b)
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(set(a) & set(sets[j])) >= least * len(set(a) | set(sets[j])):
                want.join(i, j)
    assert ours.sets() == want.sets()


def test_a_family_costs_few_queries(spark):
    """Links of a family of m near copies are of the order of m, not m squared."""
    base = prose(5, 300)
    docs = spark.createDataFrame([(i, edited(base, i, 3)) for i in range(300)], "doc_id long, text string").repartition(4)
    read = docs.selectExpr("doc_id AS k", "xxhash64(text) AS th", "text")
    rows = read.mapInArrow(N._signature(4, 85, 10), "k long, th long, sa long, sb long, n long, prefix array<long>")
    reps = rows.selectExpr("*", "k AS gid")
    kept = N.survivors(read, reps, 4, 85, 10)
    out = N.links(kept, N.blocks(kept, 85), tile=64)
    assert 299 <= out.count() <= 16 * 300
    assert len({r.root for r in connected_components(out).collect()}) == 1


def test_null_ids_repeated_rows_clashing_names_and_empty_table(spark, tmp_path):
    long = prose(1, 90)
    rows = [(5, long), (5, long), (3, edited(long, 1)), (None, long), (None, "only here x y z"), (None, None), (8, ""), (8, " ")]
    docs = spark.createDataFrame([(*r, None, None, None, 1, "t", 2, 3, 4, 5, 6) for r in rows], CLASHING)
    got = N.components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    n = len(brute_sets([long])[0])
    m = len(brute_sets([edited(long, 1)])[0])
    want = [(5, n, 3), (5, n, 3), (3, m, 3), (None, n, 3), (None, 2, None), (None, 0, None), (8, 0, 8), (8, 0, 8)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    write(spark, tmp_path, "documents", [])
    assert N.op12_ngram_jaccard_join(spark, str(tmp_path)).count() == 0
