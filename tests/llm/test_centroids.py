import hashlib
import math

import numpy as np
import pytest

from emporia.llm import centroids as C

from .helpers import same, write

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.15, dims)], 0) for i in range(n)]


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """vec_id -> (cluster, distance), inertia per cluster, centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cent = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        held = [[] for _ in cent]
        for _, v in kept:
            held[near(v)[1]].append(v)
        cent = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, cent)]
    return {i: near(v)[::-1] for i, v in kept}, cent


ROWS = vectors(300) + [(300 + i, v, 0) for i, (_, v, _) in enumerate(vectors(20))] + [
    (900, None, 0), (901, [], 0), (902, [0.5] * 63, 0), (903, [0.5] * 65, 0), (904, [0.5] * 63 + [None], 0),
    (905, [0.5] * 63 + [float("nan")], 0), (906, [float("-inf")] + [0.5] * 63, 0), (907, [-0.0] * 64, 0), (908, [1000.0] * 64, 0)]


def test_query_equals_sql_and_brute_force(spark, tmp_path):
    write(spark, tmp_path, "embeddings", ROWS, SCHEMA, files=3)
    got = same(C.op13_centroid_clustering, C.SQL, spark, tmp_path)
    of, cent = brute(ROWS)
    inertia = {c: sum(d for x, d in of.values() if x == c) for c, _ in of.values()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    want = {(digest[c], c, inertia[c], d, sum(inertia.values()), i) for i, (c, d) in of.items()}
    assert set(got) == want


@pytest.mark.parametrize("width,chunk", [(1, 7), (3, 50), (64, 16_384), (2, 70_000)])
def test_any_blocks_and_chunks_give_the_same(spark, width, chunk):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got, cent = C.cluster(docs, width=width, chunk=chunk)
    of, want = brute(ROWS)
    assert {r.vec_id: (r.cluster, r.distance) for r in got.collect()} == of
    assert cent.tolist() == want


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(1)
    for w in (1, 2, 5):
        block = rng.integers(-3, 3, (400, w)).astype(np.int32)
        entries, code = C.block_dictionary(block)
        assert len(entries) == len(np.unique(block, axis=0))
        assert (entries[code] == block).all()


def test_ties_repeats_few_vectors_null_ids_and_clashing_names(spark, tmp_path):
    v = [0.5] * 64
    schema = "vec_id long, embedding array<float>, label int, cluster string, k string, v int, ids int, distance string"
    rows = [(7, v, 0), (7, v, 0), (None, v, 0), (8, [0.25] * 64, 0)]
    docs = spark.createDataFrame([(*r, "c", "k", 1, 2, "d") for r in rows], schema)
    got, cent = C.cluster(docs)
    assert len(cent) == 3      # two rows of 7 and one of 8; a null id starts nothing
    assert sorted((r.vec_id is None, r.vec_id, r.distance) for r in got.collect()) == [(False, 7, 0), (False, 7, 0), (False, 8, 0), (True, None, 0)]
    assert len({r.cluster for r in got.collect() if r.vec_id != 8}) == 1      # equal centroids: the smaller number
    write(spark, tmp_path, "embeddings", [], SCHEMA)
    out = C.op13_centroid_clustering(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_a_component_too_large_for_exact_distances_is_named(spark):
    docs = spark.createDataFrame([(1, [3.0e7] + [0.0] * 63, 0)], SCHEMA)
    with pytest.raises(Exception, match="30000000.0 is too large"):
        C.cluster(docs)
