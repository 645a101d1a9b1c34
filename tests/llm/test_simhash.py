import re

import numpy as np
import pytest
import xxhash

from emporia.llm import simhash as S
from emporia.llm.common import connected_components

from .cases import CLASHING, ODD, Groups, documents, edited, prose
from .helpers import write


def brute_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    g = Groups(range(len(prints)))
    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 4):
            g.join(i, i + 1 + int(j))
    return [g.find(i) for i in range(len(a))]


TEXTS = ODD + [edited(prose(s, 300), 50 * s + c, c % 3) for s in range(12) for c in range(5)]


def test_query_equals_brute_force(spark, tmp_path):
    write(spark, tmp_path, "documents", documents(TEXTS), files=3)
    got = {r.doc_id: r for r in S.op2_simhash_near_dedup(spark, str(tmp_path)).collect()}
    prints = [brute_fingerprint(t) for t in TEXTS]
    assert [got[i].fingerprint for i in range(len(TEXTS))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(TEXTS))] == brute_components(prints)
    assert S.op2_simhash_near_dedup(spark, str(tmp_path)).columns[:3] == ["doc_id", "fingerprint", "component_id"]


def test_deduplicate_keeps_one_of_each(spark, tmp_path):
    rows = documents(TEXTS)
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, 6) for r in rows + rows[:3] + [(None, TEXTS[-1], None, None, None)]], CLASHING)
    out = S.deduplicate(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(brute_components([brute_fingerprint(t) for t in TEXTS])))
    assert kept.count(None) == 1      # rows without a key stay


def test_null_ids_and_empty_table(spark, tmp_path):
    write(spark, tmp_path / "n", "documents", [(None, "a b c d e"), (7, "a b c d e"), (None, "only here x y z")])
    got = {(r.doc_id, r.component_id) for r in S.op2_simhash_near_dedup(spark, str(tmp_path / "n")).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}
    write(spark, tmp_path / "e", "documents", [])
    assert S.op2_simhash_near_dedup(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("group", [40, 10_000])
def test_factored_groups_lose_no_link(spark, group):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 120, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    f = np.unique(np.concatenate([base, *[base ^ flip() ^ flip() for _ in range(6)], np.arange(1500, dtype=np.uint64)]))
    links = S.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), group=group)
    root = {r.node: r.root for r in connected_components(links).collect()}
    ours = {}
    for i, x in enumerate(f.view(np.int64).tolist()):
        ours.setdefault(root.get(x, x), []).append(i)
    want = {}
    for i, r in enumerate(brute_components(f.tolist())):
        want.setdefault(r, []).append(i)
    assert sorted(ours.values()) == sorted(want.values())


def test_gray_rank_orders_neighbours():
    order = sorted(range(16), key=lambda x: int(S.gray_rank(np.array([x], np.uint64))[0]))
    assert all(bin(a ^ b).count("1") == 1 for a, b in zip(order, order[1:]))
