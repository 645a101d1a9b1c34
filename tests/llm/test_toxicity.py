import collections
import itertools
import zlib

import numpy as np
import pytest

from emporia.llm import toxicity as X

from .cases import CLASHING, ODD, documents, prose
from .helpers import write


def brute(a, b):
    """The kernel by enumerating all subsequences."""
    def weights(w):
        out = collections.defaultdict(float)
        for ix in itertools.combinations(range(len(w)), X.ORDER):
            out["".join(w[i] for i in ix)] += X.DECAY ** (ix[-1] - ix[0] + 1)
        return out
    x, y = weights(a), weights(b)
    return sum(v * y[u] for u, v in x.items() if u in y)


@pytest.mark.parametrize("a,b", [("idiot", "id.iot"), ("clown", "cl0wn"), ("banana", "ananas"), ("abc", "abc"), ("ab", "abc"),
                                 ("aaaaa", "aaa"), ("xyz", "abc"), ("größe", "grösse")])
def test_kernel_equals_enumeration(a, b):
    want = brute(a, b) / max(1e-12, (brute(a, a) * brute(b, b)) ** 0.5)
    assert X.Kernel([b], 1).features([a])[0, 0] == pytest.approx(want, abs=1e-9)


def test_gapped_and_inserted_insults_stay_near():
    k = X.Kernel(["worthless"], 1).features(["wor.thless", "w-orth-less", "worxthless", "harmless", "the"])[:, 0]
    assert min(k[:3]) > 0.5 > k[3] > k[4]


def _corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        text = ". ".join(prose(seed * 10 ** 6 + i * 20 + s, 12) for s in range(6))
        toxic = i % 4 == 0
        if toxic:
            ws = text.split(" ")
            for w in rng.choice(["moron", "scumbag", "worthless"], 3):
                ws.insert(int(rng.integers(len(ws))), str(w))
            text = " ".join(ws)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_obfuscation(spark, tmp_path):
    rows, labels = _corpus(400)
    extra = [(1000, prose(1, 30) + " you mor.on and wo-rthless s.cumbag. " + prose(2, 30)), (1001, prose(3, 60)), (1002, None), (1003, "")]
    write(spark, tmp_path, "documents", rows + extra, files=2)
    write(spark, tmp_path, "labels", labels + [(None, 1, 1), (7, 1, None), (10 ** 9, 1, 1)])
    got = {r.doc_id: r for r in X.op10_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    held = [got[i].predicted == t for i, _, t in labels if got[i].held_out]
    assert sum(held) >= 0.95 * len(held)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1003].score < 0.5


def test_labels_of_held_out_rows_are_not_learned(spark, tmp_path):
    rows, labels = _corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    out = []
    for name, lab in (("a", labels), ("b", flipped)):
        write(spark, tmp_path / name, "documents", rows)
        write(spark, tmp_path / name, "labels", lab)
        out.append(sorted((r.doc_id, r.score) for r in X.op10_toxicity(spark, str(tmp_path / name)).collect()))
    assert out[0] == out[1]


def test_odd_rows_one_class_and_empty(spark, tmp_path):
    write(spark, tmp_path, "documents", [(*r, 1, "t", 2, 3, 4, 5, 6) for r in documents(ODD)] + [(None, "abc") + (None,) * 10], CLASHING)
    write(spark, tmp_path, "labels", [(1, 1, 0), (2, 1, 0)])
    assert {r.score for r in X.op10_toxicity(spark, str(tmp_path)).collect()} == {0.0}
    rows, labels = _corpus(60)
    model = X.fit([r[1] for r in rows], [t == 1 for _, _, t in labels])
    s = X.score_texts(ODD, model, {})
    assert len(s) == len(ODD) and np.isfinite(s).all() and ((0 <= s) & (s <= 1)).all()
    again = X.score_texts(ODD[::-1], model, {})[::-1]
    assert np.allclose(s, again)
    write(spark, tmp_path / "e", "documents", [])
    write(spark, tmp_path / "e", "labels", [])
    assert X.op10_toxicity(spark, str(tmp_path / "e")).count() == 0


def test_spelled_out_words_are_joined():
    assert X.sentences("you m o r o n now")[0][-1] == "moron"
    assert X.sentences(None) == [] and X.sentences(" \n\n") == []
