import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from emporia.llm import bpe as B
from emporia.llm import tokens as T

from .cases import CLASHING, ODD, documents
from .helpers import write

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _expected(text):
    tok = Tokenizer.from_file(BYTES)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_counts_equal_the_library(spark, tmp_path):
    write(spark, tmp_path, "documents", documents(ODD), files=3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in T.op9_token_counts(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        n = len(sp.encode(t or "", num_threads=1))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), i


def test_cuts_change_no_count():
    r, sp = random.Random(1), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count, safe = T._load(PIECES)
    assert safe
    for _ in range(300):
        text = "".join(r.choice(" ab▁é\n\t ") for _ in range(200))
        assert T.batched_lengths([text], count, safe, size=20, batch=50) == [len(sp.encode(text))]


def test_other_tokenizer_files_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "Hello there, World"), (None, None)], "doc_id long, text string")
    tok = Tokenizer.from_file(BYTES)
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df, BYTES).collect()} == {
        1: len(tok.encode("Hello there, World", add_special_tokens=False).ids), None: 0}


def test_round_trip_equals_the_library(spark, tmp_path):
    write(spark, tmp_path, "documents", documents(ODD), files=3)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op6_bpe(spark, str(tmp_path)).collect()}
    assert got == {i: _expected(t) for i, t in enumerate(ODD)}


def test_small_blocks_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, 6) for r in documents(ODD)] + [(None, "x y") + (None,) * 10] * 2, CLASHING)
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256) for r in B.round_trip(docs, BYTES, block_words=50).collect())
    want = sorted([(False, i, *_expected(t)[:2]) for i, t in enumerate(ODD)] + [(True, None, *_expected("x y")[:2])] * 2)
    assert got == want


def test_decode_is_the_library_s(spark):
    rows = [(1, [50256, 220, 50256]), (2, []), (3, [128, 129, 130, 247]), (None, [15496, 995])]
    tok = Tokenizer.from_file(BYTES)
    out = {r.doc_id: r.text for r in B.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), BYTES).collect()}
    assert out == {k: tok.decode(i, skip_special_tokens=False) for k, i in rows}


def test_code_points_are_classed_as_by_the_library(spark, tmp_path):
    points = [chr(c) for c in [*range(1, 0x3000), *range(0xA000, 0xB000), *range(0x10000, 0x12000), *range(0x1D400, 0x1E000)]]
    texts = ["".join(f"a{c}1 {c}b{c}{c}. " for c in points[i:i + 64]) for i in range(0, len(points), 64)] + ["\u0870 <|endoftext|> \u0870"]
    write(spark, tmp_path, "documents", documents(texts), files=2)
    got = {r.doc_id: r.ids_sha256 for r in B.op6_bpe(spark, str(tmp_path)).collect()}
    assert got == {i: _expected(t)[1] for i, t in enumerate(texts)}


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, "documents", [])
    assert B.op6_bpe(spark, str(tmp_path)).count() == 0 and T.op9_token_counts(spark, str(tmp_path)).count() == 0
