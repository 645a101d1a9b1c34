"""Operator 9: token counts by batch encoding in Arrow functions.

Only lengths leave the Python workers. Texts are cut into segments of about
``SEGMENT`` characters at boundaries that no token crosses, and segments are
gathered into batches of about ``BATCH`` characters, so a batch costs the same
whether it holds many short texts or a slice of a very long one.

A cut is safe in front of a single space between two characters that are not
spaces: no piece of the vocabulary has a word mark after another character
(checked when a model is loaded; texts stay whole for a model that fails the
check), and the mark that the model puts before a text stands for the space.

Defined results: null counts as the empty text (0 bytes, 0 tokens); every row
is counted, repeated ones too; columns besides the key and the text are not
read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

SEGMENT = 16_384
BATCH = 262_144
LIMIT = 4096
MARK = "▁"

_COUNTERS: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Cut at safe boundaries; the single space at a cut is dropped (the mark
    before the next segment replaces it)."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        cut = text.find(" ", start + size)
        while cut != -1 and (cut + 1 == n or text[cut - 1] in (" ", MARK) or text[cut + 1] in (" ", MARK)):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        out.append(text[start:cut])
        start = cut + 1
    out.append(text[start:])
    return out


def _load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(counter of a list of texts, whether texts may be cut); once a worker."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            safe = (not any(MARK in p.lstrip(MARK) for p in pieces)
                    and sp.encode("a  a b", out_type=str)[:1] == [MARK + "a"]
                    and "".join(sp.encode("a  a b", out_type=str)) == f"{MARK}a{MARK}{MARK}a{MARK}b")
            _COUNTERS[path] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), safe
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _COUNTERS[path] = (lambda texts: [len(x.ids) for x in
                                              tok.encode_batch(texts, add_special_tokens=False)]), False
    return _COUNTERS[path]


def batched_lengths(texts: list[str | None], count: Callable[[list[str]], list[int]], safe: bool,
                    size: int = SEGMENT, batch: int = BATCH) -> list[int]:
    out = [0] * len(texts)
    owners: list[int] = []
    parts: list[str] = []
    held = 0

    def flush() -> None:
        for i, n in zip(owners, count(parts)):
            out[i] += n
        owners.clear()
        parts.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        for part in segments(text, size) if safe else [text]:
            owners.append(i)
            parts.append(part)
            held += len(part)
            if held >= batch:
                flush()
                held = 0
    if parts:
        flush()
    return out


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = _load(model)
        for b in batches:
            t = b.column("t")
            n = batched_lengths(t.to_pylist(), count, safe)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.compute.binary_length(t).cast(pa.int64()), pa.array(n, pa.int64())],
                ["k", "n_bytes", "n_tokens"])

    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
