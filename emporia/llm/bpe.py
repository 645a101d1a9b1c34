"""Operator 6: byte-level BPE through a table of distinct words.

Encode: Spark splits every text into words with the tokenizer's own pattern.
Documents are gathered into blocks of about ``BLOCK_WORDS`` words; inside a
block a text is a list of codes, the places of its words in the block's table
of distinct words. Those tables are dealt out by word, so that each distinct
word of the corpus meets in one place and is encoded once; its ids go back to
the blocks and replace the codes by position. Only codes, distinct words and
their ids are shuffled (compressed), never texts, and no key is hot: a word
occurs once in a block, however often a text repeats it.

Decode: the id-to-piece table has one row per vocabulary entry (a fixed size)
and is joined by id inside Arrow batches.

Blocks are cut from the scan order, which a task that is run again must meet
again; inputs that are not plain scans are written first.

Defined results: null is the empty text (no ids, decoded to the empty string);
special strings inside texts become their ids, as the tokenizers library does;
repeated rows and null keys are encoded row by row; only the key and the text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stable, table

BLOCK_WORDS = 500_000
ENCODE = 4096          # words handed to the library at a time
_SPACE = "\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: The byte-level pattern of the public tokenizers, white space spelled out (fixed value).
PATTERN = (f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_SPACE}\\p{{L}}\\p{{N}}]+"
           f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def special_strings(path: str) -> list[str]:
    """Strings that become one id wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens with matching options are not supported")
    return sorted((t["content"] for t in added), key=lambda s: (-len(s), s))


#: Code points that Java's Unicode tables do not have yet: it cannot class them.
NEWER = "\\p{Cn}"


def split_words(text: Column, specials: list[str]) -> Column:
    """Words of a text in order; their concatenation is the text. Texts with
    code points of :data:`NEWER` are left to :func:`library_words`."""
    def split(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))

    if not specials:
        return split(text)
    marks = "|".join("\\Q" + s + "\\E" for s in specials)
    found = F.regexp_extract_all(text, F.lit(f"({marks})"), F.lit(1))
    parts = F.transform(F.split(text, marks), lambda t, i: F.concat(
        F.when(i > 0, F.array(F.get(found, i - 1))).otherwise(F.array().cast("array<string>")), split(t)))
    return F.when(text.rlike(marks), F.flatten(parts)).otherwise(split(text))


def library_words(text: str, tok, specials: list[str]) -> list[str]:
    """The same split by the tokenizers library itself, for single texts."""
    parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]
    out = []
    for p in parts:
        out += [p] if p in specials else [p[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(p)]
    return out


def _pack(codes: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """Texts of a block: their keys, words per text, and each word as a code.

    The distinct words are dealt to buckets by hash. In a bucket the more
    frequent come first, and the ``j``-th word of bucket ``b`` has the code
    ``j * buckets + b``: codes of common words are small, and a bucket's words
    in their order name their codes."""

    def __init__(self, number: int, keys: list, counts: list, flat: list, buckets: int):
        coded = pa.chunked_array(flat, pa.string()).combine_chunks().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        self.number, self.keys, self.counts = number, pa.chunked_array(keys).combine_chunks(), np.concatenate(counts)
        to = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int64)
        order = np.lexsort((-np.bincount(index, minlength=len(words)), to))
        self.words = words.take(pa.array(order))
        self.sizes = np.bincount(to, minlength=buckets)
        starts = np.cumsum(self.sizes) - self.sizes
        code = np.empty(len(words), np.int64)
        code[order] = (np.arange(len(words)) - np.repeat(starts, self.sizes)) * buckets + to[order]
        self.codes = code[index] if len(index) else index


def _blocks(batches: Iterator[pa.RecordBatch], words: int, buckets: int, path: str) -> Iterator[_Block]:
    part, seq, tok = TaskContext.get().partitionId(), 0, None
    keys, counts, flat, held = [], [], [], 0
    for b in batches:
        w = b.column("w")
        if w.null_count:
            if tok is None:
                from tokenizers import Tokenizer

                tok, specials = Tokenizer.from_file(path), special_strings(path)
            w = pa.array([x if x is not None else library_words(t, tok, specials)
                          for x, t in zip(w.to_pylist(), b.column("t").to_pylist())], pa.list_(pa.string()))
        n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int32)
        keys.append(b.column("k"))
        counts.append(n)
        flat.append(w.flatten().cast(pa.string()))
        held += int(n.sum())
        if held >= words:
            block = _Block((part << 32) | seq, keys, counts, flat, buckets)
            seq, keys, counts, flat, held = seq + 1, [], [], [], 0
            yield block
            del block       # not held while the next one fills
    if keys:
        yield _Block((part << 32) | seq, keys, counts, flat, buckets)


def _dealt_words(words: int, buckets: int, path: str):
    """(bucket, block, lengths, letters): the distinct words of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for block in _blocks(batches, words, buckets, path):
            if not len(block.words):
                continue
            size = pc.binary_length(block.words).to_numpy(zero_copy_only=False)
            letters = block.words.cast(pa.binary())
            cuts = np.append(0, np.cumsum(block.sizes))
            full = np.flatnonzero(block.sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block.number, np.int64)),
                 pa.array([_pack(size[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
                 pa.array([zip_(b"".join(letters.slice(cuts[b], block.sizes[b]).to_pylist())) for b in full], pa.binary())],
                ["bucket", "block", "lengths", "letters"])
            del block, letters
            pa.default_memory_pool().release_unused()
    return run


def _coded_texts(words: int, buckets: int, path: str):
    """(block, keys, counts, codes): one row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, words, buckets, path):
            offsets = pa.array([0, len(block.keys)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number], pa.int64()), pa.ListArray.from_arrays(offsets, block.keys),
                 pa.ListArray.from_arrays(offsets, pa.array(block.counts)), pa.array([_pack(block.codes)], pa.binary())],
                ["block", "keys", "counts", "codes"])
            del block
            pa.default_memory_pool().release_unused()
    return run


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one task, one core; threads would each keep memory
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # words stay whole
    return tok


def _read_words(lengths: bytes, letters: bytes) -> list[str]:
    ends = np.cumsum(_unpack(lengths)).tolist()
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(letters)
    return [raw[s:e].decode() for s, e in zip([0, *ends], ends)]


def _encode_words(path: str):
    """Rows sorted by bucket: each distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known, last = _encoder(path), {}, None
        for b in batches:
            sizes, ids = [], []
            for bucket, lengths, letters in zip(*(b.column(c).to_pylist() for c in ("bucket", "lengths", "letters"))):
                if bucket != last:
                    known, last = {}, bucket
                words = _read_words(lengths, letters)
                new = [w for w in words if w not in known]
                for at in range(0, len(new), ENCODE):
                    part = new[at:at + ENCODE]
                    for w, enc in zip(part, tok.encode_batch(part, add_special_tokens=False)):
                        known[w] = enc.ids
                found = [known[w] for w in words]
                sizes.append(_pack(np.array([len(x) for x in found])))
                ids.append(_pack(np.array([i for x in found for i in x])))
            yield pa.RecordBatch.from_arrays(
                [b.column("block"), b.column("bucket"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
                ["block", "bucket", "sizes", "ids"])
    return run


def _gather(values: np.ndarray, at: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``values[at:at+size]`` named by codes; and their lengths."""
    per = size[codes]
    ends = np.cumsum(per)
    total = int(ends[-1]) if len(ends) else 0
    idx = np.repeat(at[codes] - (ends - per), per) + np.arange(total)
    return values[idx], per


def _ids(keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
    return pa.table({"key": keys, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                                 pa.array(ids.astype(np.int32)))})


def _join_back(buckets: int, finish):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block: the codes of its texts replaced by the ids of their words."""
        keys = left.column("keys").combine_chunks().flatten()
        counts = left.column("counts").combine_chunks().flatten().to_numpy()
        codes = _unpack(left.column("codes")[0].as_py()).astype(np.int64)
        sizes = [_unpack(x).astype(np.int64) for x in right.column("sizes").to_pylist()]
        values = np.concatenate([_unpack(x) for x in right.column("ids").to_pylist()] or [np.empty(0, "<u4")])
        at = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        size = np.zeros_like(at)
        start = 0
        for bucket, n in zip(right.column("bucket").to_pylist(), sizes):
            ends = start + np.cumsum(n)
            at[bucket::buckets][:len(n)] = ends - n
            size[bucket::buckets][:len(n)] = n
            start = ends[-1]
        ids, per = _gather(values, at, size, codes)
        ends = np.append(0, np.cumsum(per))[np.append(0, np.cumsum(counts))]
        del codes, at, size, per, values, sizes
        out = finish(keys, ids, ends)
        pa.default_memory_pool().release_unused()
        return out
    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           block_words: int = BLOCK_WORDS, finish=_ids, schema: str = "ids array<int>") -> DataFrame:
    """(key, ids): the token ids of every whole text; or what ``finish`` makes
    of a block's keys, ids and the places where each text's ids end."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = stable(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "bpe-in").select(
        "k", F.when(~t.rlike(NEWER), split_words(t, special_strings(path))).alias("w"), F.when(t.rlike(NEWER), t).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    dealt = rows.mapInArrow(_dealt_words(block_words, buckets, path), "bucket int, block long, lengths binary, letters binary")
    coded = rows.mapInArrow(_coded_texts(block_words, buckets, path),
                            f"block long, keys array<{kind}>, counts array<int>, codes binary")
    encoded = (dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
               .mapInArrow(_encode_words(path), "block long, bucket int, sizes binary, ids binary"))
    out = (coded.groupBy("block").cogroup(encoded.groupBy("block"))
           .applyInArrow(_join_back(buckets, finish), f"key {kind}, {schema}"))
    return out.withColumnRenamed("key", key)


_PIECES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: all bytes, and each id's start and length."""
    if path not in _PIECES:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        pieces = [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]
        raw = [bytes(to_byte[c] for c in p) if p is not None and all(c in to_byte for c in p)
               else (p or "").encode() for p in pieces]
        size = np.array([len(x) for x in raw], np.int64)
        _PIECES[path] = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size
    return _PIECES[path]


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): ids joined with their pieces; malformed bytes are replaced."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, at, size = _pieces(path)
        for b in batches:
            ids = [np.array(x if x is not None else [], np.int64) for x in b.column("ids").to_pylist()]
            texts = [_gather(values, at, size, i)[0].tobytes().decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    return (rows.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
            .mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and
    decoded again (in the worker that joined the ids, so they are not sent on)."""
    def digests(keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        values, at, size = _pieces(path)
        ids_hash, text_hash = [], []
        for s, e in zip(ends[:-1], ends[1:]):
            i = ids[s:e]
            ids_hash.append(hashlib.sha256(i.astype("<u4").tobytes()).hexdigest())
            t = _gather(values, at, size, i)[0].tobytes()
            text_hash.append(hashlib.sha256(t.decode("utf-8", "replace").encode()).hexdigest())
        return pa.table({"key": keys, "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                         "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())})

    return encode(docs, path, key, text, block_words, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
