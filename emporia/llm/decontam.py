"""Operator 3: benchmark decontamination by templates.

Words of a text (runs of letters or of digits, by Unicode category; whatever is
between them is ignored; each letter of a script written without spaces is a
word) are made canonical: numbers, names and units become typed placeholders, other
words are lower-cased. A number is a run of digits, with points or commas
between digits, or a number word; a unit is a listed word after a number; a
name is a capitalised word that does not begin a sentence. Windows of
``WINDOW`` words with at least ``LITERALS`` literal ones are hashed and joined
to the windows of the benchmark items by hash, in Spark. A window with names is
hashed a second time with the names as lower-case literals, so a copy in
another letter case, where no name shows, has equal hashes too. Windows with
too few literal words even so are hashed as they are, in lower case, and match
equal words only; an item shorter than a window is one window of that kind. The scan over the
documents passes only windows that a bit table of fixed size may know, so
little is shuffled; the table is a filter, the join decides.

A matching pair of windows lines an item's slots (placeholders) up with a
document's. Per item, document and alignment a slot value must stand for one
document value throughout (the most frequent, the smallest on a tie); windows
that contradict it do not count. An item's positions have levels: those with
a window that has names as placeholders, those with a window of either kind,
and all (each holds the one before; a match by either hash counts at both). A document
contains an item if its windows cover ``SHARE`` of the item's at one level, or
``RUN`` of the level's windows in a row (a passage of RUN + WINDOW - 1 words;
positions of other levels do not end it), so re-parameterised questions and
long excerpts are found too. The level with the largest share is reported.

Defined results: null texts and texts without a word match nothing; an item
shorter than a window is in every document that has its words in a row; repeated rows match alike and are reported once;
rows with a null id are matched and reported with a null id (and removed by
:func:`clean`); items with equal templates are all reported. Only ids and
texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, discard, fresh, materialize, small_batches, table

WINDOW = 5
LITERALS = 3
SHARE = 0.8
RUN = 9
TABLE_BITS = 26                  # bits of the filter table: 8 MB, whatever the benchmark
BATCH_BYTES = 1 << 20
LEVELS = (3, 2, 0)               # highest type that is a placeholder: with names, without them, none

#: Words read as numbers and as units (fixed values).
NUMBER_WORDS = ("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
         "pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
         "week weeks month months year years dollar dollars cent cents euro euros usd eur percent degrees celsius fahrenheit "
         "meter meters metre metres kmh mph watt watts volt volts").split()

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SEP, _LETTER, _DIGIT, _ALONE, _MARK = 0, 1, 2, 3, 4   # letters and marks of scripts without spaces are the last two
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_LEAD_BYTE = (np.arange(256) & 0xC0) != 0x80
_LEAD = np.ones(256, np.int64)   # bytes of the character that a byte begins
_LEAD[0xC0:0xE0], _LEAD[0xE0:0xF0], _LEAD[0xF0:] = 2, 3, 4


@cache
def _classes() -> np.ndarray:
    """Kind of each code point."""
    out = np.array([{"L": _LETTER, "M": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _SEP)
                    for c in range(0x110000)], np.uint8)
    for a, b in UNSPACED:
        part = out[a:b + 1]
        part[part == _LETTER] = [_ALONE if unicodedata.category(chr(c))[0] == "L" else _MARK
                                 for c in range(a, b + 1) if out[c] == _LETTER]
    return out


@cache
def _lowered() -> np.ndarray:
    """Lower case of each code point, where it is one of the same length."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        x = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(x) == 1 and len(x.encode()) == len(chr(c).encode()):
            out[c] = ord(x)
    return out


def _one_case(text: str) -> str:
    """``text`` without the letters whose upper case is longer or shared."""
    return text.replace("ß", "ss").replace("ẞ", "SS").replace("ς", "σ")


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Tokens:
    """Canonical words of several texts laid end to end."""

    def __init__(self, texts: list[str]):
        texts = [_one_case(t) for t in texts]
        whole = "\n\n".join(texts) + "\n"
        self.raw = whole.encode()
        orig = np.frombuffer(self.raw, np.uint8)
        n = len(orig)
        ends_of = np.cumsum([len(x.encode()) + 2 for x in texts])
        if whole.isascii():
            lower = np.frombuffer(self.raw.lower(), np.uint8)
            kind = _classes()[lower]
        else:
            code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            lower = np.frombuffer(_lowered()[code].tobytes().decode("utf-32-le").encode(), np.uint8)
            kind = np.repeat(_classes()[code], 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))
        mark = (lower == 46) | (lower == 44)
        inner = np.zeros(n, bool)
        inner[1:-1] = mark[1:-1] & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT)
        kind[inner] = _DIGIT
        # a letter of a script without spaces is a word, with the marks that follow it
        alone = (kind == _ALONE) & (_LEAD_BYTE[lower])
        kind[kind == _MARK] = _ALONE
        edge = np.append(np.diff(kind, prepend=_SEP) != 0, kind[-1:] != _SEP)
        edge[:-1] |= alone
        change = np.flatnonzero(edge)
        starts, stops = change[:-1], change[1:]
        word = kind[starts] != _SEP if len(starts) else np.empty(0, bool)
        self.s, self.e = starts[word], stops[word]
        self.kind = kind[self.s]
        self.doc = np.searchsorted(ends_of, self.s, side="right")
        # polynomial hash of each word from prefix sums, independent of its place
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        back = np.full(n + 1, _inverse(int(_BASE)), np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        pre = np.append(np.uint64(0), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[:n]))
        h = _mix((pre[self.e] - pre[self.s]) * back[self.s] + (self.e - self.s).astype(np.uint64))
        # capitalised: only the first character differs from its lower case
        differs = np.append(0, np.cumsum(orig != lower))
        first = np.minimum(self.s + _LEAD[lower[self.s]], self.e)
        title = (differs[first] > differs[self.s]) & (differs[self.e] == differs[first]) & (self.e > first)
        stops_before = np.append(0, np.cumsum(_STOP[lower]))
        opens = np.ones(len(self.s), bool)
        opens[1:] = (self.doc[1:] != self.doc[:-1]) | (stops_before[self.s[1:]] > stops_before[self.e[:-1]])
        number = (self.kind == _DIGIT) | np.isin(h, _hashes(NUMBER_WORDS))
        after = np.zeros(len(h), bool)
        after[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = after & np.isin(h, _hashes(UNITS))
        name = title & ~opens & ~number & ~unit
        self.slot = np.select([number, unit, name], [1, 2, 3], 0)
        self.word = h

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, level, hash) of the windows inside one text; one that
        holds a name may be there at each of the first two levels, the last
        has those that are in none of them."""
        n = len(self.word) - size + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        inside = self.doc[:n] == self.doc[size - 1:]
        count = lambda x: (c := np.append(0, np.cumsum(x)))[size:] - c[:-size]
        named = count(self.slot == 3) > 0     # without a name the second level would repeat the first
        plain = [size - count((self.slot > 0) & (self.slot <= highest)) >= literals for highest in LEVELS[:2]]
        found = []
        for level, there in enumerate((plain[0], plain[1] & named, ~plain[1])):
            at = np.flatnonzero(inside & there)
            found.append((at, np.full(len(at), level), self._hash(at, size, LEVELS[level])))
        at, level, h = (np.concatenate(x) for x in zip(*found))
        return at, level, h

    def _hash(self, at: np.ndarray, size: int, highest: int) -> np.ndarray:
        word = np.where((self.slot > 0) & (self.slot <= highest), self.slot.astype(np.uint64), self.word)
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out = _mix(out * _BASE + word[at + k])
        return out

    def exact(self, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of that many words of one text as they are, or
        only of texts that have no other words."""
        at = np.arange(max(len(self.word) - size + 1, 0))
        keep = self.doc[at] == self.doc[at + size - 1]
        if whole:
            first = np.searchsorted(self.doc, self.doc[at])
            keep &= (at == first) & (np.searchsorted(self.doc, self.doc[at], side="right") - first == size)
        at = at[keep]
        return at, self._hash(at, size, 0)

    def slots(self, at: int, size: int, level: int = 0) -> list[str]:
        """Type and lower-cased value of each placeholder of a window."""
        return [f"{self.slot[i]}:{self.raw[self.s[i]:self.e[i]].decode('utf-8', 'replace').lower()}"
                for i in range(at, at + size if LEVELS[level] else at) if 0 < self.slot[i] <= LEVELS[level]]

    def ranks(self, at: np.ndarray, level: np.ndarray) -> list[list[int]]:
        """Per window and level, the place of its position among those of its
        text that have a window of that level or a lower one; -1 if it has none."""
        least = np.full(len(self.word), len(LEVELS))
        np.minimum.at(least, at, level)
        first = np.searchsorted(self.doc, self.doc[at])
        out = []
        for k in range(len(LEVELS)):
            before = np.append(0, np.cumsum(least <= k))
            out.append(np.where(least[at] <= k, before[at] - before[first], -1))
        return np.column_stack(out).tolist() if len(at) else []


_KNOWN: dict[tuple[str, ...], np.ndarray] = {}


def _hashes(words: list[str]) -> np.ndarray:
    key = tuple(words)
    if key not in _KNOWN:
        _KNOWN[key] = np.empty(0, np.uint64)   # the list itself has no number words
        _KNOWN[key] = _plain_hashes(words)
    return _KNOWN[key]


def _plain_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        total, power = 0, 1
        for c in w.encode():
            total, power = total + (c + 1) * power, power * int(_BASE)
        out.append((total + len(w)) % (1 << 64))
    return _mix(np.array(out, np.uint64))


def _scan(size: int, literals: int, bits, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else np.frombuffer(bits.value, np.uint8)

        def filtered(h: np.ndarray) -> np.ndarray:
            b = h & np.uint64((1 << TABLE_BITS) - 1)
            return np.flatnonzero((known[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1)

        def search(keys: list, texts: list[str]) -> pa.RecordBatch:
            t = Tokens(texts)
            at, level, h = t.windows(size, literals)
            words = np.full(len(at), size)
            if known is not None:
                hit = filtered(h)
                at, level, h, words = at[hit], level[hit], h[hit], words[hit]
            for n in short if known is not None else range(1, size):
                at2, h2 = t.exact(n, known is None)
                if known is not None:     # once in a text is enough
                    hit = filtered(h2)
                    hit = hit[np.sort(np.unique(np.stack([t.doc[at2[hit]].astype(np.uint64), h2[hit]]), axis=1, return_index=True)[1])]
                    at2, h2 = at2[hit], h2[hit]
                at, h = np.append(at, at2), np.append(h, h2)
                level, words = np.append(level, np.full(len(at2), len(LEVELS) - 1)), np.append(words, np.full(len(at2), n))
            ranks = t.ranks(at, level) if known is None else [None] * len(at)
            first = np.searchsorted(t.doc, np.arange(len(texts)))
            doc = t.doc[at] if len(at) else np.empty(0, np.int64)
            ids, hashes = zip(*[keys[i] for i in doc.tolist()]) if len(at) else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(h.view(np.int64)),
                 pa.array((at - first[doc]).astype(np.int32) if len(at) else [], pa.int32()),
                 pa.array([t.slots(i, size, v) for i, v in zip(at.tolist(), level.tolist())], pa.list_(pa.string())),
                 pa.array(ranks, pa.list_(pa.int32())), pa.array(words, pa.int32())],
                ["k", "row", "h", "pos", "slots", "ranks", "words"])

        keys, texts, held = [], [], 0
        for b in batches:
            for k, r, text in zip(*(b.column(c).to_pylist() for c in ("k", "row", "t"))):
                if text:
                    keys.append((k, r))
                    texts.append(text)
                    held += len(text)
                if held >= BATCH_BYTES:
                    yield search(keys, texts)
                    keys, texts, held = [], [], 0
        if texts:
            yield search(keys, texts)
    return run


def _row(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def template_windows(rows: DataFrame, key: str, text: str = "text", bits=None, size: int = WINDOW,
                     literals: int = LITERALS, short: list[int] | None = None) -> DataFrame:
    """(k, row, h, pos, slots, ranks, words): windows of the texts; ``row`` is
    a hash of the text that tells rows of one key apart, ``ranks`` (null with a
    filter) the place of the window among those of each level, or -1. Texts
    that are shorter than a window are one; with a filter, all texts have
    windows of the ``short`` sizes instead."""
    small_batches(rows.sparkSession)
    return rows.select(F.col(key).cast("long").alias("k"), _row(F.col(text)).alias("row"), F.col(text).alias("t")).mapInArrow(
        _scan(size, literals, bits, short or []), "k long, row long, h long, pos int, slots array<string>, ranks array<int>, words int")


def _bit_table(windows: DataFrame) -> bytes:
    """Which hashes occur, by their low bits: at most 2^TABLE_BITS bits."""
    b = F.col("h").bitwiseAND((1 << TABLE_BITS) - 1) + 1   # Spark counts from one
    parts = (windows.select(F.bitmap_bucket_number(b).alias("n"), F.bitmap_bit_position(b).alias("p"))
             .groupBy("n").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    width = 32_768
    out = bytearray((1 << TABLE_BITS) // 8 + width // 8)
    for n, m in parts:
        out[(n - 1) * width // 8:(n - 1) * width // 8 + len(m)] = m
    return bytes(out)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE,
         run: int = RUN) -> DataFrame:
    """Written table (k, row, item_id, n_windows, matched, longest, share): each
    contained item of each distinct document."""
    spark = docs.sparkSession
    items = materialize(template_windows(benchmark, "item_id").distinct(), "decon-items")
    levels = lambda df: df.select("*", F.posexplode("ranks").alias("level", "rank")).where("rank >= 0")
    total = levels(items).groupBy("k", "row", "level").agg(F.countDistinct("rank").alias("n_windows"))
    bits = spark.sparkContext.broadcast(_bit_table(items))
    short = [r["words"] for r in items.where(F.col("words") < WINDOW).select("words").distinct().collect()]   # sizes below WINDOW
    hits = materialize(template_windows(docs, key, text, bits, short=short).drop("ranks", "words"), "decon-hits")
    there = items.select(F.col("k").alias("item"), F.col("row").alias("irow"), "h", F.col("pos").alias("ipos"),
                         F.col("slots").alias("islots"), "ranks")
    pair = ["k", "row", "item", "irow", "off"]
    met = materialize(hits.join(there, "h").withColumn("off", F.col("pos") - F.col("ipos")).distinct(), "decon-met")
    # the value that each slot value of the item stands for, per alignment; a position has one vote at all levels
    each = (met.select(*pair, "ipos", F.explode(F.arrays_zip("islots", "slots")).alias("s"))
            .select(*pair, "ipos", "s.islots", "s.slots").distinct())
    votes = each.groupBy(*pair, "islots", "slots").agg(F.count(F.lit(1)).alias("n"))
    meant = (votes.groupBy(*pair, "islots").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("slots").alias("v"))).alias("w"))
             .select(*pair, "islots", "w.*"))
    # and the other way round: of the item's values that would all read as one, the best attested keeps it
    meant = meant.groupBy(*pair, "v").agg(F.min(F.struct("n", "islots"))["islots"].alias("islots"))
    table_ = meant.groupBy(*pair).agg(F.map_from_entries(F.collect_list(F.struct("islots", "v"))).alias("meant"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ours = table_.select(*[F.col(c).alias(f"m_{c}") for c in pair], "meant")
    on = same("k", "m_k")
    for c in pair[1:]:
        on = on & same(c, f"m_{c}")
    agrees = F.forall(F.arrays_zip("islots", "slots"), lambda s: F.coalesce(F.col("meant")[s["islots"]] == s["slots"], F.lit(False)))
    good = met.join(ours, on, "left").where((F.size("slots") == 0) | agrees)
    # runs of consecutive windows of a level along an alignment
    at = levels(good).select(*pair, "level", "rank")
    pair4 = ["k", "row", "item", "irow"]
    runs = (at.groupBy(*pair, "level").agg(F.array_sort(F.collect_set("rank")).alias("at"))
            .select(*pair, "level", "at", F.explode(F.transform("at", lambda p, i: p - i)).alias("g")).groupBy(*pair, "level", "g")
            .agg(F.count(F.lit(1)).alias("len")).groupBy(*pair4).agg(F.max("len").alias("longest")))
    seen = at.groupBy(*pair4, "level").agg(F.countDistinct("rank").alias("matched"))
    t = total.select(F.col("k").alias("t_k"), F.col("row").alias("t_row"), F.col("level").alias("t_level"), "n_windows")
    # of the levels, the one that covers most
    seen = (seen.join(t, same("item", "t_k") & same("irow", "t_row") & same("level", "t_level"))
            .withColumn("share", F.col("matched") / F.col("n_windows"))
            .groupBy(*pair4).agg(F.max(F.struct("share", "n_windows", "matched")).alias("best")).select(*pair4, "best.*"))
    r = runs.select(*[F.col(c).alias(f"r_{c}") for c in pair4], "longest")
    on = same("k", "r_k") & same("row", "r_row") & same("item", "r_item") & same("irow", "r_irow")
    out = (seen.join(r, on).where((F.col("share") >= share) | (F.col("longest") >= run))
           .select("k", "row", F.col("item").alias("item_id"), "n_windows", "matched", "longest", "share"))
    done = materialize(out, "decon-found")
    discard(hits)
    discard(met)
    return done


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, item_id, n_windows, matched, longest, share) of contained items."""
    return (find(docs, benchmark, key, text, **options)
            .select(F.col("k").alias(key), "item_id", "n_windows", "matched", "longest", "share").distinct())


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without those that contain a benchmark item."""
    th, k, r = (fresh(x, docs) for x in ("_text_h", "_bad_k", "_bad_row"))
    bad = materialize(find(docs, benchmark, key, text, **options).select(F.col("k").alias(k), F.col("row").alias(r)).distinct(),
                      "decon-bad")
    return (docs.withColumn(th, _row(F.col(text)))
            .join(bad, F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.col(th) == F.col(r)), "left_anti").drop(th))


def op3_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
