"""Operator 12: n-gram Jaccard join by T-occurrence search.

A document's set is its distinct word shingles as 64-bit hashes; equal sets are
one set from the start. Two sets link when ``100 * common >= LEAST * union``,
so a set of ``n`` shingles has at least ``ceil(LEAST * n / 100)`` of them in
common with every partner. Three exact steps cut the sets down before any
search:

1. In the order of hashes, the first ``n - need + l`` shingles of two linked
   sets hold at least ``l`` common ones. Those prefixes alone are exchanged
   (``l`` grows with the set); a set with too few prefix shingles in common
   with others has no partner.
2. The sets that are left exchange all their shingles. A shingle in one set
   only is of no use; a set with fewer than ``need`` others has no partner.
3. In the order of rarity, linked sets share one of their first
   ``n - need + 1`` shingles; components of sets that do are blocks, and all
   links lie inside blocks. Frequent passages come last in this order and tie
   nothing together.

Inside a block the sets are searched by their inverted lists: a query's short
lists are merged with a heap, the sets it meets are looked up in the long lists
by binary search (DivideSkip), and those that reach the required overlap are
kept. Classes do not need all pairs of links. A query looks wider than the
join asks: if ``x`` links with ``q``, every partner of ``x`` is within twice
the Jaccard distance of ``q``. So the sets that link with ``q`` need no query
of their own when all wider neighbours get one, and a family of near copies
costs one query instead of one per member. A block above ``TILE`` sets is
dealt out in tiles; a few queries of each block are run against all its tiles
in a round, round by round, until no query is left, or few rounds have shown
that the block is no family: then all queries left meet all tiles.

Defined results: null, empty and blank texts have no shingle, link with
nothing and are their own component; repeated rows and equal texts share one;
a null id never names a component (a component of null ids only has none); an
empty table gives no row. Texts below ``SHINGLE`` words are one shingle. Only
the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, session_conf, table

SHINGLE = 4
LEAST = 85            # per cent of the union
EXTRA = 10            # per cent of a set that its first prefix is longer
TILE = 512            # sets of a block that are searched in one piece
TILE_SHINGLES = 2_000_000
QUERIES = 8           # queries of a block in a round
ROUNDS = 4
FILTER_BITS = 26      # bits of the filter for texts that are read again: 8 MB
BATCH = 256           # texts handed to a Python worker at a time
SKIP = 0.01           # DivideSkip's weight: how many lists count as long
#: What is known of a set in its block; even: it is still to be a query.
OPEN, COVERED, ASK, ASKED = np.arange(4)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    import xxhash

    split = [(t or "").encode().lower().split() for t in texts]     # bytes: A-Z and ASCII white space only
    coded = pa.array(list(itertools.chain.from_iterable(split)), pa.binary()).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    word = distinct[coded.indices.to_numpy()] if len(distinct) else distinct
    out, at = [], 0
    for ws in split:
        w = word[at:at + len(ws)]
        at += len(ws)
        n = min(size, len(w))
        h = np.full(max(len(w) - n + 1, 0) if n else 0, np.uint64(n))
        for i in range(n):
            h = _mix(h ^ w[i:len(w) - n + 1 + i]) + np.uint64(i + 1)
        out.append(np.unique(h))
    return out


def need(n, least: int = LEAST):
    """Shingles that a set of ``n`` has in common with any partner, at least."""
    return -(-least * n // 100)


def _extra(n, extra: int):
    return 1 + extra * n // 100


def _prefix_length(n, least: int, extra: int):
    """Shingles of the first prefix; those of it that a partner's also has."""
    return min(n, n - need(n, least) + _extra(n, extra)), min(_extra(need(n, least), extra), need(n, least))


def _signature(size: int, least: int, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            ids = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            lengths = [_prefix_length(len(s), least, extra)[0] if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("th"), pa.array(np.ascontiguousarray(ids[:, 0])), pa.array(np.ascontiguousarray(ids[:, 1])),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s[:p].view(np.int64) for s, p in zip(sets, lengths)], pa.list_(pa.int64()))],
                ["k", "th", "sa", "sb", "n", "prefix"])
    return run


def _read_again(size: int, bits):
    """(sa, sb, shingles) of the texts whose hash passes the filter, each set once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, seen = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            at = batch.column("th").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            hit = (known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            _, first = np.unique(batch.column("th").to_numpy(), return_index=True)
            once = np.zeros(len(hit), bool)
            once[first] = True
            sets, ids = [], []
            for s in shingle_sets(batch.column("text").filter(pa.array(hit.astype(bool) & once)).to_pylist(), size):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and digest not in seen:
                    seen.add(digest)
                    ids.append(digest)
                    sets.append(s.view(np.int64))
            ids = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ids[:, 0])), pa.array(np.ascontiguousarray(ids[:, 1])),
                                              pa.array(sets, pa.list_(pa.int64()))], ["sa", "sb", "shingles"])
    return run


def _filter(hashes: DataFrame) -> bytes:
    """Bit table of the text hashes: a fixed size, whatever the input."""
    b = F.col("th").bitwiseAND((1 << FILTER_BITS) - 1) + 1     # Spark counts from one
    parts = (hashes.select(F.bitmap_bucket_number(b).alias("n"), F.bitmap_bit_position(b).alias("p"))
             .groupBy("n").agg(F.bitmap_construct_agg("p").alias("m")).collect())     # at most 2^26 bits
    out = bytearray((1 << FILTER_BITS) // 8)
    for n, m in parts:
        out[(n - 1) * 4096:(n - 1) * 4096 + len(m)] = m
    return bytes(out)


def survivors(docs: DataFrame, reps: DataFrame, size: int, least: int, extra: int) -> DataFrame:
    """(gid, n, shingles) of the sets that may have a partner: of their shingles
    those that other sets have too, the rarest first."""
    spark = docs.sparkSession
    first = reps.select("gid", F.explode("prefix").alias("t"))
    common = materialize(first.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"), "ngrams-common")
    shared = first.join(common, "t", "left_semi").groupBy("gid").agg(F.count(F.lit(1)).alias("c"))
    bound = -F.floor(-F.col("n") * least / 100)
    bound = F.least(F.floor(bound * extra / 100) + 1, bound)
    passed = materialize(reps.join(shared, "gid").where(F.col("c") >= bound).select("gid", "sa", "sb", "th", "n"), "ngrams-passed")
    bits = spark.sparkContext.broadcast(_filter(passed))
    again = docs.mapInArrow(_read_again(size, bits), "sa long, sb long, shingles array<long>")
    whole = materialize(again.join(passed, ["sa", "sb"]).groupBy("gid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")),
                        "ngrams-whole")
    rows = whole.select("gid", "n", F.explode("shingles").alias("t"))
    count = materialize(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ngrams-counts")
    kept = (rows.join(count, "t").groupBy("gid", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))     # one set
            .where(F.size("s") >= -F.floor(-F.col("n") * least / 100)))
    out = materialize(kept.select("gid", "n", F.col("s.t").alias("shingles")), "ngrams-survivors")
    for old in (common, passed, whole, count):
        discard(old)
    return out


def blocks(kept: DataFrame, least: int) -> DataFrame:
    """(gid, block): sets that share a shingle of their rarest ones, transitively."""
    need_ = -F.floor(-F.col("n") * least / 100)
    length = F.col("n") - need_ + 1 - (F.col("n") - F.size("shingles"))     # shingles of this set alone come first
    rows = materialize(kept.select("gid", F.explode(F.slice("shingles", F.lit(1), length.cast("int"))).alias("t")), "ngrams-rarest")
    low = materialize(rows.groupBy("t").agg(F.min("gid").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "m"), "ngrams-low")
    edges = rows.join(low, "t").where("gid != m").select(F.col("gid").alias("a"), F.col("m").alias("b")).distinct()
    return connected_components(edges).select(F.col("node").alias("gid"), F.col("root").alias("block"))


class Lists:
    """Inverted lists over the sets of one tile."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        self.n = n
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.start = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.start[1:], len(self.owner))

    def search(self, query: np.ndarray, least_common: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, common shingles) of the sets that have at least that many, by DivideSkip."""
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query]
        if len(at) < least_common:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = self.end[at] - self.start[at]
        at = at[np.argsort(-size, kind="stable")]
        lists = [self.owner[self.start[i]:self.end[i]] for i in at.tolist()]
        n_long = min(int(least_common / (SKIP * math.log(size.max()) + 1)), least_common - 1)
        met, counts = [], []
        for number, run in itertools.groupby(heapq.merge(*(x.tolist() for x in lists[n_long:]))):
            c = sum(1 for _ in run)
            if c >= least_common - n_long:
                met.append(number)
                counts.append(c)
        met, counts = np.array(met, np.int64), np.array(counts, np.int64)
        for left, long in zip(range(n_long - 1, -1, -1), lists):
            place = np.searchsorted(long, met)
            counts += long[np.minimum(place, len(long) - 1)] == met
            able = counts + left >= least_common
            met, counts = met[able], counts[able]
        return met, counts

    def near(self, query: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, whether it links) of the sets within twice the join's distance of a query."""
        wide = max(0, 2 * least - 100)
        found, common = self.search(query, max(1, need(n, wide)))
        union = n + self.n[found] - common
        keep = 100 * common >= wide * union
        return found[keep], (100 * common >= least * union)[keep]


def _sets(group: pa.Table) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in group.column("shingles").combine_chunks()]


def _search_block(least: int):
    """Links that connect what is connected in one whole block."""
    def run(group: pa.Table) -> pa.Table:
        gid, n, sets = group.column("gid").to_numpy(), group.column("n").to_numpy(), _sets(group)
        lists = Lists(sets, n)
        state = np.full(len(gid), OPEN)
        a, b = [], []
        while (state % 2 == 0).any():     # open ones, and those that a query has met further away
            for i in np.flatnonzero(state % 2 == 0).tolist():
                if state[i] % 2:
                    continue
                found, link = lists.near(sets[i], int(n[i]), least)
                state[found] = np.maximum(state[found], np.where(link, COVERED, ASK))
                state[i] = ASKED
                found = found[link]
                found = found[found != i]
                a.append(np.full(len(found), gid[i]))
                b.append(gid[found])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})
    return run


def _search_tile(least: int):
    """(q, gid, link): the sets of one tile near each query that was sent to it."""
    def run(group: pa.Table) -> pa.Table:
        asked = group.column("asked").to_numpy()
        gid, n, sets = group.column("gid").to_numpy(), group.column("n").to_numpy(), _sets(group)
        there = np.flatnonzero(~asked)
        q, near, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        if len(there):
            lists = Lists([sets[i] for i in there], n[there])
            for i in np.flatnonzero(asked).tolist():
                found, link = lists.near(sets[i], int(n[i]), least)
                q.append(np.full(len(found), gid[i]))
                near.append(gid[there[found]])
                links.append(link)
        return pa.table({"q": pa.array(np.concatenate(q)), "gid": pa.array(np.concatenate(near)), "link": pa.array(np.concatenate(links))})
    return run


def search_tiles(tiles: DataFrame, least: int, tile: int, queries: int, rounds: int) -> DataFrame:
    """Links (a, b) of the blocks that are dealt out; ``tiles`` has (block, tile, gid, n, shingles)."""
    places = materialize(tiles.select("block", "tile").distinct(), "ngrams-places")
    state = materialize(tiles.select("block", "gid", F.lit(int(OPEN)).alias("s")), "ngrams-state")
    links = None
    for r in itertools.count():
        open_ = state.where("s % 2 = 0")
        if open_.isEmpty():
            return links
        if r < rounds:      # one of each share of a block, by a random order
            h = F.struct(F.xxhash64(F.lit(r), "gid").alias("h"), "gid")
            picked = (open_.groupBy("block", F.pmod(F.xxhash64("gid"), F.lit(queries)).alias("share")).agg(F.min(h).alias("h"))
                      .select("block", F.col("h.gid").alias("gid"), F.lit(0).cast("long").alias("share"), F.lit(1).cast("long").alias("shares")))
        else:               # all that are left, as many at a time as a tile has sets
            shares = open_.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).alias("shares"))
            picked = open_.join(shares, "block").select("block", "gid", F.pmod(F.xxhash64("gid"), "shares").alias("share"), "shares")
        picked = materialize(picked.join(tiles.select("block", "gid", "n", "shingles"), ["block", "gid"]), "ngrams-picked")
        columns = ["block", "tile", "share", "gid", "n", "shingles", "asked"]
        sent = picked.join(places, "block").withColumn("asked", F.lit(True)).select(columns)
        there = (tiles.join(picked.select("block", "shares").distinct(), "block")
                 .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
                 .withColumn("asked", F.lit(False)).select(columns))
        met = materialize(sent.unionByName(there).groupBy("block", "tile", "share")
                          .applyInArrow(_search_tile(least), "q long, gid long, link boolean"), "ngrams-met")
        found = met.where("link AND q != gid").select(F.col("q").alias("a"), F.col("gid").alias("b"))
        links = found if links is None else links.unionByName(found)
        change = (met.select("gid", F.when(F.col("link"), int(COVERED)).otherwise(int(ASK)).alias("to"))
                  .unionByName(picked.select("gid", F.lit(int(ASKED)).alias("to"))).groupBy("gid").agg(F.max("to").alias("to")))
        before, state = state, materialize(
            state.join(change, "gid", "left").select("block", "gid", F.greatest("s", "to").alias("s")), "ngrams-state")
        discard(before)
        discard(picked)


def links(kept: DataFrame, of: DataFrame, least: int = LEAST, tile: int = TILE, tile_shingles: int = TILE_SHINGLES,
          queries: int = QUERIES, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): enough links between sets to connect what is connected."""
    placed = kept.join(of, "gid")
    sizes = materialize(placed.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile),
                                                               F.ceil(F.sum(F.size("shingles")) / tile_shingles)).alias("c")), "ngrams-sizes")
    placed = materialize(placed.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("gid"), "c")), "ngrams-placed")
    out = placed.where("c = 1").groupBy("block").applyInArrow(_search_block(least), "a long, b long")
    large = search_tiles(placed.where("c > 1").drop("c"), least, tile, queries, rounds)
    return out if large is None else out.unionByName(large)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: int = LEAST,
               extra: int = EXTRA, **options) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.select(key).schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        rows = materialize(read.mapInArrow(_signature(size, least, extra), f"k {kind}, th long, sa long, sb long, n long, prefix array<long>"),
                           "ngrams-rows")
        one = (rows.where("n > 0").groupBy("sa", "sb")
               .agg(F.min("k").alias("k"), F.first("th").alias("th"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
        reps = materialize(one.withColumn("gid", F.monotonically_increasing_id()), "ngrams-sets")
        kept = survivors(read, reps, size, least, extra)
        found = materialize(links(kept, materialize(blocks(kept, least), "ngrams-blocks"), least, **options), "ngrams-links")
    roots = connected_components(found)
    of = materialize(reps.select("gid", "sa", "sb", "k").join(roots, F.col("gid") == F.col("node"), "left")
                     .select("sa", "sb", "k", F.coalesce("root", "gid").alias("root")), "ngrams-roots")
    low = of.groupBy("root").agg(F.min("k").alias("low"))
    of = materialize(of.join(low, "root").select("sa", "sb", "low"), "ngrams-components")
    out = (rows.where("n > 0").join(of, ["sa", "sb"]).select("k", "n", "low")
           .unionByName(rows.where("n = 0").select("k", "n", F.col("k").alias("low"))))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))


def op12_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


#: Sets and links from the texts; components by repeated minima over the links.
SQL = f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
    range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')))) END AS s FROM split),
one AS (SELECT min(rid) AS sid, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT sid, n, unnest(s) AS t FROM one),
met AS (SELECT a.sid AS a, b.sid AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
        FROM items a JOIN items b USING (t) WHERE a.sid < b.sid GROUP BY 1, 2),
edges AS (SELECT a, b FROM met WHERE 100 * c >= {LEAST} * (na + nb - c)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(sid, other) AS (SELECT sid, sid FROM one UNION SELECT reach.sid, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
ids AS (SELECT one.sid, min(sets.doc_id) AS k FROM one JOIN sets USING (s) GROUP BY 1),
low AS (SELECT reach.sid, min(ids.k) AS low FROM reach JOIN ids ON ids.sid = reach.other GROUP BY 1)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE low.low END AS component_id
FROM sets LEFT JOIN one USING (s) LEFT JOIN low USING (sid)
"""
