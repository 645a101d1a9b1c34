"""Operator 8: quality rules whose cutoffs are certified on labelled holdouts.

Every metric has a fixed grid of cutoffs. For each stratum (language), metric
and cutoff, the labelled good documents that the cutoff would reject are
counted; the cutoff is certified when the exact binomial tail
``P(Bin(n, limit) <= rejected)`` is at most ``delta`` divided by the number of
all tests (Bonferroni). The false-rejection limit of a stratum is shared out
evenly over the metrics, so the union of all rules stays within it. Among the
certified cutoffs a metric takes the one that rejects the most labelled bad
documents net of good ones, the loosest on a tie, and none if no cutoff gains.

All columns are DataFrame functions; the only wide steps are partial counts
over the labelled rows.

Defined results: null and empty texts have no words and fail the base rules; a
null language is a stratum of its own; a document without certified cutoffs in
its stratum is judged by the base rules alone; of repeated labels of one
document a good one counts; without labels nothing is certified. Extra columns
pass through :func:`judge` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_SPLIT, fresh, let, materialize, table, words

SYMBOLS = "[#*$%&|<>]"
RATIO_GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)
#: metric -> cutoffs; a document is rejected when its metric exceeds the cutoff.
GRIDS = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0),
    "shouts": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0),
    "dup_lines": RATIO_GRID,
    "repeats": RATIO_GRID,
    "long_words": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),
    "short_words": (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5, -1.2, -1.0),
}
LIMIT = 0.05    # false rejections allowed per stratum, as a share of good documents
DELTA = 0.05    # chance that any certified cutoff breaks its share
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_lines")

_INDEX_BITS = 21


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(idx: Column) -> Column:
    """Words in the 3-word windows that start at these positions (sorted)."""
    steps = F.transform(idx, lambda x, k: F.when(k + 1 < F.size(idx), F.least(F.lit(3), F.get(idx, k + 1) - x))
                        .otherwise(F.lit(3)).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows are compared by
    64-bit hash. The repeated ones are found by sorting one long per window:
    high hash bits over the position; texts beyond 2^21 words sort pairs."""
    def windows(hs: Column) -> Column:
        return F.transform(F.slice(hs, 1, F.size(hs) - 2),
                           lambda x, i: F.xxhash64(x, F.get(hs, i + 1), F.get(hs, i + 2)))

    mask = (1 << _INDEX_BITS) - 1

    def packed(h: Column) -> Column:
        def starts(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return (F.shiftrightunsigned(x.bitwiseXOR(y), _INDEX_BITS) == 0) & (
                    F.get(h, x.bitwiseAND(mask).cast("int")) == F.get(h, y.bitwiseAND(mask).cast("int")))
            hit = F.transform(s, lambda x, j: F.when(
                ((j > 0) & same(F.get(s, j - 1), x)) | ((j + 1 < F.size(s)) & same(x, F.get(s, j + 1))),
                x.bitwiseAND(mask)))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))
        s = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, _INDEX_BITS), _INDEX_BITS)
                                     .bitwiseOR(i.cast("long"))))
        return let(let(s, starts), _covered)

    def paired(h: Column) -> Column:
        def starts(s: Column) -> Column:
            hit = F.transform(s, lambda x, j: F.when(
                ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j + 1 < F.size(s)) & (F.get(s, j + 1)["h"] == x["h"])),
                x["i"].cast("long")))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))
        s = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(s, starts), _covered)

    def count(h: Column) -> Column:
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .when(F.size(h) <= mask, packed(h)).otherwise(paired(h)))

    return let(w, lambda ws: F.when(F.size(ws) < 4, F.lit(0).cast("long"))
               .otherwise(let(let(F.transform(ws, lambda x: F.xxhash64(x)), windows), count)))


def text_stats(text: Column) -> Column:
    """Struct of the counts in :data:`STATS` of one whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, WORD_SPLIT, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"),
        line_counts.alias("lc"),
        _repeat_words(w).alias("n_repeat_words"),
        _count(t, "[!]").cast("long").alias("n_shouts")))


def with_stats(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    return docs.withColumn(into, text_stats(F.col(text)))


def flat_stats(s: str | Column = "_stats") -> list[Column]:
    s = F.col(s) if isinstance(s, str) else s
    return [s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
            (s["lc"]["n"] - s["lc"]["d"]).cast("long").alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
            s["n_shouts"].alias("n_shouts"), s["lc"]["n"].cast("long").alias("n_lines")]


def _count_of(of: Column | None, name: str) -> Column:
    return F.col(name) if of is None else of[name]


def base_failed(of: Column | None = None) -> Column:
    """By the columns of that name, or the fields of a struct."""
    n, r = _count_of(of, "n_words"), _count_of(of, "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def metrics(of: Column | None = None) -> dict[str, Column]:
    """Metric columns; null where the divisor is zero (never rejected)."""
    c = lambda name: _count_of(of, name)
    n = F.when(c("n_words") > 0, c("n_words").cast("double"))
    lines = F.when(c("n_lines") > 0, c("n_lines").cast("double"))
    return {"symbols": c("n_symbols") / n, "shouts": c("n_shouts") / n, "dup_lines": c("n_dup_lines") / lines,
            "repeats": c("n_repeat_words") / n, "long_words": c("word_chars") / n, "short_words": -(c("word_chars") / n)}


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """ln P(Bin(n, p) <= k), summed exactly in log space."""
    odds = F.ln(p) - F.ln(1 - p)

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double")) + odds
        top = F.greatest(acc["s"], t)
        return F.struct(t.alias("t"), (top + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"))

    first = n * F.ln(1 - p)
    return F.when(k <= 0, first).otherwise(F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")),
        F.struct(first.alias("t"), first.alias("s")), step, lambda acc: acc["s"]))


def fit_cutoffs(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA,
                grids: dict[str, tuple[float, ...]] = GRIDS, stratum: str = "lang",
                key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, cuts): one row per stratum with labelled good documents; the
    map has a metric's cutoff where one is certified and gains anything.

    ``stats`` holds the key, the stratum and the columns of :data:`STATS`.
    """
    lab = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_good")))
    # level: how many cutoffs of its metric's ascending grid a document exceeds
    levels = F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"),
        sum((F.coalesce((x > c).cast("int"), F.lit(0)) for c in grids[m]), F.lit(0)).alias("level"))
        for m, x in metrics().items() if m in grids]))
    held = (stats.join(lab, stats[key] == lab["_k"]).where(~base_failed())
            .select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), (F.col("_good") == 1).alias("good"),
                    levels.alias("c")).select("stratum", "good", "c.*"))
    per = materialize(held.groupBy("stratum", "metric", "level").agg(
        F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad")),
        "quality-levels")
    n = per.groupBy("stratum").agg((F.sum("good") / len(grids)).cast("long").alias("n")).where("n > 0")
    # the strata are counted on the table itself, so the correction grows with them
    n = n.crossJoin(n.agg(F.count(F.lit(1)).alias("n_strata")))
    out = (per.where("level > 0").select("stratum", "metric", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("i"),
                                         "good", "bad")
           .groupBy("stratum", "metric", "i").agg(F.sum("good").alias("good_out"), F.sum("bad").alias("bad_out")))
    cut = F.create_map(*[x for m, g in grids.items() for x in (F.lit(m), F.array(*[F.lit(float(c)) for c in g]))])
    share = F.lit(limit / len(grids))
    bound = F.ln(F.lit(delta) / (F.col("n_strata") * sum(len(g) for g in grids.values())))
    sure = (F.col("good_out") < F.col("n") * share) & (binomial_tail(F.col("good_out"), F.col("n"), share) <= bound)
    gain = F.col("bad_out") - F.col("good_out")
    best = (out.join(n, "stratum").where(sure & (gain > 0))
            .groupBy("stratum", "metric").agg(F.max(F.struct(gain.alias("gain"), F.get(cut[F.col("metric")], F.col("i"))
                                                             .alias("cut")))["cut"].alias("cut")))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("metric", "cut"))).alias("cuts"))


def method_rejects(cuts: str = "cuts", of: Column | None = None, names: tuple[str, ...] = tuple(GRIDS)) -> Column:
    out = F.lit(False)
    for m, x in metrics(of).items():
        if m in names:
            out = out | F.coalesce(x > F.col(cuts)[m], F.lit(False))
    return out


def _with_cuts(rows: DataFrame, cutoffs: DataFrame, stratum: str, names: tuple[str, str] = ("_stratum", "_cuts")) -> DataFrame:
    cut = cutoffs.select(F.col("stratum").alias(names[0]), F.col("cuts").alias(names[1]))
    return rows.join(cut, F.coalesce(F.col(stratum), F.lit("")) == F.col(names[0]), "left")


def verdicts(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``stats`` with base_failed and kept."""
    return (_with_cuts(stats, cutoffs, stratum).withColumn("base_failed", base_failed())
            .withColumn("kept", ~base_failed() & ~method_rejects("_cuts")))


def document_stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Narrow written table (doc_id, stratum, counts): one pass over the texts."""
    return materialize(with_stats(docs.select("doc_id", stratum, "text"))
                       .select("doc_id", stratum, *flat_stats()), "quality-stats")


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns. The cutoffs come
    from a narrow table of counts; the verdicts are computed in the pass that
    returns the rows, so no text is shuffled."""
    cutoffs = materialize(fit_cutoffs(document_stats(docs), labels, **options), "quality-cutoffs")
    s, c = (fresh(x, docs) for x in ("_stratum", "_cuts"))
    # the counts are a value of their own, found once per row
    keep = let(text_stats(F.col("text")), lambda raw: let(F.struct(*flat_stats(raw)), lambda q: ~base_failed(q) & ~method_rejects(c, q)))
    return _with_cuts(docs, cutoffs, "lang", (s, c)).where(keep).select(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = document_stats(table(spark, sf_dir, "documents"))
    cutoffs = materialize(fit_cutoffs(stats, table(spark, sf_dir, "labels")), "quality-cutoffs")
    return verdicts(stats, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    cases = ",\n    ".join(f"('{m}', {c!r}::DOUBLE)" for m, g in GRIDS.items() for c in g)
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls,
    row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
grams AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM win),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + d.d) AS n FROM dup, (VALUES (0), (1), (2)) d(d) GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts, len(ls)::BIGINT AS n_lines
    FROM w LEFT JOIN rep ON rep.rid = w.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
m AS (SELECT rid, doc_id, coalesce(lang, '') AS stratum, base_failed,
    unnest(['symbols', 'shouts', 'dup_lines', 'repeats', 'long_words', 'short_words']) AS metric,
    unnest([n_symbols / nullif(n_words, 0)::DOUBLE, n_shouts / nullif(n_words, 0)::DOUBLE,
        n_dup_lines / nullif(n_lines, 0)::DOUBLE, n_repeat_words / nullif(n_words, 0)::DOUBLE,
        word_chars / nullif(n_words, 0)::DOUBLE, -(word_chars / nullif(n_words, 0)::DOUBLE)]) AS x FROM b),
lab AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT m.*, good FROM m JOIN lab USING (doc_id) WHERE NOT base_failed),
grid AS (SELECT * FROM (VALUES
    {cases}) g(metric, cut)),
t AS (SELECT stratum, metric, cut, count(*) FILTER (good) AS n,
    count(*) FILTER (good AND x > cut) AS k, count(*) FILTER (NOT good AND x > cut) AS bad
    FROM held JOIN grid USING (metric) GROUP BY ALL),
strata AS (SELECT count(DISTINCT stratum) AS ns FROM t WHERE n > 0),
p AS (SELECT t.*, {LIMIT!r}::DOUBLE / {len(GRIDS)} AS q, {DELTA!r}::DOUBLE / (ns * {sum(map(len, GRIDS.values()))}) AS d
    FROM t, strata WHERE n > 0),
sure AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(q) + (n - i) * ln(1 - q)))) AS tail
    FROM p WHERE k < n * q AND bad > k),
best AS (SELECT stratum, metric, arg_max(cut, (bad - k) * 1000.0 + cut) AS cut FROM sure WHERE tail <= d GROUP BY ALL),
rej AS (SELECT DISTINCT rid FROM m JOIN best USING (stratum, metric) WHERE x > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rej.rid IS NULL AS kept
FROM b LEFT JOIN rej ON rej.rid = b.rid"""


SQL = _sql()
