"""Operator 5: URL rules whose block decisions spread over redirect aliases.

A page is tied to the address its HTML redirects to (meta refresh) and to the
one it declares canonical. Addresses that are connected by such links, however
long the chain, are one component, found by distributed connected components.
A component with an address that a rule blocks is blocked as a whole, except
for addresses that a rule allows outright: the page's own rule always decides
first.

Everything is DataFrame functions. HTML is read once for the links; after
that only addresses are joined. An address is host, path and query; scheme and
fragment are left out, so both schemes are aliases. Links with other schemes
are ignored; dot segments are not resolved.

Defined results: null, empty or malformed urls have empty host and path, no
rule, no alias, and are allowed; null html has no links; repeated rows are
judged alike; of equally long rules that fit, the later in text order wins.
Other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, let, lower_az, materialize, table

#: verdict, host, path of the query's rules (fixed by its contract).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]

_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^>]*?\burl\s*=\s*[\"']?\s*([^\"'>\s]+)"


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(_after(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def place_of(host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path as addresses are compared: without a default port, and
    with ``/`` for an empty path."""
    return F.regexp_replace(host, ":(80|443)$", ""), F.when(path == "", "/").otherwise(path)


def address(url: Column) -> Column:
    """Host, path and query; null for a url without a host. Spellings of one
    place (see :func:`place_of`) have one address."""
    host, path = place_of(host_of(url), path_of(url))
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host, path, query))


def link_targets(html: Column) -> Column:
    """Raw targets of the redirects and canonical links of a page."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TAGS), F.lit(0))
    target = lambda t: F.when(t.rlike(_CANONICAL), F.concat(*[F.regexp_extract(t, _HREF, i) for i in (1, 2, 3)])) \
        .when(t.rlike(_REFRESH), F.regexp_extract(t, _TARGET, 1))
    found = F.transform(F.filter(tags, lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH)), target)
    return F.filter(F.transform(found, lambda t: F.replace(F.trim(t), F.lit("&amp;"), F.lit("&"))), lambda t: t != "")


def resolve(target: Column, host: Column, path: Column) -> Column:
    """A target as an absolute url; null where it names no web address."""
    folder = F.regexp_extract(path, "^(.*/)", 1)
    return (F.when(target.rlike("^(?i)https?://"), target)
            .when(target.startswith("//"), F.concat(F.lit(":"), target))
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#") | (host == ""), F.lit(None))
            .when(target.startswith("/"), F.concat(F.lit("://"), host, target))
            .when(target.startswith("?"), F.concat(F.lit("://"), host, path, target))
            .otherwise(F.concat(F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), target)))


def apply_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the places (distinct host, path) that
    a rule fits: its host or a subdomain, a path that starts with the rule's;
    the longest rule wins. ``rules`` has verdict, host and path."""
    labels = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    parts = F.split("host", "\\.")
    # only suffixes as long as some rule's host
    tails = let(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - labels + 1), F.lit(labels)), lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    r = rules.select(F.col("host").alias("rhost"), F.col("path").alias("rpath"), F.col("verdict").alias("rverdict"))
    fits = (places.select("host", "path", F.explode(tails).alias("rhost")).join(r, "rhost")
            .where(F.col("path").startswith(F.col("rpath"))))
    name = F.concat("rhost", "rpath")
    return (fits.groupBy("host", "path")
            .agg(F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("rverdict").alias("v"))).alias("w"))
            .select("host", "path", F.col("w.rule").alias("rule"), F.col("w.v").alias("rule_verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict) per row of ``pages``."""
    u = F.col(url)
    rows = pages.select(F.col(key).alias("k"), host_of(u).alias("host"), path_of(u).alias("path"),
                        address(u).alias("node"), link_targets(F.col(html)).alias("targets"))
    rows = materialize(rows.withColumn("targets", F.transform(
        "targets", lambda t: resolve(t, F.col("host"), F.col("path")))), "url-pages")
    out_links = rows.where("size(targets) > 0 and node is not null").select("node", F.explode("targets").alias("target"))
    thost, tpath = place_of(host_of(F.col("target")), path_of(F.col("target")))
    out_links = materialize(out_links.select("node", address(F.col("target")).alias("to"), thost.alias("host"), tpath.alias("path"))
                            .where("to is not null").distinct(), "url-links")
    roots = materialize(connected_components(out_links, "node", "to"), "url-roots")
    places = rows.select("host", "path").unionByName(out_links.select("host", "path")).where("host <> ''").distinct()
    ruled = materialize(apply_rules(places, rules), "url-rules")
    # addresses in components, with the place that their rule depends on
    tied = rows.where("size(targets) > 0 and node is not null").select("node", "host", "path").unionByName(
        out_links.select(F.col("to").alias("node"), "host", "path")).distinct()
    bad = (tied.join(ruled.where("rule_verdict = 'block'"), ["host", "path"], "left_semi")
           .join(roots, "node").select("root").distinct())
    aliases = materialize(roots.join(bad, "root", "left_semi").select("node", F.lit(True).alias("alias")).distinct(),
                          "url-aliases")
    return (rows.join(ruled, ["host", "path"], "left").join(aliases, "node", "left")
            .select(F.col("k").alias(key), "host", "path", "rule",
                    F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict"))
                    .when(F.col("alias"), "block").otherwise("allow").alias("verdict")))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


SQL = f"""
WITH RECURSIVE rules(v, rhost, rpath) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
p0 AS (SELECT page_id, html, row_number() OVER () AS rid,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p1 AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END
    || coalesce(regexp_extract(tail, '^[^?]*(\\?.*)', 1), '') AS address FROM (SELECT page_id, rid, html,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p0)),
tags AS (SELECT rid, host, path, address, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS t
    FROM p1 WHERE html IS NOT NULL AND host <> ''),
t1 AS (SELECT rid, host, path, address, replace(trim(CASE
    WHEN regexp_matches(t, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
    THEN trim(regexp_extract(t, '(?is)\\bhref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '"''')
    WHEN regexp_matches(t, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')
    THEN regexp_extract(t, '(?is)\\bcontent\\s*=\\s*["'']?[^>]*?\\burl\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1) END), '&amp;', '&') AS g FROM tags),
t2 AS (SELECT address AS node, CASE WHEN regexp_matches(g, '^(?i)https?://') THEN substr(g, strpos(g, '://') + 3)
    WHEN starts_with(g, '//') THEN substr(g, 3)
    WHEN regexp_matches(g, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(g, '#') THEN NULL
    WHEN starts_with(g, '/') THEN host || g WHEN starts_with(g, '?') THEN host || path || g
    ELSE host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || g END AS rest FROM t1 WHERE g <> ''),
links AS (SELECT DISTINCT node, thost, tpath, CASE WHEN thost <> '' THEN thost || tpath || query END AS target FROM (
    SELECT node, regexp_replace(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        ':(80|443)$', '') AS thost, coalesce(nullif(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), ''), '/') AS tpath,
        coalesce(regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1), '') AS query FROM t2 WHERE rest IS NOT NULL)),
places AS (SELECT DISTINCT host, path FROM p1 WHERE host <> '' UNION SELECT thost, tpath FROM links WHERE thost <> ''),
ruled AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
    FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
e AS (SELECT node AS a, target AS b FROM links WHERE thost <> '' UNION SELECT target, node FROM links WHERE thost <> ''),
bad AS (SELECT DISTINCT address AS node FROM p1 JOIN ruled USING (host, path) WHERE v = 'block'
    UNION SELECT target FROM links JOIN ruled ON host = thost AND path = tpath WHERE v = 'block'),
hit(node) AS (SELECT node FROM bad UNION SELECT e.b FROM hit JOIN e ON e.a = hit.node)
SELECT page_id, p1.host, p1.path, rule, CASE WHEN v IS NOT NULL THEN v
    WHEN p1.host <> '' AND p1.address IN (SELECT node FROM hit) THEN 'block' ELSE 'allow' END AS verdict
FROM p1 LEFT JOIN ruled USING (host, path)"""
