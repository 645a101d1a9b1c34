"""Operator 1: conversations rebuilt from quotation links.

Each line of a message has a quote level (its leading ``>`` marks). Passages
are runs of non-blank lines of one level, their words joined by single spaces
in lower case, so a re-wrapped quote still matches. The hash of a quoted
passage, and of each of its lines, is joined to the unquoted texts of the
corpus: whole messages, their passages and their lines. The original is the
first message of the same conversation that says it, otherwise the first of
all; it must come before the quoting message in (conversation, turn) order, so
links never form a ring. A message replies to the original of its outermost
linked quote, whole passages before single lines. Reply chains are followed by
pointer doubling, and a conversation in reply order is its thread (the message
the chain starts from), then the turns.

Everything is DataFrame functions. Originals are reduced to their first
message per hash before they are joined, so a passage that half the corpus
says costs one row there, and written tables let hot hashes be split.

Defined results: null texts count as empty; rows with a null conversation or
turn are returned without links, their thread null; repeated rows all get the
same links; an empty table gives an empty result. Columns other than the four
of a message are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_az, materialize, table

_TAG = "\u0001"
_QUOTE = "^(?:[ \\t]*>)+"


def _lines(text: Column) -> Column:
    """(level, body, norm) of each line."""
    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, _QUOTE, 0)
        body = F.regexp_replace(x, _QUOTE + "[ \\t]?", "")
        norm = F.trim(F.regexp_replace(lower_az(F.replace(body, F.lit(_TAG), F.lit(" "))), "[ \\t\\x0B\\f\\r]+", " "))
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), body.alias("body"), norm.alias("norm"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\\r?\\n"), line)


def _passages(lines: Column) -> Column:
    """(level, norm) of runs of non-blank lines of one level. Lines carry their
    level at both ends; a line break between equal levels is merged away."""
    tag = lambda x: F.when(x["norm"] == "", "-").otherwise(x["level"].cast("string"))
    text = F.array_join(F.transform(lines, lambda x: F.concat(tag(x), F.lit(_TAG), x["norm"], F.lit(_TAG), tag(x))), "\n")
    merged = F.regexp_replace(text, f"{_TAG}(\\d+)\\n\\1{_TAG}", " ")
    runs = F.filter(F.split(merged, "\\n"), lambda p: ~p.startswith("-"))
    return F.transform(runs, lambda p: F.struct(F.split(p, _TAG)[0].cast("int").alias("level"), F.split(p, _TAG)[1].alias("norm")))


def _keys(lines: Column, passages: Column, quoted: bool) -> Column:
    """Hashed texts by which messages are linked: (level, rank, pos, hash); a
    lower rank is a stronger link."""
    side = (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0)
    one = lambda rank: lambda x, i: F.struct(x["level"].alias("level"), F.lit(rank).alias("rank"), i.alias("pos"),
                                             F.md5(x["norm"]).alias("hash"))
    runs = F.filter(passages, side)
    whole = F.array_join(F.transform(runs, lambda x: x["norm"]), " ")
    out = [F.transform(runs, one(1)), F.transform(F.filter(lines, lambda x: side(x) & (x["norm"] != "")), one(2))]
    if not quoted:
        out.append(F.when(F.size(runs) > 1, F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("rank"), F.lit(0).alias("pos"),
                                                             F.md5(whole).alias("hash"))))
                   .otherwise(F.filter(F.transform(runs, one(0)), lambda x: F.lit(False))))
    else:
        # all that is quoted at the outermost level, for originals with blank lines
        first = F.filter(runs, lambda x: x["level"] == 1)
        out.append(F.when(F.size(first) > 1, F.array(F.struct(
            F.lit(1).alias("level"), F.lit(0).alias("rank"), F.lit(0).alias("pos"),
            F.md5(F.array_join(F.transform(first, lambda x: x["norm"]), " ")).alias("hash"))))
            .otherwise(F.filter(F.transform(runs, one(0)), lambda x: F.lit(False))))
    return F.concat(*out)


def parse(messages: DataFrame) -> DataFrame:
    """Messages with their lines and passages taken apart: clean (the text
    without quoted lines), n_quotes, max_level, said and quoted (keys)."""
    lines = messages.select("conv_id", "turn", "role", _lines(F.col("text")).alias("l"))
    both = lines.select("*", _passages(F.col("l")).alias("p"))
    clean = F.array_join(F.transform(F.filter("l", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return both.select("conv_id", "turn", "role", F.trim(clean, F.lit(" \t\n\r")).alias("clean"),
                       F.size(F.filter("p", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"),
                       F.coalesce(F.array_max(F.transform("p", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
                       _keys(F.col("l"), F.col("p"), False).alias("said"), _keys(F.col("l"), F.col("p"), True).alias("quoted"))


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, reply_conv, reply_turn) of messages whose quotes
    have an original."""
    known = parsed.where("conv_id is not null and turn is not null")
    quotes = materialize(known.where("size(quoted) > 0").select("conv_id", "turn", F.explode("quoted").alias("q"))
                         .select("conv_id", "turn", "q.*").distinct(), "chat-quotes")
    wanted = materialize(quotes.select("hash").distinct(), "chat-hashes")
    said = known.select("conv_id", "turn", F.explode(F.array_distinct(F.transform("said", lambda k: k["hash"]))).alias("hash"))
    local = materialize(said.join(wanted, "hash", "left_semi").groupBy("hash", "conv_id")
                        .agg(F.min("turn").alias("o_turn")), "chat-local")
    first = materialize(local.groupBy("hash").agg(F.min(F.struct("conv_id", "o_turn")).alias("o"))
                        .select("hash", F.col("o.conv_id").alias("g_conv"), F.col("o.o_turn").alias("g_turn")), "chat-first")
    near = materialize(quotes.join(local, ["hash", "conv_id"], "left"), "chat-near")
    here = F.col("o_turn") < F.col("turn")
    there = (F.col("g_conv") < F.col("conv_id")) | ((F.col("g_conv") == F.col("conv_id")) & (F.col("g_turn") < F.col("turn")))
    target = (F.when(here, F.struct(F.col("conv_id").alias("c"), F.col("o_turn").alias("t")))
              .when(there, F.struct(F.col("g_conv").alias("c"), F.col("g_turn").alias("t"))))
    found = near.join(first, "hash", "left").withColumn("target", target).where("target is not null")
    order = F.struct("level", "rank", "pos", "target.c", "target.t")
    return (found.groupBy("conv_id", "turn")
            .agg(F.count(F.when(F.col("rank") == 1, 1)).alias("n_linked"), F.min(order).alias("o"))
            .select("conv_id", "turn", "n_linked", F.col("o.c").alias("reply_conv"), F.col("o.t").alias("reply_turn")))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_conv, thread_turn, depth): the message that each
    reply chain starts from, by pointer doubling."""
    cur = materialize(links.select("conv_id", "turn", F.col("reply_conv").alias("thread_conv"),
                                   F.col("reply_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "chat-thread")
    while True:
        up = cur.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"),
                        F.col("thread_conv").alias("u_conv"), F.col("thread_turn").alias("u_turn"), F.col("depth").alias("u_depth"))
        step = materialize(cur.join(up, ["thread_conv", "thread_turn"], "left").select(
            "conv_id", "turn", F.coalesce("u_conv", "thread_conv").alias("thread_conv"),
            F.coalesce("u_turn", "thread_turn").alias("thread_turn"),
            (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"), F.col("u_conv").isNotNull().alias("moved")), "chat-thread")
        cur = step.drop("moved")
        if step.where("moved").isEmpty():
            return cur


def rebuild(messages: DataFrame) -> DataFrame:
    """Messages in reply order without their quotes."""
    parsed = materialize(parse(messages), "chat-parsed")      # read for the quotes, for what is said, and for the result
    links = materialize(link(parsed), "chat-links")
    tied = materialize(links.join(threads(links), ["conv_id", "turn"]), "chat-tied")
    out = parsed.select("conv_id", "turn", "role", "clean", "n_quotes", "max_level").join(tied, ["conv_id", "turn"], "left")
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    out = out.select("conv_id", "turn", "role", F.col("clean").alias("text"), "n_quotes", "max_level",
                     F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_conv", "reply_turn",
                     F.coalesce("thread_conv", F.when(named, F.col("conv_id"))).alias("thread_conv"),
                     F.coalesce("thread_turn", F.when(named, F.col("turn"))).alias("thread_turn"),
                     F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    return out.repartitionByRange("thread_conv", "thread_turn", "conv_id", "turn").sortWithinPartitions(
        "thread_conv", "thread_turn", "conv_id", "turn")


def op1_quotation_links(spark, sf_dir: str) -> DataFrame:
    return rebuild(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l0 AS (SELECT rid, unnest(regexp_split_to_array(text, '\r?\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS i FROM m),
l AS (SELECT rid, i, length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM l0),
n AS (SELECT *, trim(regexp_replace(translate(replace(body, chr(1), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS norm FROM l),
g AS (SELECT *, sum(CASE WHEN norm <> '' AND pn <> '' AND level = pl THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run
    FROM (SELECT *, coalesce(lag(norm) OVER (PARTITION BY rid ORDER BY i), '') AS pn, lag(level) OVER (PARTITION BY rid ORDER BY i) AS pl FROM n)),
p AS (SELECT rid, run, level, string_agg(norm, ' ' ORDER BY i) AS norm FROM g WHERE norm <> '' GROUP BY rid, run, level),
said AS (SELECT rid, norm FROM p WHERE level = 0 UNION SELECT rid, norm FROM n WHERE level = 0 AND norm <> ''
    UNION SELECT rid, string_agg(norm, ' ' ORDER BY run) FROM p WHERE level = 0 GROUP BY rid HAVING count(*) > 1),
q AS (SELECT rid, level, 1 AS rank, row_number() OVER (PARTITION BY rid ORDER BY run) AS pos, norm FROM p WHERE level > 0
    UNION ALL SELECT rid, level, 2, row_number() OVER (PARTITION BY rid ORDER BY i), norm FROM n WHERE level > 0 AND norm <> ''
    UNION ALL SELECT rid, 1, 0, 0, string_agg(norm, ' ' ORDER BY run) FROM p WHERE level = 1 GROUP BY rid HAVING count(*) > 1),
o AS (SELECT norm, conv_id, turn FROM said JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
qm AS (SELECT DISTINCT conv_id, turn, level, rank, pos, norm FROM q JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
near AS (SELECT norm, conv_id, min(turn) AS t FROM o GROUP BY ALL),
firsts AS (SELECT norm, min({'c': conv_id, 't': t}) AS f FROM near GROUP BY norm),
c AS (SELECT qm.*, CASE WHEN near.t < qm.turn THEN {'c': qm.conv_id, 't': near.t}
    WHEN f < {'c': qm.conv_id, 't': qm.turn} THEN f END AS target
    FROM qm LEFT JOIN near ON near.norm = qm.norm AND near.conv_id = qm.conv_id LEFT JOIN firsts ON firsts.norm = qm.norm),
links AS (SELECT conv_id, turn, count(*) FILTER (rank = 1) AS n_linked,
    arg_min(target, {'level': level, 'rank': rank, 'pos': pos, 'c': target.c, 't': target.t}) AS target
    FROM c WHERE target IS NOT NULL GROUP BY conv_id, turn),
chain AS (SELECT conv_id, turn, target, 1::BIGINT AS depth FROM links
    UNION ALL SELECT chain.conv_id, chain.turn, links.target, depth + 1 FROM chain JOIN links
    ON links.conv_id = chain.target.c AND links.turn = chain.target.t),
tops AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(target, depth) AS top FROM chain GROUP BY conv_id, turn),
cl AS (SELECT rid, trim(string_agg(body, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM n WHERE level = 0 GROUP BY rid),
st AS (SELECT rid, count(*) FILTER (level > 0) AS n_quotes, max(level) AS max_level FROM p GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, coalesce(cl.text, '') AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes,
    coalesce(max_level, 0)::BIGINT AS max_level, coalesce(n_linked, 0)::BIGINT AS n_linked,
    links.target.c AS reply_conv, links.target.t AS reply_turn,
    CASE WHEN top IS NOT NULL THEN top.c WHEN m.turn IS NOT NULL THEN m.conv_id END AS thread_conv,
    CASE WHEN top IS NOT NULL THEN top.t WHEN m.conv_id IS NOT NULL THEN m.turn END AS thread_turn,
    coalesce(depth, 0)::BIGINT AS depth
FROM m LEFT JOIN cl USING (rid) LEFT JOIN st USING (rid) LEFT JOIN links ON links.conv_id = m.conv_id AND links.turn = m.turn
LEFT JOIN tops ON tops.conv_id = m.conv_id AND tops.turn = m.turn"""
