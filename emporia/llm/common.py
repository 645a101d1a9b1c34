"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters that separate words (fixed by the operators' contracts).
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = "abcdefghijklmnopqrstuvwxyz"
#: Code points of scripts written without spaces between words (first, last):
#: Thai, Lao, Myanmar, Khmer, Tai, Han, kana.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF),
            (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3040, 0x30FF), (0x31F0, 0x31FF),
            (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
            (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the
    body uses it inside lambdas (a plain alias may be inlined there)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER_AZ, LOWER_AZ)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage, survives lost executors, and gives joins a plain scan (which
    adaptive execution can split when a key is hot)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # once the table is written nothing needs the shuffle files behind it
    with session_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a materialized table that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path is None:
        return
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the
    smallest node of its component.

    Alternates large-star and small-star steps until the edges no longer
    change: a logarithmic number of rounds, each a partial aggregate and a
    join on the node. The minima are written before the join, so that both
    join inputs are plain exchanges and a star's centre with very many links
    is split. Null ends and self-links give no edge; an empty list gives no row.
    """
    cur = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    seen = None
    while True:
        digest = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest[0] == 0 or digest == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = digest
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select("u", F.least("u", "m").alias("m")), "cc-min")
        large = materialize(both.join(low, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = (large.join(low2, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = materialize(small, "cc-edges")
        for old in (cur, low, large, low2):
            discard(old)
        cur = nxt


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the actions inside; the caller's own are put back after.
    Workers also find this library where the driver does."""
    env, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = env.get("PYTHONPATH")
    path = known or os.environ.get("PYTHONPATH", "")
    if home not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([home, path]) if path else home
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows for this session, so that a
    Python worker holds few whole texts at a time; and workers that find this
    library where the driver does, also when it is not installed."""
    env, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([home, known]) if known else home
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself when it only selects, filters and renames what one file
    scan reads (the same rows in the same order whenever a task is run again),
    else a written copy."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("Project", "Filter"):
            if not all(node.expressions().apply(i).deterministic() for i in range(node.expressions().size())):
                return materialize(df, name)
            todo.append(node.child())
        elif not node.nodeName().startswith("LogicalRelation") and not node.nodeName().startswith("Relation"):
            return materialize(df, name)
    return df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (in any letter case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
