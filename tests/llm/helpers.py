"""Fixtures as parquet folders, and their DuckDB oracles."""

from __future__ import annotations

import collections
import os

import duckdb

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def write(spark, folder, name, rows, schema=None, files=1):
    """One table of a test input; rows may be shorter than the schema."""
    schema = schema or SCHEMAS[name]
    width = schema.count(",") + 1
    rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
    spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def oracle(sql, folder):
    con = duckdb.connect()
    for name in SCHEMAS:
        if os.path.exists(f"{folder}/{name}.parquet"):
            path = f"{folder}/{name}.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), collections.Counter(tuple(r[i] for i in order) for r in cur.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def same(query, sql, spark, folder):
    got, want = rows_of(query(spark, str(folder))), oracle(sql, str(folder))
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:5], list((want[1] - got[1]).items())[:5])
    return got[1]
