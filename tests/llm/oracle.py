"""Runs a registered query and its SQL on one folder of tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), sorted((tuple(fix(r[i]) for i in by) for r in rows), key=repr)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    want = rows_of([d[0] for d in got.description], got.fetchall())
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    assert have[1] == want[1]
