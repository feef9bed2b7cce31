"""Comparison of a query with its SQL in DuckDB, on the values of all columns by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in values)


def same(df, sql, sf_dir):
    found = connection(sf_dir).execute(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in found.description], found.fetchall())
