"""Rows of a query against the rows of its SQL in DuckDB."""

from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(row):
    return tuple(f"{v:.12g}" if isinstance(v, float) else str(v) for v in row)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(spark, sf_dir, query, sql, con=None):
    """(columns here, columns there, rows only here, rows only there)."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    here = Counter(_key(r) for r in df.select(*cols).collect())
    rel = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    there = Counter(_key([r[i] for i in order]) for r in rel.fetchall())
    return cols, sorted(names), here - there, there - here
