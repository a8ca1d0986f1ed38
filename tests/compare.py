"""Compare a query with its SQL in DuckDB, as sets of rows with columns by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def both(spark, sf_dir, con, query, sql):
    """Two sorted lists of rows."""
    df = query(spark, sf_dir)
    found = con.sql(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in (dict(zip(names, r, strict=True))[c] for c in order)) for r in found.fetchall()), key=repr)
    return ours, theirs
