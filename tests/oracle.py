"""Rows of a query and of its SQL in DuckDB, compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)


def of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    names = sorted(columns)
    order = [columns.index(c) for c in names]
    return names, sorted(([plain(r[i]) for i in order] for r in cur.fetchall()), key=repr)
