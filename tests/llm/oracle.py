"""Rows of a query and of its SQL in DuckDB, as comparable lists."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if not isinstance(v, (int, str, bool, type(None))) else v


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def of_sql(sql, sf_dir, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, frame in tables.items():
        con.register(f"own_{name}", frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM own_{name}")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    names = sorted(columns)
    order = [columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def assert_same(df, sql, sf_dir):
    got, want = of_spark(df), of_sql(sql, sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
