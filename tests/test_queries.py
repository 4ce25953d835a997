import pytest

from ledgerloom.plans.catalog import QUERIES, SQL

from .oracle import TABLES, of_spark, of_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    got, want = of_spark(QUERIES[name](spark, sf_dir)), of_sql(SQL[name], sf_dir)
    assert got[0] == want[0]
    assert got[1], "no rows"
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(5).collect()


def test_questions_against_the_tables(spark, sf_dir):
    """Each answer of question_synthesis, worked out anew from the orders and the question's words."""
    import re

    import pandas as pd

    orders = pd.read_parquet(f"{sf_dir}/orders.parquet").sort_values("o_orderkey")
    tables = {}
    for customer, g in orders.groupby("o_custkey"):
        rows = [
            {"amount": f"{r.o_totalprice:.2f}", "day": f"{r.o_orderdate:%Y-%m-%d}", "id": str(r.o_orderkey), "priority": r.o_orderpriority, "status": r.o_orderstatus} for r in g.itertuples()
        ]
        tables[customer] = rows[:20]
    seen = set()
    for r in QUERIES["question_synthesis"](spark, sf_dir).collect():
        rows = tables[r.o_custkey]
        if r.kind == "count-where":
            value, column = re.search(r'with the value (.*) for "(.*)"\.', r.text).groups()
            want = str(sum(x[column] == value for x in rows))
        elif r.kind == "argmax":
            name, column = re.search(r'Give the "(.*?)" of .* with the greatest "(.*)"\.', r.text).groups()
            best = sorted(rows, key=lambda x: float(x[column]))
            assert len(rows) == 1 or float(best[-1][column]) > float(best[-2][column])
            want = best[-1][name]
        else:
            column, name, value = re.search(r'which value of "(.*?)" belongs to the entry with "(.*?)" (.*)\? Say', r.text).groups()
            (want,) = [x[column] for x in rows if x[name] == value]
        assert r.answer == want, r
        seen.add(r.kind)
    assert {"count-where", "argmax", "lookup"} <= seen


@pytest.mark.parametrize("copies", [0, 2])
def test_primer_rule_on_more_events_and_none(spark, sf_dir, tmp_path, copies):
    """The events with shifted keys, so that verdicts rank apart, and without a row, so that no model has pairs."""
    import duckdb

    for t in set(TABLES) - {"events"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    shifted = f"SELECT event_id + i * 11000 AS event_id, * EXCLUDE (event_id, i) FROM '{sf_dir}/events.parquet', range(0, {copies}) c(i)"
    duckdb.sql(f"COPY ({shifted}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = of_spark(QUERIES["primer_rule"](spark, str(tmp_path))), of_sql(SQL["primer_rule"], str(tmp_path))
    assert got == want
