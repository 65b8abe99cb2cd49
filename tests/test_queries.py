"""Every query with SQL gives DuckDB's rows on the smallest tables; queries without SQL and some rules are tested apart."""

import duckdb
import pytest

from runlens import catalog
from runlens.operators import guards

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(list(value) if isinstance(value, (list, tuple)) else value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    told = duck.execute(catalog.SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in told.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(want)


def test_approximate_search_finds_nearly_all(spark):
    exact = {(r["query"], r["id"]) for r in catalog.QUERIES["knn_exact_many"](spark, DATA).collect()}
    got = {(r["query"], r["id"]) for r in catalog.QUERIES["knn_ann_rerank"](spark, DATA).collect()}
    assert len(exact & got) >= 0.9 * len(exact) > 0


@pytest.mark.parametrize(("calls", "chars", "axis", "wanted"), [(150, 0, "calls", [150]), (60, 20_000, "result_chars", [500_000]), (23, 20_000, "result_chars", []), (1, 4_000_000, "result_chars", [3_000_000])])
def test_default_budgets(spark, calls, chars, axis, wanted):
    rows = [("r", "t", i, None, chars) for i in range(calls)]
    events = spark.createDataFrame(rows, "run_id string, task_id string, event_id long, event string, res_chars long").selectExpr("*", "timestamp_seconds(event_id) AS ts")
    thresholds = guards.CALLS if axis == "calls" else guards.RESULT_CHARS
    assert [r["threshold"] for r in guards.budget_events(events, axis, thresholds).collect()] == wanted
