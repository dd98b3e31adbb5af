import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from transcriptlab.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if "float" in kind:
            df[c] = df[c].astype(float).round(4)
        elif "datetime" in kind or c in ("day", "start"):
            df[c] = pd.to_datetime(df[c]).dt.tz_localize(None)
    return sorted(map(repr, (tuple(str(x) for x in row) for row in df.itertuples(index=False))))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    con.execute(SQL[name])
    assert plain(got) == plain(con.fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "part"), [("structure_rules", "readme.md"), ("reject_histogram", "empty-final")])
def test_rows_are_worked_on_once(spark, name, part):
    """No filter of the plan that Spark derives from an explode does the work of the rows again."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if x.strip(" :+-").startswith("Filter") and part in x] and sum(part in x for x in plan) == 1


def test_drafts_are_made_and_moved_once(spark):
    """The times of drafts take one look at them, and their words move before they are repeated."""
    query = QUERIES["first_times"](spark, DATA)._jdf.queryExecution()
    assert sum("Generate explode(" in x for x in query.optimizedPlan().toString().splitlines()) == 1
    parts = query.executedPlan().toString()
    assert "Window" in parts and "Exchange" not in parts[parts.index("Window") : parts.index("Generate explode(")]
