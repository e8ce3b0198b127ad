"""Every query with SQL, against DuckDB on the same tables."""

import datetime

import duckdb
import pytest

from latticework.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, sf, oracle, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    res = oracle.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if n.endswith(("_nb_probability", "_nb_probabilities", "discriminant_probabilities"))))
def test_scores_are_made_once_a_distinct_row(spark, sf, name):
    """No score (they take exponentials or logarithms) is made below the distinct."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan
    below = plan[plan.rindex("Aggregate") :].split("\n", 1)[1]
    assert "EXP(" not in below.upper() and "array_max" not in below
