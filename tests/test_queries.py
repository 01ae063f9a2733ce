"""Every registered query of the document dataflow against its SQL."""

import duckdb
import pytest

from folioflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(map(repr, r.values())) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
        assert got.num_rows > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_stay_narrow(spark, sf_dir):
    """Numbering and packing need no shuffle; scans read only what they use."""
    from folioflow.plans.segment_queries import chunk_assignment

    plan = chunk_assignment(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "n_chars" not in plan
