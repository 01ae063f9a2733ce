"""Queries against their SQL, on the driver's smallest tables."""

import pytest

from folioflow.llm import registry


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    want = duck.sql(registry.ORACLES[name]).to_arrow_table()
    rows = lambda t: sorted(tuple(map(repr, r.values())) for r in t.select(sorted(t.column_names)).to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_native_plans(spark, sf_dir, name):
    if name.startswith(("op3_", "op7_")):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
