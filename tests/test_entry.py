import importlib
import sys

import pytest


def test_registry_is_consistent():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert len(names) > 80


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_entry_without_the_llm_subpackage(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("quaestor.llm") or m == "corpus_pipeline"]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "quaestor.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "pipeline" not in e.queries() and "activity_pivot_report" in e.queries()
    sys.modules.pop("__spark_entry__")


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("family", ["indexes", "joins", "aggregates", "ordered", "scalars", "changes"])
def test_queries_match_sql(spark, sf, family):
    duckdb = pytest.importorskip("duckdb")
    from quaestor import bindings

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    module = importlib.import_module(f"quaestor.plans.{family}")
    for name in [n for n in bindings.ORACLES if hasattr(module, n)]:
        df = bindings.QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
        result = con.execute(bindings.ORACLES[name])
        named = [c[0] for c in result.description]
        assert sorted(named) == columns, name
        want = sorted(tuple(normal(r[named.index(c)]) for c in columns) for r in result.fetchall())
        assert got == want, name


def test_every_query_of_the_model_has_sql():
    from quaestor import bindings

    assert set(bindings.QUERIES) == set(bindings.ORACLES)


@pytest.mark.parametrize("name", ["activity_pivot_report", "interval_join_first", "pairwise_cosine", "cooccurrence_pairs", "entity_resolution_cascade"])
def test_plans_have_no_cartesian_product(spark, sf, name):
    from quaestor import bindings

    assert "CartesianProduct" not in bindings.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
