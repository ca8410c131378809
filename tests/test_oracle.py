"""Every queries() key against its DuckDB oracle SQL (as the driver checks it), sf0.001."""

import pytest

import __spark_entry__ as E

from .conftest import SF0001
from .oracle_compare import compare


@pytest.mark.parametrize("key", list(E.oracle_sql()))
def test_query_matches_oracle(spark, key):
    res = compare(spark, SF0001, [key], verbose=False)[key]
    assert res["names_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["values_match"], res


OWN = [k for k in E.queries() if not k.startswith("op") and k != "pipeline" or k.startswith("open_")]


def test_every_query_of_the_match_has_oracle():
    assert len(OWN) == 20 and set(OWN) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", OWN)
def test_query_without_broadcasts_matches_oracle(spark, key, monkeypatch):
    """Every size switch on its other side, and no broadcast by Spark itself."""
    plain = E.fixture_config
    monkeypatch.setattr(E, "fixture_config", lambda: plain(broadcast_max_rows=0))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        res = compare(spark, SF0001, [key], verbose=False)[key]
    finally:
        for n in names:
            spark.conf.unset(n)
    assert res["names_match"] and res["values_match"], res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert len(df.columns) == 46
    assert df.count() == 137


def test_each_oracle_holds_only_what_it_needs():
    sql = E.oracle_sql()
    assert "f_tx AS" not in sql["fund_totals"] and "scored AS" not in sql["code_pair_signal"]
    assert "annotated AS" in sql["match_report"] and "annotated AS" not in sql["ranked_matches"]
