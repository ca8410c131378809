"""Ranks of transactions too large for one task, and the check of their ids."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import matched_results, rank_matches
from ledgermatch.operators.ranking import RANKED_COLUMNS, rank_split_matches
from ledgermatch.plans.pipeline import run_match
from ledgermatch.sources.tables import Sources


@pytest.fixture(scope="module")
def scored(spark, sources, cfg):
    """The fixture's pairs, and one transaction that has most of many."""
    base = run_match(sources, cfg).scored
    rng = random.Random(3)
    made = [(f"FI{rng.randrange(300):05d}", i, rng.randrange(7, 16)) for i in range(20_000)]
    hot = spark.createDataFrame(made, "TXTINVOICE string, FoapalLineID long, InvLineScore int")
    rest = base.filter("DCIND = 'C'").limit(1).drop("TXTINVOICE", "FoapalLineID", "InvLineScore").withColumn("TranID", F.lit(-5).cast("long"))
    ids = base.withColumn("TranID", F.when(F.col("TranID") % 9 > 0, F.col("TranID")))  # a NULL id is a group too
    return ids.unionByName(hot.crossJoin(rest).select(*base.columns))


def test_split_ranks_equal_the_windows(scored, cfg):
    plain = rank_matches(matched_results(scored, cfg))
    split = rank_split_matches(matched_results(scored, cfg, split=True))
    assert split.columns == list(RANKED_COLUMNS)
    assert plain.count() == split.count() > 20_000
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_no_task_has_the_hot_transaction(scored, cfg):
    """The windowless plan: its sort divides the hot transaction, and no operator takes one whole."""
    matched = matched_results(scored, cfg, split=True)
    order = [F.col("TranID").asc(), F.col("InvGroupScore").desc(), F.col("TXTINVOICE").asc(), F.col("InvLineScore").desc(), F.col("FoapalLineID").asc()]
    sizes = [r["count"] for r in matched.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    plan = rank_split_matches(matched)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.replace("Window [sum(_n", "").replace("windowspecdefinition(_part", "")


def test_run_match_splits_beyond_the_bound(sources, cfg):
    plain, split = run_match(sources, cfg), run_match(sources, cfg.with_(rank_max_rows=2))
    assert plain.ranked.exceptAll(split.ranked).count() == 0 and split.ranked.exceptAll(plain.ranked).count() == 0
    assert [tuple(r) for r in plain.report.collect()] == [tuple(r) for r in split.report.collect()]


def test_repeated_ids_with_matches_are_refused(sources, cfg):
    ids = run_match(sources, cfg).scored.select("TranID").limit(1)
    row = sources.transactions.join(ids, "TranID", "left_semi").select(*sources.transactions.columns)
    for again in (row, row.withColumn("DOCUMENT", F.lit("other"))):
        twice = Sources(sources.invoices, sources.invoice_headers, sources.invoice_lines, sources.transactions.unionByName(again))
        with pytest.raises(ValueError, match="not unique"):
            run_match(twice, cfg)
        assert run_match(twice, cfg, check_ids=False).report.count() > 0
    # A repeated id without any match does no harm.
    idle = sources.transactions.filter("RUCL_CODE = 'YTD'").limit(1)
    fine = Sources(sources.invoices, sources.invoice_headers, sources.invoice_lines, sources.transactions.unionByName(idle))
    assert run_match(fine, cfg).report.count() == 137
