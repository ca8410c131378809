"""Row numbers of a global order, and the positions of the report."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import match_report, positioned_report
from ledgermatch.plans.ordering import with_position
from ledgermatch.plans.pipeline import run_match


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_position_is_the_row_number(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    order = [F.col("a").desc_nulls_first(), F.col("b").asc()]
    got = with_position(df, order, "place", partitions)
    assert got.columns == ["a", "b", "place"]
    expected = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.place)] == expected
    assert sorted(r.place for r in got.collect()) == list(range(1, 1001))


def test_no_rows(spark):
    assert with_position(spark.range(0), [F.col("id")], "place").collect() == []


def test_no_task_numbers_all_rows(spark):
    got = with_position(spark.range(5000), [F.col("id").desc()], "place", 8)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The one window in a single task is over the partitions' sizes.
    assert plan.count("Window [") <= 2 and "Window [sum(_n" in plan


def test_written_report_reads_back_in_order(spark, sources, cfg, tmp_path):
    run = run_match(sources, cfg)
    positioned_report(run.annotated, partitions=5).repartition(3).write.parquet(str(tmp_path / "report"))
    back = spark.read.parquet(str(tmp_path / "report")).orderBy("ReportPosition")
    assert [r.ReportPosition for r in back.select("ReportPosition").collect()] == list(range(1, back.count() + 1))
    plain = match_report(run.annotated).collect()
    assert [tuple(r) for r in back.drop("ReportPosition").collect()] == [tuple(r) for r in plain]
