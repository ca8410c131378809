"""Reading a ledger whose files are divided along TRANDATE."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgermatch.plans.pipeline import build_open_lines, run_match
from ledgermatch.operators.transactions import select_transactions
from ledgermatch.sources import DatePartition, read_sources

CASES = [
    (DatePartition("BY_DAY", "day"), "date", "to_date(TRANDATE)"),
    (DatePartition("BY_MONTH", "month", "%Y%m"), "int", "int(date_format(TRANDATE, 'yyyyMM'))"),
    (DatePartition("BY_YEAR", "year", "%Y"), "string", "string(year(TRANDATE))"),
]


@pytest.mark.parametrize(("partition", "kind", "value"), CASES, ids=lambda c: getattr(c, "unit", None))
def test_files_before_the_floor_are_not_read(spark, sources, cfg, tmp_path, partition, kind, value):
    # The oldest open invoice moved up, so that the floor cuts the ledger in the middle.
    middle = sources.transactions.select(F.percentile_approx("TRANDATE", 0.6)).first()[0]
    invoices = sources.invoices.withColumn("BLNPOSTED", F.when(F.col("DATINVOICEDATE") >= F.lit(middle), F.col("BLNPOSTED")).otherwise(F.lit(0)))
    paths = {}
    for name in ("invoices", "invoice_headers", "invoice_lines", "transactions"):
        paths[name] = str(tmp_path / name)
        df = invoices if name == "invoices" else getattr(sources, name)
        if name == "transactions":
            if partition.unit == "day":  # one file a day: some weeks will do
                df = df.filter(F.abs(F.datediff("TRANDATE", F.lit(middle))) < 40)
            df.withColumn(partition.column, F.expr(value)).repartition(1).write.partitionBy(partition.column).parquet(paths[name])
        else:
            df.write.parquet(paths[name])
    plain = read_sources(spark, {**paths, "transactions": paths["transactions"]}, cfg=cfg)
    src = read_sources(spark, paths, cfg=cfg, ledger_partition=partition, partition_type=kind)
    ol = build_open_lines(src, cfg)
    pruned = select_transactions(src.transactions, ol, cfg, partition=src.ledger_partition)
    whole = select_transactions(plain.transactions, ol, cfg)
    assert 0 < pruned.count() < src.transactions.count()
    assert pruned.exceptAll(whole).count() == 0 and whole.exceptAll(pruned).count() == 0

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = pruned._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan[plan.find("PartitionFilters") : plan.find("PushedFilters")]
    assert f"({partition.column}#" in filters and ">=" in filters, filters
    if partition.unit == "month":
        report = run_match(src, cfg).report
        other = run_match(plain, cfg).report
        assert report.exceptAll(other).count() == 0 and other.exceptAll(report).count() == 0


def test_start_of_the_unit(spark):
    floor = dt.datetime(2026, 3, 17, 9)
    df = spark.createDataFrame([(20260317, 202603, 2026)], "d int, m int, y int")
    for column, unit, pattern, first in (("d", "day", "%Y%m%d", 20260317), ("m", "month", "%Y%m", 202603), ("y", "year", "%Y", 2026)):
        part = DatePartition(column, unit, pattern)
        assert df.filter(part.not_before(df, floor)).count() == 1
        assert df.withColumn(column, F.lit(first - 1)).filter(part.not_before(df, floor)).count() == 0
    with pytest.raises(ValueError):
        DatePartition("d", "week")


def test_the_ledger_reads_the_lines_once(spark):
    """Amounts of whole orders come from the exchange that ranks their lines, not from a second pass over the lines."""
    from ledgermatch.sources import derive_sources

    plan = derive_sources(spark, "/root/testdata/sf0.001").transactions._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line]) == 1


def test_order_totals_with_unknown_customers_and_repeated_orders(spark, tmp_path):
    """Transactions and invoices agree on an order's amounts, also where orders repeat, lack a customer or have no key."""
    import datetime as dt

    from ledgermatch.sources import derive_sources

    day = dt.datetime(2026, 1, 5)
    orders = [(1, 1, "O", day), (1, 1, "O", day), (2, 9, "O", day), (3, None, "O", day), (None, 1, "O", day), (4, 1, "O", day), (21, 1, "O", day)]
    lines = [(k, 5, 6, n, 1.0, a, day) for k, n, a in [(1, 1, 10.5), (1, 2, None), (2, 1, 7.0), (3, 1, 8.0), (None, 1, 9.0), (4, 1, None), (21, 1, 400.0), (21, 1, 400.0)]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "C", "M")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    src = derive_sources(spark, str(tmp_path))
    invoices = {r.TXTINVOICE: r for r in src.invoices.collect()}
    assert {k: (str(r.INVAMOUNT), str(r.OUTSTANDING)) for k, r in invoices.items()} == {
        "FI000001": ("10.50", "10.50"), "FI000004": ("None", "None"), "FI000021": ("800.00", "584.00")
    }
    ledger = src.transactions.collect()
    assert sorted({r.DOCUMENT for r in ledger}) == ["D1", "D21", "D4"]
    assert sum(r.DOCUMENT == "D1" and r.SEQNUMBER == 0 for r in ledger) == 4  # two lines, two equal orders
    amounts = {str(abs(r.AMOUNT)) for r in ledger if r.DOCUMENT == "D21" and r.AMOUNT is not None}
    assert amounts <= {"800.00", "584.00", "401.00", "400.00"}
