"""Ledger fixtures derived from the TPC-H-style test tables.

The matcher's inputs (invoices, headers, invoice lines, ledger
transactions) are derived deterministically from ``lineitem``, ``orders``
and ``customer``, with integer-modulo rules that a SQL engine can reproduce
exactly (the DuckDB oracle in ``__spark_entry__`` does).  The derivation is
a plain DataFrame plan: it scales with the input tables and needs no
driver-side data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.oracle import plus_days
from .tables import Sources, conform

# --- fixed values of the fixture derivation ---
FIXTURE_EXCLUDED_ACCOUNTS = ("A11",)
INVOICE_PREFIX = "FI"
OTHER_PREFIX = "QX"
# Least number of digits after the prefix, by order key modulo 300; else 6.
INVOICE_WIDTHS = {100: 5, 200: 7}
# An invoice line's id is its order key times this (odd, so that its remainders vary), plus its rank.
LINE_SPAN = 1_000_001
# --- end of fixed values ---


def fixture_config(**changes) -> MatchConfig:
    """Default model settings plus the fixture's excluded account list."""
    return MatchConfig(excluded_accounts=FIXTURE_EXCLUDED_ACCOUNTS).with_(**changes)


def _s(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), col.cast("string"))


def _invoice_no(orderkey) -> F.Column:
    """Prefix and zero-padded order key; a key longer than its width is kept whole."""
    width = F.lit(6)
    for rest, digits in INVOICE_WIDTHS.items():
        width = F.when(orderkey % 300 == rest, digits).otherwise(width)
    text = orderkey.cast("string")
    prefix = F.when(orderkey % 200 == 101, OTHER_PREFIX).otherwise(INVOICE_PREFIX)
    return F.concat(prefix, F.lpad(text, F.greatest(width, F.length(text)), F.lit("0")))


def derive_invoice_lines(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_shipdate",
    )
    # (orderkey, linenumber) is not unique in the test data: rank within the order.
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    li = li.withColumn("rn", F.row_number().over(w))
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    amount = F.col("l_extendedprice").cast("decimal(12,2)")
    return li.select(
        "l_orderkey",
        _invoice_no(F.col("l_orderkey")).alias("TXTINVOICE"),
        (F.col("l_orderkey") * LINE_SPAN + F.col("rn")).cast("bigint").alias("CTRINVA"),
        F.when(pk % 97 == 0, F.lit(None)).when(pk % 89 == 0, "").otherwise(_s("F", sk % 20)).alias("FUND"),
        F.when(pk % 31 == 0, "").otherwise(_s("O", pk % 40)).alias("ORGN"),
        _s("A", pk % 12).alias("ACCT"),
        _s("P", sk % 6).alias("PROG"),
        F.when(ln % 3 == 0, _s("V", pk % 5)).alias("ACTV"),
        F.when(ln % 4 == 0, _s("L", sk % 5)).when(ln % 4 == 1, "").alias("LOCN"),
        _s("I", pk % 60).alias("ACCI"),
        amount.alias("CURAMOUNT"),
        # Of the whole order, from the exchange that ranks its lines.
        F.sum(amount).over(Window.partitionBy("l_orderkey")).cast("decimal(12,2)").alias("INVAMOUNT"),
    )


def _invoice_date() -> F.Column:
    hours = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return (F.col("o_orderdate").cast("timestamp_ntz") + hours).alias("DATINVOICEDATE")


def _settled() -> tuple[F.Column, F.Column, F.Column]:
    """OUTSTANDING, PAYMENTS and ADJUSTMENTS of an order by its key and INVAMOUNT."""
    ok = F.col("o_orderkey")
    payments = F.when(ok % 3 == 0, F.floor(F.col("INVAMOUNT") / 4)).otherwise(F.lit(0)).cast("decimal(12,2)")
    adjustments = F.when(ok % 7 == 0, -F.floor(F.col("INVAMOUNT") / 50)).otherwise(F.lit(0)).cast("decimal(12,2)")
    outstanding = (F.col("INVAMOUNT") - payments + adjustments).cast("decimal(12,2)")
    return outstanding.alias("OUTSTANDING"), payments.alias("PAYMENTS"), adjustments.alias("ADJUSTMENTS")


def billed_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The orders of known customers."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = customer.select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey)


def derive_invoices(orders: DataFrame, customer: DataFrame, lines: DataFrame) -> DataFrame:
    totals = lines.groupBy("l_orderkey").agg(F.sum("CURAMOUNT").cast("decimal(12,2)").alias("INVAMOUNT"))
    ok = F.col("o_orderkey")
    inv = billed_orders(orders, customer).join(totals, ok == F.col("l_orderkey"))
    return inv.select(
        ok.alias("okey"),
        _invoice_no(ok).alias("TXTINVOICE"),
        F.col("o_custkey").alias("CTRCUSTOMER"),
        F.col("c_name").alias("TXTCUSTOMERNAME"),
        _invoice_date(),
        "INVAMOUNT",
        *_settled(),
        F.when((F.col("o_orderstatus") != "F") & (ok % 100 < 2), F.lit(-1)).otherwise(F.lit(0)).alias("BLNPOSTED"),
        _s("B", ok % 50).alias("TXTBATCHID"),
        F.col("c_mktsegment").alias("TXTDEPT"),
    )


def derive_invoice_headers(invoices: DataFrame) -> DataFrame:
    return invoices.select("TXTINVOICE", _s("user", F.col("okey") % 10).alias("TXTCREATED"))


def derive_transactions(orders: DataFrame, customer: DataFrame, lines: DataFrame) -> DataFrame:
    dated = billed_orders(orders, customer).select("o_orderkey", _invoice_date())
    base = lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
    base = base.select("*", F.col("o_orderkey").alias("okey"), _settled()[0])
    k = F.col("CTRINVA")
    # r = 0: the credit; r = 1 / 2: reversing debits for every 4th / 8th line.
    reps = F.when(k % 8 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(
        k % 4 == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    t = base.withColumn("r", F.explode(reps))
    inv_no, r = F.col("TXTINVOICE"), F.col("r")
    sel = (F.col("okey") + k) % 6
    amount = (
        F.when(k % 29 == 0, F.lit(None))
        .when(sel == 0, F.col("INVAMOUNT"))
        .when(sel == 1, F.col("OUTSTANDING"))
        .when(sel == 2, F.col("CURAMOUNT") + 1)
        .when(sel == 3, -F.col("CURAMOUNT"))
        .otherwise(F.col("CURAMOUNT"))
    )
    d = k % 11
    desc = (
        F.when(k % 22 == 0, "")
        .when(d == 0, F.lit(None).cast("string"))
        .when(d == 1, F.concat(F.lit("Payment "), inv_no))
        .when(d == 2, F.concat(F.lit("pmt "), F.replace(F.lower(inv_no), F.lit("fi00"), F.lit("fi0o")), F.lit(" rcvd")))
        .when(d == 3, F.concat(F.lit("FI"), F.substr(inv_no, F.lit(4)), F.lit(" check")))
        .when(d == 4, F.lit("Fish and Chips"))
        .when(d == 5, F.concat(F.lit("FISHING1 "), inv_no))
        .when(d == 6, F.concat(F.lit("X"), inv_no))
        .when(d == 7, F.concat(F.lit("("), inv_no, F.lit(")")))
        .when((d == 8) & (k % 2 == 0), F.concat(F.lit("FI77777 and "), inv_no, F.lit(" "), inv_no))
        .otherwise(F.concat(F.lit("deposit "), k.cast("string")))
    )
    rucl = F.when(k % 9 == 0, F.lit("YTD")).when(k % 9 == 1, F.lit("RCP")).otherwise(F.lit("JE16"))
    date = F.when(k % 41 != 0, plus_days(F.col("DATINVOICEDATE"), (k * 7) % 75 - 20))
    return t.select(
        (k * 10 + r).cast("bigint").alias("TranID"),
        F.lit("U").alias("CHART"),
        F.when(k % 7 == 0, F.lit("IX")).otherwise(F.col("ACCI")).alias("ACCI"),
        F.when(k % 5 == 0, F.lit("FX")).otherwise(F.col("FUND")).alias("FUND"),
        F.when(k % 4 == 0, F.lit("OX")).otherwise(F.col("ORGN")).alias("ORGN"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 19 == 0, "").otherwise(F.col("ACCT")).alias("ACCT"),
        "PROG", "ACTV", "LOCN",
        amount.cast("decimal(12,2)").alias("AMOUNT"),
        desc.alias("DESCRIPTION"),
        date.alias("TRANDATE"),
        F.when(r == 0, F.lit("C")).otherwise(F.lit("D")).alias("DCIND"),
        _s("D", F.col("okey")).alias("DOCUMENT"),
        _s("R", k).alias("DOCREFNUM"),
        r.cast("int").alias("SEQNUMBER"),
        rucl.alias("RUCL_CODE"),
        _s("u", k % 13).alias("USER_ID"),
    )


def derive_sources(spark: SparkSession, sf_dir: str, cfg: MatchConfig | None = None) -> Sources:
    """The four matcher inputs, derived from ``{sf_dir}/*.parquet``."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    lines = derive_invoice_lines(read("lineitem"))
    orders, customer = read("orders"), read("customer")
    invoices = derive_invoices(orders, customer, lines)
    headers = derive_invoice_headers(invoices)
    tx = derive_transactions(orders, customer, lines)
    return Sources(
        invoices=conform(invoices, "invoices", cfg),
        invoice_headers=conform(headers, "invoice_headers", cfg),
        invoice_lines=conform(lines, "invoice_lines", cfg),
        transactions=conform(tx, "transactions", cfg),
    )
