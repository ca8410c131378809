"""Open invoice lines (operators O1-O3).

Output grain: one row per (open invoice, fund, invoice line).  Invoices must
be posted (BLNPOSTED = -1) and have OUTSTANDING > 0.  A NULL fund keeps its
fund total but finds no lines (the line join uses plain equality).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.oracle import blank_to_null, concat_text, number_text
from ..plans.joins import checked_broadcast

# --- fixed values: columns of an open line ---
OPEN_LINE_COLUMNS = (
    "TXTINVOICE", "CTRCUSTOMER", "TXTCUSTOMERNAME", "DATINVOICEDATE", "INVAMOUNT",
    "OUTSTANDING", "PAYMENTS", "ADJUSTMENTS", "TXTBATCHID", "TXTDEPT", "TXTCREATED",
    "FUND_COUNT", "FUNDLINE", "FUND", "PERFUNDTOTAL", "FUNDKEY", "FoapalLineID",
    "ACCI", "ORGN", "ACCT", "PROG", "ACTV", "LOCN", "FOAPALlineTotal", "FOAPALline",
)
LAYOUT_COLUMNS = (
    "TXTINVOICE", "FUND", "FoapalLineID", "FUND_COUNT", "FUNDLINE",
    "PERFUNDTOTAL", "FUNDKEY", "FOAPALline",
)
# --- end of fixed values ---


def fund_totals(lines: DataFrame, cfg: MatchConfig) -> DataFrame:
    """O1: SUM(CURAMOUNT) per (invoice, fund); NULL fund is one group.

    A plain grouped sum: Spark adds a map-side partial aggregate, so a hot
    invoice or fund is combined before the shuffle.
    """
    lines = blank_to_null(lines.select("TXTINVOICE", "FUND", "CURAMOUNT"))
    return lines.groupBy("TXTINVOICE", "FUND").agg(
        F.sum("CURAMOUNT").cast(cfg.total_type).alias("PERFUNDTOTAL")
    )


def open_invoices(invoices: DataFrame) -> DataFrame:
    """Posted invoices with a balance; both predicates reach the scan."""
    return invoices.filter((F.col("BLNPOSTED") == -1) & (F.col("OUTSTANDING") > 0))


def fund_layout(totals: DataFrame) -> DataFrame:
    """O3 on the fund aggregate: FUND_COUNT, FUNDLINE and FUNDKEY per fund row.

    Computed on one row per (invoice, fund) rather than per line, so the
    windows see a handful of rows per invoice however many lines it has.
    COUNT(DISTINCT fund) equals the count of non-NULL fund rows here.
    """
    w = Window.partitionBy("TXTINVOICE")
    return totals.select(
        "TXTINVOICE",
        "FUND",
        "PERFUNDTOTAL",
        F.count("FUND").over(w).cast("bigint").alias("FUND_COUNT"),
        F.dense_rank().over(w.orderBy(F.col("FUND").asc_nulls_last())).cast("bigint").alias("FUNDLINE"),
        concat_text(F.col("FUND"), number_text(F.col("PERFUNDTOTAL"))).alias("FUNDKEY"),
    )


def open_invoice_lines(
    invoices: DataFrame,
    headers: DataFrame,
    lines: DataFrame,
    cfg: MatchConfig,
) -> DataFrame:
    """O2 (+O3 columns): the open invoice lines every later step matches against.

    The open invoices are few; their keys are broadcast (size-checked) to
    semi-join the header and line tables first, so the fund aggregate, the
    joins and the windows only ever touch lines of open invoices.
    """
    inv = blank_to_null(open_invoices(invoices))
    keys, _ = checked_broadcast(inv.select("TXTINVOICE").distinct(), cfg.broadcast_max_rows, cfg.broadcast_max_bytes)
    hdr = blank_to_null(headers.join(keys, "TXTINVOICE", "left_semi").select("TXTINVOICE", "TXTCREATED"))
    inv_lines = blank_to_null(lines.join(keys, "TXTINVOICE", "left_semi"))

    funds = fund_layout(fund_totals(inv_lines, cfg))
    ln = inv_lines.select(
        F.col("TXTINVOICE").alias("_ln_inv"),
        F.col("FUND").alias("_ln_fund"),
        F.col("CTRINVA").alias("FoapalLineID"),
        "ACCI", "ORGN", "ACCT", "PROG", "ACTV", "LOCN",
        F.col("CURAMOUNT").alias("FOAPALlineTotal"),
    )
    j = (
        inv.join(hdr, "TXTINVOICE", "left")
        .join(funds, "TXTINVOICE", "left")
        .join(ln, (F.col("TXTINVOICE") == F.col("_ln_inv")) & (F.col("FUND") == F.col("_ln_fund")), "left")
    )
    # The code order alone is not unique: the line id breaks ties.
    w_line = Window.partitionBy("TXTINVOICE", "FUND").orderBy(
        *[F.col(c).asc_nulls_last() for c in ("ORGN", "ACCT", "PROG", "ACTV", "LOCN", "FoapalLineID")]
    )
    j = j.withColumn("FOAPALline", F.row_number().over(w_line).cast("bigint"))
    # An invoice without any line has no fund row: zero funds, rank 1.
    j = j.withColumn("FUND_COUNT", F.coalesce("FUND_COUNT", F.lit(0).cast("bigint")))
    j = j.withColumn("FUNDLINE", F.coalesce("FUNDLINE", F.lit(1).cast("bigint")))
    return j.select(*OPEN_LINE_COLUMNS)
