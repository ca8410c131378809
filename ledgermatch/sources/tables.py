"""Source tables of the matcher: schemas, readers and normalisation.

Four relations feed the matcher: ``invoices`` (one row per invoice),
``invoice_headers`` (creator of each invoice), ``invoice_lines`` (accounting
lines) and ``transactions`` (the ledger).  They are read as DataFrames with
an explicit schema and money columns are cast to exact decimals.  Empty
text is turned into NULL by the operators (``normalize_transactions`` for
the ledger, after the pushed-down pre-filter; ``open_invoice_lines`` and
``fund_totals`` for the invoice side), so predicates on raw columns still
reach the Parquet reader.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MatchConfig

INVOICES_SCHEMA = (
    "TXTINVOICE string not null, CTRCUSTOMER bigint, TXTCUSTOMERNAME string, "
    "DATINVOICEDATE timestamp_ntz not null, INVAMOUNT decimal(12,2), "
    "OUTSTANDING decimal(12,2), PAYMENTS decimal(12,2), ADJUSTMENTS decimal(12,2), "
    "BLNPOSTED int not null, TXTBATCHID string, TXTDEPT string"
)
INVOICE_HEADERS_SCHEMA = "TXTINVOICE string not null, TXTCREATED string"
INVOICE_LINES_SCHEMA = (
    "TXTINVOICE string not null, CTRINVA bigint not null, FUND string, ORGN string, "
    "ACCT string, PROG string, ACTV string, LOCN string, ACCI string, "
    "CURAMOUNT decimal(12,2) not null"
)
TRANSACTIONS_SCHEMA = (
    "TranID bigint not null, CHART string, ACCI string, FUND string, ORGN string, "
    "ACCT string, PROG string, ACTV string, LOCN string, AMOUNT decimal(12,2), "
    "DESCRIPTION string, TRANDATE timestamp_ntz, DCIND string not null, "
    "DOCUMENT string, DOCREFNUM string, SEQNUMBER int, RUCL_CODE string, USER_ID string"
)

SCHEMAS = {
    "invoices": INVOICES_SCHEMA,
    "invoice_headers": INVOICE_HEADERS_SCHEMA,
    "invoice_lines": INVOICE_LINES_SCHEMA,
    "transactions": TRANSACTIONS_SCHEMA,
}

MONEY_COLUMNS = {
    "invoices": ("INVAMOUNT", "OUTSTANDING", "PAYMENTS", "ADJUSTMENTS"),
    "invoice_lines": ("CURAMOUNT",),
    "transactions": ("AMOUNT",),
}


@dataclass(frozen=True)
class DatePartition:
    """A partition column of the ledger that follows TRANDATE.

    Its value is the start of TRANDATE's day, month or year (``unit``): a date,
    or that date written by ``pattern`` (of ``strftime``; its order must be that
    of the dates, as in ``%Y%m``) in the column's own type.
    """

    column: str
    unit: str = "month"
    pattern: str | None = None

    def __post_init__(self):
        if self.unit not in ("day", "month", "year"):
            raise ValueError(f"no such unit: {self.unit!r}")

    def not_before(self, ledger: DataFrame, floor: dt.datetime) -> Column:
        """What the partitions with any date from ``floor`` on have in common; a literal, so that it prunes files."""
        start = dt.date(floor.year, floor.month if self.unit != "year" else 1, floor.day if self.unit == "day" else 1)
        value = start.strftime(self.pattern) if self.pattern else start.isoformat()
        return F.col(self.column) >= F.lit(value).cast(ledger.schema[self.column].dataType)


@dataclass(frozen=True)
class Sources:
    """The four tables; ``ledger_partition`` names a further column of ``transactions`` that divides its files."""

    invoices: DataFrame
    invoice_headers: DataFrame
    invoice_lines: DataFrame
    transactions: DataFrame
    ledger_partition: DatePartition | None = None


def table_schema(table: str, cfg: MatchConfig | None = None, colmap: dict[str, str] | None = None) -> T.StructType:
    """The table's schema with the configured money type, under the source's column names."""
    source = {dst: src for src, dst in (colmap or {}).items()}
    money = T.DecimalType(cfg.money_precision, cfg.money_scale) if cfg else None
    fields = []
    for f in T.StructType.fromDDL(SCHEMAS[table]).fields:
        kind = money if money and f.name in MONEY_COLUMNS.get(table, ()) else f.dataType
        fields.append(T.StructField(source.get(f.name, f.name), kind, f.nullable))
    return T.StructType(fields)


def conform(
    df: DataFrame, table: str, cfg: MatchConfig | None = None, colmap: dict[str, str] | None = None, further: Sequence[str] = ()
) -> DataFrame:
    """Project ``df`` onto the table's schema: names, column order and types; ``further`` columns stay as they are."""
    raw = table_schema(table, cfg, colmap).fields
    names = table_schema(table, cfg).names
    return df.select(*[F.col(f.name).cast(f.dataType).alias(n) for f, n in zip(raw, names, strict=True)], *further)


def read_sources(
    spark: SparkSession,
    paths: dict[str, str],
    fmt: str = "parquet",
    cfg: MatchConfig | None = None,
    colmaps: dict[str, dict[str, str]] | None = None,
    ledger_partition: DatePartition | None = None,
    partition_type: str = "date",
) -> Sources:
    """Read the four tables from files (any Spark batch format) or tables.

    ``paths`` maps table name to a path, or to ``table:<name>`` for a
    catalog table; ``colmaps`` maps a table name to its renamed columns
    (source column -> matcher column).  Money is read with ``cfg.money_type``.
    Columns are pruned and filters pushed down by Catalyst.
    ``ledger_partition`` declares the column that divides the ledger's files
    along TRANDATE (in files of type ``partition_type``); ``run_match`` then
    reads only those from the date floor on.
    """
    frames = {}
    for name in SCHEMAS:
        loc, colmap = paths[name], (colmaps or {}).get(name)
        if loc.startswith("table:"):
            raw = spark.table(loc[len("table:"):])
        else:
            schema = table_schema(name, cfg, colmap)
            if name == "transactions" and ledger_partition:
                schema.fields.append(T.StructField(ledger_partition.column, T.StructType.fromDDL(f"c {partition_type}")[0].dataType))
                schema = T.StructType(schema.fields)
            raw = spark.read.format(fmt).schema(schema).load(loc)
        further = [ledger_partition.column] if name == "transactions" and ledger_partition else []
        frames[name] = conform(raw, name, cfg, colmap, further)
    return Sources(**frames, ledger_partition=ledger_partition)
