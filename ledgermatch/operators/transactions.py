"""Ledger transactions: normalise (O4), pre-filter (O5), token flag (O6)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.oracle import blank_to_null, upper_text
from ..functions.tokens import invoice_token_flag
from ..sources.tables import DatePartition
from .open_side import OpenSide, survey_open_lines

# --- fixed values: columns of the ledger ---
TX_COLUMNS = (
    "TranID", "CHART", "ACCI", "FUND", "ORGN", "ACCT", "PROG", "ACTV", "LOCN",
    "AMOUNT", "DESCRIPTION", "TRANDATE", "DCIND", "DOCUMENT", "DOCREFNUM",
    "SEQNUMBER", "RUCL_CODE", "USER_ID",
)
# --- end of fixed values ---


def rename_ledger(raw: DataFrame, colmap: dict[str, str] | None = None) -> DataFrame:
    """The matcher's columns of a ledger with names of its own.

    ``colmap`` maps source column -> matcher column; matcher columns that it
    does not name are taken under their own names.  Plain aliases: predicates
    on the new names reach the scan as predicates on the old ones.
    """
    source = {dst: src for src, dst in (colmap or {}).items()}
    unknown = set(source) - set(TX_COLUMNS)
    if unknown:
        raise ValueError(f"no such ledger columns: {sorted(unknown)}")
    return raw.select(*[F.col(source.get(c, c)).alias(c) for c in TX_COLUMNS])


def normalize_transactions(raw: DataFrame, colmap: dict[str, str] | None = None) -> DataFrame:
    """O4: rename source columns to the matcher's names and upper-case the text; '' becomes NULL."""
    tx = blank_to_null(rename_ledger(raw, colmap))
    return tx.withColumn("upperDescription", upper_text(F.col("DESCRIPTION")))


def ts_literal(value: _dt.datetime) -> Column:
    """A timestamp_ntz literal (folds to a constant, so it reaches the scan)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_floor(oldest: _dt.datetime | None, cfg: MatchConfig) -> _dt.datetime | None:
    """Oldest open invoice date minus the grace period (None: no open invoice).

    Applied as a literal, it lets Parquet skip row groups (and a
    date-partitioned ledger skip partitions), which a scalar subquery does not.
    """
    return None if oldest is None else oldest - _dt.timedelta(days=cfg.grace_days)


def prefilter_transactions(tx: DataFrame, open_lines: DataFrame, cfg: MatchConfig, side: OpenSide | None = None) -> DataFrame:
    """O5: rule class allowed, account not excluded, date not before the floor.

    Gives the same rows on the raw ledger and on the normalised one ('' and
    NULL behave alike in every predicate), so apply it to the raw scan
    first: then all three predicates reach the Parquet reader
    (``PushedFilters``) and are not hidden behind the '' -> NULL rewrite.
    """
    floor = date_floor((side or survey_open_lines(open_lines, cfg)).oldest, cfg)
    if floor is None:
        return tx.filter(F.lit(False))
    rules = [r for r in cfg.rule_classes if r]
    cond = F.col("RUCL_CODE").isin(rules) & (F.col("TRANDATE") >= ts_literal(floor))
    if cfg.excluded_accounts:
        # NOT IN drops NULL accounts too, as in SQL; an empty account is NULL.
        cond = cond & (F.col("ACCT") != "") & ~F.col("ACCT").isin(list(cfg.excluded_accounts))
    return tx.filter(cond)


def select_transactions(
    raw: DataFrame,
    open_lines: DataFrame,
    cfg: MatchConfig,
    side: OpenSide | None = None,
    colmap: dict[str, str] | None = None,
    partition: DatePartition | None = None,
) -> DataFrame:
    """O4 + O5: pre-filter the ledger (pushed down, under its own names), then normalise.

    ``partition`` says by which column of ``raw`` the ledger's files are divided
    along TRANDATE: files wholly before the date floor are not read.
    """
    side = side or survey_open_lines(open_lines, cfg)
    floor = date_floor(side.oldest, cfg)
    if partition is not None and floor is not None:
        raw = raw.filter(partition.not_before(raw, floor))
    return normalize_transactions(prefilter_transactions(rename_ledger(raw, colmap), open_lines, cfg, side))


def with_token_flag(tx: DataFrame, cfg: MatchConfig) -> DataFrame:
    """O6: ``fi_flag`` = the description holds an invoice-like token.

    Evaluated once per transaction and carried as a column, so the regex
    never runs again for the pair stage.
    """
    return tx.withColumn("fi_flag", invoice_token_flag(F.col("upperDescription"), cfg))
