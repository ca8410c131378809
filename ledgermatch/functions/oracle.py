"""Column expressions that reproduce the source database's text/NULL rules.

The original report ran on a database where the empty string is NULL,
``NULL || 'x'`` is ``'x'`` and numbers print without trailing zeros.  Spark
differs on each point, so these helpers restore the original behaviour with
built-in functions only (they stay inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(df: DataFrame) -> DataFrame:
    """Turn '' into NULL in every string column (empty text is NULL upstream)."""
    cols = [
        F.nullif(F.col(f.name), F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _long_upper() -> tuple[str, str, str]:
    """Characters whose upper case is more than one character, what stands in for them, and their one-character upper case.

    By the Unicode rule: Greek letters with an iota below have their title case,
    all others (the sharp s, ligatures, ...) stay as they are.
    """
    long = [c for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) > 1]
    single = [c.title() if len(c.title()) == 1 else c for c in long]
    stand_ins = [chr(0x10FE00 + i) for i in range(len(long))]  # private use, without case
    return "".join(long), "".join(stand_ins), "".join(single)


_LONG, _STAND_INS, _SINGLE = _long_upper()


def upper_text(col: Column) -> Column:
    """Upper case character by character, as the original database has it: the sharp s stays.

    Spark's ``upper`` makes two letters of some characters.  They are taken out
    of its way and put back; text of ASCII alone goes straight through.
    """
    plain = F.octet_length(col) == F.length(col)
    kept = F.translate(F.upper(F.translate(col, _LONG, _STAND_INS)), _STAND_INS, _SINGLE)
    return F.when(plain, F.upper(col)).otherwise(kept)


def concat_text(*cols: Column) -> Column:
    """``a || b || ...`` where NULL parts count as empty and '' is NULL."""
    return F.nullif(F.concat_ws("", *cols), F.lit(""))


def number_text(col: Column) -> Column:
    """Plain number-to-text: no trailing zeros, no leading zero before '.'.

    100.50 -> '100.5', 100.00 -> '100', 0.50 -> '.5', -0.50 -> '-.5'.
    """
    s = col.cast("string")
    # drop zeros after the last significant fraction digit, then a bare '.'
    s = F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    s = F.regexp_replace(s, r"^(-?)0\.", "$1.")
    return F.when(s == "", F.lit("0")).otherwise(s)


def minus_days(ts: Column, days: int) -> Column:
    """Timestamp minus whole days, keeping the time of day."""
    return ts - F.make_dt_interval(F.lit(int(days)))


def plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days.cast("int"))
