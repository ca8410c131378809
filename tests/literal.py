"""The unblocked pair join, as written in the original report (tests only).

``TRANDATE >= date - grace AND (7 code equalities OR 4 amount equalities)``
has no equi-join key, so Spark runs it as a broadcast nested-loop join over
all (open line, transaction) pairs.  It is kept as the executable
specification the blocked join is property-tested against, on small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.config import CODE_COLUMNS, MatchConfig
from ledgermatch.functions.oracle import minus_days
from ledgermatch.operators.candidates import TX_CODE, TX_PAIR_COLUMNS
from ledgermatch.operators.signals import AMOUNT_COLUMNS


def literal_pairs(tx: DataFrame, open_lines: DataFrame, cfg: MatchConfig) -> DataFrame:
    t = tx.select(*[F.col(src).alias(dst) for src, dst in TX_PAIR_COLUMNS])
    any_arm = None
    for c in CODE_COLUMNS:
        arm = t[TX_CODE[c]] == open_lines[c]
        any_arm = arm if any_arm is None else (any_arm | arm)
    for c in AMOUNT_COLUMNS:
        any_arm = any_arm | (F.abs(t["AMOUNT"]) == open_lines[c])
    cond = (t["TRANDATE"] >= minus_days(open_lines["DATINVOICEDATE"], cfg.grace_days)) & any_arm
    return t.join(open_lines, cond, "inner")
