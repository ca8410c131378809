"""The form without broadcasts on the largest test data, where it is driven by rows and not by a handful."""

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import candidate_pairs, signal_transactions
from ledgermatch.operators.scoring import PAIR_KEY, scored_at_threshold
from ledgermatch.operators.transactions import TX_COLUMNS, select_transactions
from ledgermatch.plans.joins import materialize
from ledgermatch.plans.pipeline import build_open_lines
from ledgermatch.sources import Sources, derive_sources

SF01 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def inputs(spark, cfg):
    src = derive_sources(spark, SF01, cfg)
    src = Sources(*[materialize(getattr(src, n), n) for n in ("invoices", "invoice_headers", "invoice_lines", "transactions")])
    lines = build_open_lines(src, cfg)
    return select_transactions(src.transactions, lines, cfg), lines


def digest(df):
    """Rows and an order-free sum of their hashes."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).cast("decimal(38,0)")
    return tuple(df.agg(F.count("*"), F.sum(row)).first())


def test_both_forms_agree_at_scale(spark, inputs, cfg):
    pre, lines = inputs
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    got = []
    for rows in (cfg.broadcast_max_rows, 0):
        c = cfg.with_(broadcast_max_rows=rows)
        if not rows:
            for n in names:
                spark.conf.set(n, "-1")
        try:
            signals = signal_transactions(pre, lines, c)
            pairs = scored_at_threshold(candidate_pairs(signals, lines, c), lines, c).select(*PAIR_KEY, "InvLineScore", "FOAPALmatches")
            got.append((digest(signals.select(*TX_COLUMNS)), digest(pairs)))
        finally:
            if not rows:
                for n in names:
                    spark.conf.unset(n)
    assert got[0] == got[1]
    assert got[0][0][0] > 500_000 and got[0][1][0] > 100_000
