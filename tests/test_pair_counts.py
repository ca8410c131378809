"""Counts of the OR join's pairs against the OR join itself."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermatch.config import CODE_COLUMNS
from ledgermatch.operators import candidate_counts, signal_transactions
from ledgermatch.operators import pair_counts
from ledgermatch.operators.signals import AMOUNT_COLUMNS
from ledgermatch.operators.transactions import select_transactions
from ledgermatch.plans.pipeline import build_open_lines

from .literal import literal_pairs

START = dt.datetime(2026, 1, 1, 8)
CODES = ", ".join(f"{c} string" for c in CODE_COLUMNS)
AMOUNTS = ", ".join(f"{c} decimal(12,2)" for c in AMOUNT_COLUMNS)


def random_rows(seed, n_lines, n_tx, values, amounts, days):
    rng = random.Random(seed)
    code = lambda c: rng.choice([None, *[f"{c}{v}" for v in range(values)], f"{c}0"])
    money = lambda: rng.choice([None, *[Decimal(a) for a in range(amounts)]])
    day = lambda: START + dt.timedelta(days=rng.randrange(days), hours=rng.randrange(3))
    lines = [(*[code(c) for c in CODE_COLUMNS], *[money() for _ in AMOUNT_COLUMNS], day()) for _ in range(n_lines)]
    tx = [(rng.choice([None, i // 2]), *[code(c) for c in CODE_COLUMNS], rng.choice([1, -1]) * (money() or Decimal(-7)), rng.choice([None, day(), day()])) for i in range(n_tx)]
    return lines, tx


def brute(lines, tx, grace):
    n = len(CODE_COLUMNS)
    out = Counter()
    for t in tx:
        hits = 0
        for line in lines:
            code = any(a is not None and a == b for a, b in zip(t[1 : n + 1], line[:n], strict=True))
            amount = any(a is not None and a == abs(t[n + 1]) for a in line[n:-1])
            hits += t[-1] is not None and t[-1] >= line[-1] - dt.timedelta(days=grace) and (code or amount)
        out[(t[0], hits)] += 1
    return out


@pytest.mark.parametrize("large", [False, True], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("seed", range(2))
def test_equals_every_pair(spark, cfg, monkeypatch, seed, large):
    monkeypatch.setattr(pair_counts, "STRETCHES", 5)
    monkeypatch.setattr(pair_counts, "OWN_DATES", 3)
    lines, tx = random_rows(seed, 120, 80, 3, 6, 60)
    c = cfg.with_(broadcast_max_rows=0) if large else cfg
    open_lines = spark.createDataFrame(lines, f"{CODES}, {AMOUNTS}, DATINVOICEDATE timestamp_ntz")
    frame = spark.createDataFrame(tx, f"TranID long, {CODES}, AMOUNT decimal(12,2), TRANDATE timestamp_ntz")
    got = candidate_counts(frame, open_lines, c)
    assert got.columns == ["TranID", "n_lines"]
    assert Counter((r.TranID, r.n_lines) for r in got.collect()) == brute(lines, tx, cfg.grace_days)


def test_no_lines_and_no_transactions(spark, cfg):
    lines, tx = random_rows(5, 10, 10, 3, 4, 20)
    schema = f"{CODES}, {AMOUNTS}, DATINVOICEDATE timestamp_ntz", f"TranID long, {CODES}, AMOUNT decimal(12,2), TRANDATE timestamp_ntz"
    none = candidate_counts(spark.createDataFrame(tx, schema[1]), spark.createDataFrame([], schema[0]), cfg).collect()
    assert len(none) == 10 and {r.n_lines for r in none} == {0}
    assert candidate_counts(spark.createDataFrame([], schema[1]), spark.createDataFrame(lines, schema[0]), cfg).count() == 0


def test_fixture_against_the_literal_join(sources, cfg):
    open_lines = build_open_lines(sources, cfg)
    tx = signal_transactions(select_transactions(sources.transactions, open_lines, cfg), open_lines, cfg)
    literal = literal_pairs(tx, open_lines, cfg).groupBy("TranID").agg(F.count("*").alias("n"))
    both = candidate_counts(tx, open_lines, cfg).join(literal, "TranID", "full")
    assert both.filter("n_lines <> coalesce(n, 0) OR n_lines IS NULL").count() == 0
    assert both.agg(F.sum("n_lines")).first()[0] == 72_792


def test_no_pair_is_made(sources, cfg):
    open_lines = build_open_lines(sources, cfg)
    tx = select_transactions(sources.transactions, open_lines, cfg).withColumn("fi_flag", F.lit(True))
    counts = candidate_counts(tx, open_lines, cfg)
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Both large joins go by a long key alone.
    assert plan.count("BroadcastHashJoin [_key#") >= 1 and plan.count("BroadcastHashJoin [_part_key#") >= 1


def test_candidate_pairs_are_listed(spark):
    """The key lists the pairs, one row each, instead of a number per transaction."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    pairs = entry.queries()["candidate_pairs"](spark, sf)
    assert pairs.columns == ["TranID", "TXTINVOICE", "FUND", "FoapalLineID"]
    scored = entry.queries()["score_pairs"](spark, sf).select(*pairs.columns)
    assert sorted(map(repr, pairs.collect())) == sorted(map(repr, scored.collect())) != []
    assert entry.oracle_sql()["candidate_pairs"].endswith("SELECT TranID, TXTINVOICE, FUND, FoapalLineID FROM scored")
