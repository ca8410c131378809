"""Threshold-aware blocking (O10): exactness and plan shape."""

import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermatch.config import CODE_COLUMNS, MatchConfig
from ledgermatch.operators import candidate_pairs
from ledgermatch.operators.transactions import select_transactions, with_token_flag
from ledgermatch.operators.candidates import plan_blocks, set_partitions
from ledgermatch.operators.scoring import PAIR_KEY, at_threshold, scored_at_threshold, scored_transactions
from ledgermatch.plans.joins import materialize
from ledgermatch.plans.pipeline import build_open_lines, pair_input

from .literal import literal_pairs


def _covered(cfg, costs=None):
    """Every non-amount, non-exact pair of the OR join with score >= T hits a block."""
    plan = plan_blocks(cfg, costs)
    w = cfg.code_weights
    for bits in product((0, 1), repeat=len(CODE_COLUMNS)):
        equal = {c for c, b in zip(CODE_COLUMNS, bits) if b}
        if not equal:
            continue  # not in the OR join without an amount arm
        for inv, date in product((0, cfg.w_possible_invoice), (0, cfg.w_date)):
            score = inv + date + sum(w[c] for c in equal)
            if score >= cfg.threshold and not any(set(g) <= equal for g in plan.code_groups):
                return False
    return True


@pytest.mark.parametrize("t", range(0, 17))
def test_unit_weights_every_threshold(t):
    assert _covered(MatchConfig(threshold=t))


def test_default_grouping_has_three_groups():
    assert len(plan_blocks(MatchConfig()).code_groups) == 3


def test_set_partitions_count():
    assert sum(1 for _ in set_partitions(list("abcdefg"))) == 877


def test_family_costs_less_than_whole_groups(spark, sources, cfg):
    """Choices of codes in place of whole parts: at most a third of the key matches on the fixture's open lines."""
    from ledgermatch.operators.candidates import GROUP_ORDER, PROBE_COST, cheapest_family, code_subset_costs

    costs = code_subset_costs(build_open_lines(sources, cfg), list(GROUP_ORDER))
    weights, need = cfg.code_weights, cfg.threshold - cfg.w_possible_invoice - cfg.w_date
    assert costs[()] == 84 * 84
    probe = PROBE_COST * 84
    best = sum(costs[g] + probe for g in cheapest_family(list(GROUP_ORDER), weights, need, costs))
    whole = min(
        sum(costs[tuple(c for c in GROUP_ORDER if c in g)] + probe for g in part)
        for part in set_partitions(list(GROUP_ORDER)) if sum(min(weights[c] for c in g) for g in part) > 7 - need
    )
    assert best <= whole


@settings(max_examples=60, deadline=None)
@given(
    weights=st.lists(st.integers(0, 4), min_size=7, max_size=7),
    t=st.integers(0, 25),
    possible=st.integers(0, 3),
    date=st.integers(0, 3),
    seed=st.integers(0, 1000),
)
def test_random_weights_and_costs(weights, t, possible, date, seed):
    cfg = MatchConfig(threshold=t, w_possible_invoice=possible, w_date=date,
                      code_weights=dict(zip(CODE_COLUMNS, weights)))
    import random

    rnd = random.Random(seed)
    costs = {}
    pos = [c for c in CODE_COLUMNS if cfg.code_weights[c] > 0]
    for m in range(1, 1 << len(pos)):
        costs[tuple(c for j, c in enumerate(pos) if m >> j & 1)] = rnd.randint(0, 1000)
    assert _covered(cfg)
    from ledgermatch.operators.candidates import GROUP_ORDER

    ordered = {tuple(c for c in GROUP_ORDER if c in k): v for k, v in costs.items()}
    assert _covered(cfg, ordered or None)


def _pairs_both_ways(spark, sources, cfg):
    ol = build_open_lines(sources, cfg)
    pre = select_transactions(sources.transactions, ol, cfg)
    sig = pair_input(pre, ol, cfg, use_prematch=True)
    cols = [*PAIR_KEY, "InvLineScore"]
    blocked = scored_at_threshold(candidate_pairs(sig, ol, cfg), ol, cfg).select(*cols)
    literal = at_threshold(scored_transactions(literal_pairs(sig, ol, cfg), cfg), cfg).select(*cols)
    return blocked, literal


@pytest.mark.parametrize("t", [2, 4, 5, 7, 9])
def test_blocked_equals_literal(spark, sources, cfg, t):
    c = cfg.with_(threshold=t)
    blocked, literal = _pairs_both_ways(spark, sources, c)
    assert blocked.count() == literal.count()
    assert blocked.exceptAll(literal).count() == 0
    assert literal.exceptAll(blocked).count() == 0


def test_blocked_equals_literal_other_weights(spark, sources, cfg):
    w = dict(cfg.code_weights, FUND=2, ACCI=3, LOCN=0)
    c = cfg.with_(threshold=8, code_weights=w, w_amount=3, w_exact_invoice=4)
    blocked, literal = _pairs_both_ways(spark, sources, c)
    assert blocked.count() == literal.count() > 0
    assert blocked.exceptAll(literal).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_blocked_equals_literal_random_weights(spark, sources, cfg, seed):
    import random

    rnd = random.Random(seed)
    weights = {c: rnd.randint(0, 3) for c in CODE_COLUMNS}
    c = cfg.with_(threshold=rnd.randint(3, 9), code_weights=weights, w_amount=rnd.randint(0, 3),
                  w_exact_invoice=rnd.randint(0, 6), w_possible_invoice=rnd.randint(0, 2), w_date=rnd.randint(0, 2))
    blocked, literal = _pairs_both_ways(spark, sources, c)
    assert blocked.exceptAll(literal).count() == 0 and literal.exceptAll(blocked).count() == 0


def test_wide_money_keeps_amount_points(spark, cfg):
    """An amount beyond a long in cents still counts as equal."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    from .helpers import T0, invoice, line, sources as built, tx

    c = cfg.with_(money_type="decimal(22,2)", total_type="decimal(32,2)", excluded_accounts=())
    big = Decimal("123456789012345678.25")
    s = built(spark, [invoice("FI00123")], [line("FI00123", 1, "F1", "5.00")], [tx(1, "1.00", T0, None, prog="X", acci="X")])
    money = F.lit(str(big)).cast("decimal(22,2)")
    s = type(s)(
        invoices=s.invoices.withColumn("INVAMOUNT", money).withColumn("OUTSTANDING", money),
        invoice_headers=s.invoice_headers, invoice_lines=s.invoice_lines,
        transactions=s.transactions.withColumn("AMOUNT", money),
    )
    blocked, literal = _pairs_both_ways(spark, s, c.with_(threshold=5))
    assert [r.InvLineScore for r in blocked.collect()] == [r.InvLineScore for r in literal.collect()] == [6]


def test_pairs_are_unique(spark, sources, cfg):
    blocked, _ = _pairs_both_ways(spark, sources, cfg.with_(threshold=3))
    assert blocked.count() == blocked.select(*PAIR_KEY).distinct().count()


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidate_join_is_broadcast_hash(spark, sources, cfg):
    blocked, _ = _pairs_both_ways(spark, sources, cfg)
    plan = _plan_text(blocked)
    assert "BroadcastHashJoin" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_prematch_has_no_nested_loop_join(spark, sources, cfg):
    ol = build_open_lines(sources, cfg)
    pre = select_transactions(sources.transactions, ol, cfg)
    plan = _plan_text(pair_input(pre, ol, cfg, use_prematch=True))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_prefilter_predicates_reach_the_scan(spark, sources, cfg):
    ol = build_open_lines(sources, cfg)
    pre = select_transactions(sources.transactions, ol, cfg)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = _plan_text(pre.select("TranID"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.find("PushedFilters"):]
    pushed = pushed[: pushed.find("ReadSchema")]
    assert "GreaterThanOrEqual(TRANDATE" in pushed
    assert "In(RUCL_CODE" in pushed
    assert "Not(EqualTo(ACCT,))" in pushed and "ACCT,A11" in pushed


def test_invoice_numbers_of_many_lengths(spark, cfg):
    """Twenty lengths of numbers, some the end or the middle of others: the pairs of the literal join, by one scan of the text."""
    from .helpers import T0, invoice, line, sources as built, tx

    numbers = ["FI" + "1234567890123456789012345"[:n] for n in range(2, 22)] + ["34", "FI99", "QX4567", "é数9", "X.*9"]
    lines = [line(no, i, "F1", f"{i}.50") for i, no in enumerate(numbers, 1)]
    texts = ["FI1234567", "see FI123456 34", "fi12345 X.*9", "FI1234567890123456789", "FI99999 É数9", "(FI55555) qx4567 and QX45", "FI123456", "FI12345", "", None]
    txs = [tx(i, "1.00", T0, t, orgn="O9") for i, t in enumerate(texts)]
    c = cfg.with_(excluded_accounts=(), threshold=9)
    s = built(spark, [invoice(no) for no in numbers], lines, txs)
    blocked, literal = _pairs_both_ways(spark, s, c)
    assert blocked.count() == literal.count() > 10
    assert blocked.exceptAll(literal).count() == 0
    ol = build_open_lines(s, c)
    sig = pair_input(select_transactions(s.transactions, ol, c), ol, c)
    assert _plan_text(candidate_pairs(sig, ol, c)).count("regexp_extract_all(upperDescription") == 1


def test_the_join_compiles_to_small_methods(spark, sources, cfg):
    """The JIT leaves methods over 8,000 bytes to its interpreter; evidence is found once and looked up."""
    ol = build_open_lines(sources, cfg)
    tx = materialize(with_token_flag(select_transactions(sources.transactions, ol, cfg), cfg), "tx")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scored_at_threshold(candidate_pairs(tx, ol, cfg), ol, cfg)._jdf.queryExecution().executedPlan()
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", text)]
    assert sizes and max(sizes) < 8000
