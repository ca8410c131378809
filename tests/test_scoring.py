"""Scoring and explanation arms on hand-built rows (threshold 1: every OR-join pair)."""

import datetime as dt

import pytest

from ledgermatch.plans.pipeline import run_match

from .helpers import T0, invoice, line, sources, tx

DAY = dt.timedelta(days=1)


@pytest.fixture(scope="module")
def scored(spark, cfg):
    invs = [invoice("FI00123", amount="100.00")]
    lines = [line("FI00123", 1, "F1", "100.00", actv="V1", locn="L1")]
    txs = [
        # every arm: exact number (5) + 7 codes + amount (2) + date (1) = 15
        tx(1, "100.00", T0 + DAY, "PAYMENT FI001234", actv="V1", locn="L1"),
        # number in the text, but no code and no amount: not in the OR join
        tx(2, "1.00", T0 + DAY, "FI00123", fund="X", orgn="X", acct="X", prog="X", acci="X"),
        # exactly invoice date - 14 days: in; one second earlier: out
        tx(3, "7.00", T0 - 14 * DAY, "DEPOSIT"),
        tx(4, "7.00", T0 - 14 * DAY - dt.timedelta(seconds=1), "DEPOSIT"),
        # negative amount equal in absolute value: amount points; token only 'Possible'
        tx(5, "-100.00", T0, "REF FI99999 X", fund="X", orgn="X"),
        # '' codes are NULL: they never match each other (amount passes the pre-match)
        tx(6, "100.00", T0 + DAY, None, fund="", orgn="", acct="", prog="", acci="I1"),
        # one pre-match code, no amount, no token: removed by the pre-match
        tx(7, "7.00", T0 + DAY, None, fund="X", orgn="X", acct="X", prog="X", actv="V1", locn="L1"),
    ]
    s = sources(spark, invs, lines, txs)
    run = run_match(s, cfg.with_(threshold=1, excluded_accounts=()))
    return {r.TranID: r for r in run.scored.collect()}


def test_full_score(scored):
    r = scored[1]
    assert r.InvLineScore == 15
    assert r.InvNumMatch == "Exact"
    assert r.FOAPALmatches == "FUND, ORGN, ACCT, PROG, ACTV, LOCN, ACCI"
    assert r.AmtMatch == "Inv Total"
    assert r.DateMatch == "Pmt after Inv Date"


def test_number_alone_is_not_a_link(scored):
    assert 2 not in scored


def test_grace_boundary(scored):
    assert 3 in scored and 4 not in scored
    assert scored[3].DateMatch == "Pmt predates Inv"
    assert scored[3].InvLineScore == 5  # FUND ORGN ACCT PROG ACCI


def test_negative_amount_and_possible_token(scored):
    r = scored[5]
    assert r.AmtMatch == "Inv Total"
    assert r.InvNumMatch == "Possible Inv # Found"
    assert r.InvLineScore == 1 + 3 + 2 + 1  # possible + ACCT PROG ACCI + amount + date


def test_blank_codes_do_not_match(scored):
    r = scored[6]
    assert r.FOAPALmatches == "ACCI"
    assert r.InvLineScore == 1 + 2 + 1
    assert r.InvNumMatch == "No Inv# found"


def test_prematch_drops_weak_transactions(scored):
    assert 7 not in scored
