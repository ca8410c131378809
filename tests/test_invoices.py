"""Open invoice lines (O1-O3) on hand-built rows."""

from decimal import Decimal as D

from ledgermatch.operators import fund_totals, open_invoice_lines

from .helpers import invoice, line, sources


def _open(spark, cfg, invoices, lines):
    s = sources(spark, invoices, lines, [])
    return open_invoice_lines(s.invoices, s.invoice_headers, s.invoice_lines, cfg)


def test_only_posted_invoices_with_balance(spark, cfg):
    invs = [invoice("FI000001"), invoice("FI000002", posted=0), invoice("FI000003", payments="100.00")]
    lines = [line("FI000001", 101, "F1", "100.00"), line("FI000002", 201, "F1", "100.00"),
             line("FI000003", 301, "F1", "100.00")]
    rows = _open(spark, cfg, invs, lines).collect()
    assert {r.TXTINVOICE for r in rows} == {"FI000001"}


def test_null_fund_keeps_total_but_loses_lines(spark, cfg):
    invs = [invoice("FI000001", amount="60.00")]
    lines = [line("FI000001", 101, "F1", "10.00"), line("FI000001", 102, None, "20.00"),
             line("FI000001", 103, None, "30.00")]
    rows = sorted(_open(spark, cfg, invs, lines).collect(), key=lambda r: (r.FUND is None, r.FoapalLineID or 0))
    assert len(rows) == 2
    f1, fnull = rows
    assert f1.FUND == "F1" and f1.FoapalLineID == 101 and f1.PERFUNDTOTAL == D("10.00")
    assert fnull.FUND is None and fnull.FoapalLineID is None and fnull.PERFUNDTOTAL == D("50.00")
    # COUNT(DISTINCT FUND) ignores NULL; the NULL fund ranks last.
    assert f1.FUND_COUNT == 1 and fnull.FUND_COUNT == 1
    assert f1.FUNDLINE == 1 and fnull.FUNDLINE == 2
    assert fnull.FUNDKEY == "50"


def test_fund_key_number_text(spark, cfg):
    invs = [invoice("FI000001", amount="201.00")]
    lines = [line("FI000001", 101, "F1", "0.25"), line("FI000001", 102, "F1", "0.25"),
             line("FI000001", 103, "F2", "100.00"), line("FI000001", 104, "F3", "100.50")]
    keys = {r.FUND: r.FUNDKEY for r in _open(spark, cfg, invs, lines).collect()}
    assert keys == {"F1": "F1.5", "F2": "F2100", "F3": "F3100.5"}


def test_foapal_line_order_ties_broken_by_line_id(spark, cfg):
    invs = [invoice("FI000001", amount="30.00")]
    lines = [line("FI000001", 103, "F1", "10.00", orgn="O2"), line("FI000001", 102, "F1", "10.00"),
             line("FI000001", 101, "F1", "10.00")]
    got = {r.FoapalLineID: r.FOAPALline for r in _open(spark, cfg, invs, lines).collect()}
    assert got == {101: 1, 102: 2, 103: 3}


def test_fund_totals_all_lines(spark, cfg):
    s = sources(spark, [], [line("FI1", 1, "F1", "1.10"), line("FI1", 2, "F1", "2.20"),
                            line("FI1", 3, None, "3.00")], [])
    got = {(r.TXTINVOICE, r.FUND): r.PERFUNDTOTAL for r in fund_totals(s.invoice_lines, cfg).collect()}
    assert got == {("FI1", "F1"): D("3.30"), ("FI1", None): D("3.00")}
