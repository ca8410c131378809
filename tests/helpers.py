"""Hand-built source rows for unit tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgermatch.sources.tables import SCHEMAS, Sources, conform

D = Decimal
T0 = dt.datetime(2026, 1, 10)


def frame(spark, table, rows):
    return conform(spark.createDataFrame(rows, SCHEMAS[table]), table)


def invoice(no, date=T0, amount="100.00", payments="0.00", posted=-1, cust=1):
    amount, payments = D(amount), D(payments)
    return (no, cust, f"Cust{cust}", date, amount, amount - payments, payments, D("0.00"), posted, "B1", "DEPT")


def line(no, lid, fund, amount, orgn="O1", acct="A1", prog="P1", actv=None, locn=None, acci="I1"):
    return (no, lid, fund, orgn, acct, prog, actv, locn, acci, D(amount))


def tx(tid, amount, date, desc=None, dc="C", fund="F1", orgn="O1", acct="A1", prog="P1",
       actv=None, locn=None, acci="I1", rucl="JE16"):
    return (tid, "U", acci, fund, orgn, acct, prog, actv, locn, D(amount), desc, date, dc,
            "DOC", f"R{tid}", 0, rucl, "user")


def sources(spark, invoices, lines, txs, headers=None):
    headers = headers if headers is not None else [(i[0], "creator") for i in invoices]
    return Sources(
        invoices=frame(spark, "invoices", invoices),
        invoice_headers=frame(spark, "invoice_headers", headers),
        invoice_lines=frame(spark, "invoice_lines", lines),
        transactions=frame(spark, "transactions", txs),
    )
