"""Benchmark: the match at $BENCH_SF_DIR on local[$BENCH_CPUS].

The four ledger inputs are first derived from the test tables and written
as parquet to a fresh scratch folder (timed as ``derive_fixtures``); every
timed query then reads those tables the way a deployment reads its ledger,
and runs to completion into Spark's no-op sink.  After one untimed warm-up,
each query runs ``BENCH_REPEATS`` times (default 2) and the fastest run is
reported.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from ledgermatch.operators import candidate_pairs, open_invoice_lines, signal_transactions  # noqa: E402
from ledgermatch.operators.open_side import survey_open_lines  # noqa: E402
from ledgermatch.operators.scoring import scored_at_threshold  # noqa: E402
from ledgermatch.operators.transactions import select_transactions  # noqa: E402
from ledgermatch.plans.pipeline import build_open_lines, run_match  # noqa: E402
from ledgermatch.session import local_session  # noqa: E402
from ledgermatch.sources import derive_sources, fixture_config, read_sources  # noqa: E402


def _sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    cfg = fixture_config()
    scratch = tempfile.mkdtemp(prefix="ledgermatch-bench-", dir="/tmp")

    times = {}
    t = time.time()
    src = derive_sources(spark, sf_dir, cfg)
    paths = {}
    for name in ("invoices", "invoice_headers", "invoice_lines", "transactions"):
        paths[name] = os.path.join(scratch, name)
        getattr(src, name).write.mode("overwrite").parquet(paths[name])
    times["derive_fixtures"] = time.time() - t

    def load():
        return read_sources(spark, paths, cfg=cfg)

    def q_open_invoice_lines():
        s = load()
        _sink(open_invoice_lines(s.invoices, s.invoice_headers, s.invoice_lines, cfg))

    def signals():
        s = load()
        ol = build_open_lines(s, cfg)
        side = survey_open_lines(ol, cfg)
        pre = select_transactions(s.transactions, ol, cfg, side)
        return signal_transactions(pre, ol, cfg, side), ol, side

    def q_signal_transactions():
        _sink(signals()[0])

    def q_score_pairs():
        sig, ol, side = signals()
        _sink(scored_at_threshold(candidate_pairs(sig, ol, cfg, side=side), ol, cfg))

    def q_match_report():
        _sink(run_match(load(), cfg).report)

    # One untimed warm-up of the end-to-end query (JIT, class loading).
    q_match_report()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    for name, fn in (
        ("open_invoice_lines", q_open_invoice_lines),
        ("signal_transactions", q_signal_transactions),
        ("score_pairs", q_score_pairs),
        ("match_report", q_match_report),
    ):
        best = None
        for _ in range(repeats):
            t = time.time()
            fn()
            best = min(best or float("inf"), time.time() - t)
        times[name] = best

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "match_report_end_to_end",
        "value": round(times["match_report"], 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
