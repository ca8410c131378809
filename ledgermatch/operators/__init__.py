"""User-level operators, one function per step of the match (O1-O17)."""

from .candidates import BlockPlan, candidate_pairs, plan_blocks
from .invoices import fund_layout, fund_totals, open_invoice_lines, open_invoices
from .offsets import annotate, debit_offsets
from .pair_counts import candidate_counts
from .ranking import matched_results, rank_matches
from .report import match_report, positioned_report
from .scoring import at_threshold, explain_columns, score_column, scored_transactions
from .signals import signal_transactions, with_amount_flag, with_code_flag, with_signal_flags
from .transactions import normalize_transactions, prefilter_transactions, with_token_flag

__all__ = [
    "BlockPlan", "annotate", "at_threshold", "candidate_counts", "candidate_pairs", "debit_offsets",
    "explain_columns", "fund_layout", "fund_totals", "match_report", "matched_results",
    "normalize_transactions", "open_invoice_lines", "open_invoices", "plan_blocks",
    "positioned_report", "prefilter_transactions", "rank_matches", "score_column", "scored_transactions",
    "signal_transactions", "with_amount_flag", "with_code_flag", "with_signal_flags",
    "with_token_flag",
]
