"""Match configuration: every tunable of the scoring model in one place."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from types import MappingProxyType

# --- fixed values (must equal the original report for identical results) ---
# Accounting code columns, in the order the FOAPALmatches label lists them.
CODE_COLUMNS = ("FUND", "ORGN", "ACCT", "PROG", "ACTV", "LOCN", "ACCI")
# Codes used by the cheap pre-match (ACTV and LOCN are not part of it).
PREMATCH_CODES = ("FUND", "ACCT", "ORGN", "PROG", "ACCI")
# Rule classes a payment can carry, and the token rule for invoice numbers.
DEFAULT_RULE_CLASSES = ("JE16", "RCP")
DEFAULT_TOKEN_PREFIX = "FI"
DEFAULT_TOKEN_MIN_LEN = 5
DEFAULT_TOKEN_MAX_LEN = 7
DEFAULT_TOKEN_MIN_DIGITS = 5
# Scores: exact invoice number 5, invoice-like token 1, each code 1,
# any amount 2, transaction on or after the invoice date 1; threshold 7;
# grace period 14 days; at least 2 pre-match codes.
# --- end of fixed values ---

_UNIT_CODE_WEIGHTS = MappingProxyType({c: 1 for c in CODE_COLUMNS})


def decimal_type(text: str) -> tuple[int, int]:
    """(precision, scale) of ``decimal(p[, s])``."""
    m = re.fullmatch(r"\s*decimal\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*", text.lower())
    if not m:
        raise ValueError(f"a decimal type is needed, got {text!r}")
    return int(m.group(1)), int(m.group(2) or 0)


@dataclass(frozen=True)
class MatchConfig:
    """All literals of the scoring model.  Weights must be non-negative."""

    threshold: int = 7
    grace_days: int = 14
    min_prematch_codes: int = 2
    w_exact_invoice: int = 5
    w_possible_invoice: int = 1
    code_weights: MappingProxyType = field(default=_UNIT_CODE_WEIGHTS)
    w_amount: int = 2
    w_date: int = 1
    token_prefix: str = DEFAULT_TOKEN_PREFIX
    token_min_len: int = DEFAULT_TOKEN_MIN_LEN
    token_max_len: int = DEFAULT_TOKEN_MAX_LEN
    token_min_digits: int = DEFAULT_TOKEN_MIN_DIGITS
    rule_classes: tuple = DEFAULT_RULE_CLASSES
    excluded_accounts: tuple = ()
    money_type: str = "decimal(12,2)"
    # Type of fund totals (a SUM of money); wide enough not to overflow.
    total_type: str = "decimal(22,2)"
    # Explicit code groups for the blocking join (None: derived from weights).
    code_groups: tuple | None = None
    # Row bound under which a relation derived from the open invoice lines
    # is broadcast; above it the same join runs as a shuffled hash join.
    broadcast_max_rows: int = 2_000_000
    # ... and bound on the measured bytes of a broadcast relation.
    broadcast_max_bytes: int = 256 * 1024 * 1024
    # Pairs of one transaction that a single task may rank; above it the
    # ranking is split (same ranks).
    rank_max_rows: int = 100_000
    # Pairs at the threshold up to which whole rows are written, ranked and
    # exchanged; beyond, their numbers are, and columns join last (same rows).
    wide_max_pairs: int = 1_000_000
    # Skip the transaction pre-match when it provably cannot change the
    # result (see ``prematch_is_redundant``).
    skip_redundant_prematch: bool = True

    def __post_init__(self):
        weights = dict(self.code_weights)
        if set(weights) != set(CODE_COLUMNS):
            raise ValueError(f"code_weights must name exactly {CODE_COLUMNS}")
        object.__setattr__(self, "code_weights", MappingProxyType(weights))
        for name in ("w_exact_invoice", "w_possible_invoice", "w_amount", "w_date"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be >= 0")
        if any(w < 0 for w in weights.values()):
            raise ValueError("code weights must be >= 0")
        if not (0 < self.token_min_len <= self.token_max_len):
            raise ValueError("token lengths must satisfy 0 < min <= max")
        # The token is looked for in upper-cased text.
        object.__setattr__(self, "token_prefix", self.token_prefix.upper())
        if decimal_type(self.total_type)[1] < self.money_scale:
            raise ValueError("total_type must keep the scale of money_type")

    @property
    def money_precision(self) -> int:
        return decimal_type(self.money_type)[0]

    @property
    def money_scale(self) -> int:
        return decimal_type(self.money_type)[1]

    def with_(self, **changes) -> "MatchConfig":
        return replace(self, **changes)

    @property
    def max_score(self) -> int:
        return (
            max(self.w_exact_invoice, self.w_possible_invoice)
            + sum(self.code_weights.values())
            + self.w_amount
            + self.w_date
        )

    def prematch_lost_max(self) -> int:
        """Highest score a pair can reach when its transaction fails the pre-match.

        Such a transaction has no amount hit inside the date window, no
        invoice token, and fewer than ``min_prematch_codes`` of the pre-match
        codes equal for every line inside the window; only the two codes
        outside the pre-match and the date point remain.
        """
        if self.min_prematch_codes <= 0:
            return -1  # every transaction passes the pre-match
        pre = sorted((self.code_weights[c] for c in PREMATCH_CODES), reverse=True)
        best_pre = sum(pre[: self.min_prematch_codes - 1])
        others = sum(w for c, w in self.code_weights.items() if c not in PREMATCH_CODES)
        return best_pre + others + self.w_date

    def prematch_is_redundant(self) -> bool:
        return self.prematch_lost_max() < self.threshold
