"""Spark-native matching of ledger transactions to open invoice lines."""

from .config import CODE_COLUMNS, PREMATCH_CODES, MatchConfig

__all__ = ["CODE_COLUMNS", "PREMATCH_CODES", "MatchConfig"]
__version__ = "0.1.0"
