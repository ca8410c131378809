"""The whole match, composed from the operators.

Data path (sizes from the original deployment: 27M transactions, a few
hundred open lines):

1. open invoice lines (small)          -> materialised once, reused 4x
2. transactions -> pre-filter          -> date floor as a literal (scan pruning)
3. pre-match signals (optional)        -> broadcast equi-joins, no shuffle
4. candidate pairs                     -> ONE broadcast equi-join on block keys
5. score, keep >= threshold            -> numbers of the pairs materialised once;
                                          few: their whole rows as well
6. rank credits, count debits, report  -> one TranID exchange, one range sort
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from ..config import MatchConfig
from ..operators.candidates import BlockPlan, candidate_pairs, choose_blocks, numbered, numbered_transactions
from ..operators.found import Found, found_pairs
from ..operators.invoices import OPEN_LINE_COLUMNS, open_invoice_lines
from ..operators.offsets import annotate, debit_offsets
from ..operators.open_side import OpenSide, survey_open_lines
from ..operators.ranking import matched_results, rank_matches, rank_split_matches
from ..operators.report import match_report, positioned_report
from ..operators.signals import signal_transactions
from ..operators.transactions import select_transactions, with_token_flag
from ..sources.tables import Sources
from .joins import materialize
from .quality import assert_quality, found_per_transaction, pairs_per_transaction


@dataclass
class MatchRun:
    """A match; what follows from its scored pairs is planned when it is asked for.

    ``found`` holds the pairs as numbers where they are many (``MatchConfig.wide_max_pairs``).
    """

    config: MatchConfig
    open_lines: DataFrame
    scored: DataFrame  # pairs at or above the threshold (credits and debits)
    most: int  # pairs of one transaction id
    found: Found | None = None
    unique_ids: bool = True
    # How the pairs were found; None where they come from a kept state.
    blocks: BlockPlan | None = None
    side: OpenSide | None = None
    prefiltered: DataFrame | None = None
    signals: DataFrame | None = None
    pairs: DataFrame | None = None

    @cached_property
    def _split(self) -> bool:
        return self.most > self.config.rank_max_rows

    @cached_property
    def matched(self) -> DataFrame:
        if self.found:
            return self.found.matched(self.config)
        if self._split:
            return materialize(matched_results(self.scored, self.config, split=True), "matched")
        return matched_results(self.scored, self.config)

    @cached_property
    def ranked(self) -> DataFrame:
        if self.found:
            return self.found.ranked(self.config)
        return rank_split_matches(self.matched) if self._split else rank_matches(self.matched)

    @cached_property
    def offsets(self) -> DataFrame:
        return self.found.offsets(self.config) if self.found else debit_offsets(self.scored, self.config)

    @cached_property
    def annotated(self) -> DataFrame:
        return self.found.annotated(self.config) if self.found else annotate(self.ranked, self.offsets, self.config)

    @cached_property
    def report(self) -> DataFrame:
        return match_report(self.annotated)

    @cached_property
    def positioned(self) -> DataFrame:
        """The report with each row's place in its order."""
        if self.found and self.unique_ids:
            return self.found.positioned(self.config)
        return positioned_report(self.annotated)


def build_open_lines(src: Sources, cfg: MatchConfig) -> DataFrame:
    """The open lines, numbered, as a written table."""
    return materialize(numbered(open_invoice_lines(src.invoices, src.invoice_headers, src.invoice_lines, cfg)), "open-lines")


def pair_input(
    prefiltered: DataFrame, open_lines: DataFrame, cfg: MatchConfig, use_prematch: bool | None = None, side: OpenSide | None = None
) -> DataFrame:
    """Transactions that enter the pair join.

    The pre-match only removes transactions whose pairs score at most
    ``cfg.prematch_lost_max()``; when that is below the threshold it cannot
    change the result and is skipped (``use_prematch=None``).
    """
    if use_prematch is None:
        use_prematch = not (cfg.skip_redundant_prematch and cfg.prematch_is_redundant())
    if use_prematch:
        return signal_transactions(prefiltered, open_lines, cfg, side)
    return with_token_flag(prefiltered, cfg)


def run_match(
    src: Sources,
    cfg: MatchConfig,
    use_prematch: bool | None = None,
    colmap: dict[str, str] | None = None,
    check_inputs: bool = False,
    check_ids: bool = True,
) -> MatchRun:
    """The whole match; ``colmap`` names the ledger's own columns.

    ``check_inputs`` first asserts unique ids in all tables; ``check_ids``, on by
    default, asserts that of the transactions that have pairs.
    """
    if check_inputs:
        assert_quality(src, colmap)
    open_lines = build_open_lines(src, cfg)
    side = survey_open_lines(open_lines, cfg)
    pre = select_transactions(src.transactions, open_lines, cfg, side, colmap, src.ledger_partition)
    sig = pair_input(pre, open_lines, cfg, use_prematch, side)
    blocks = choose_blocks(open_lines, cfg)
    tx = numbered_transactions(sig)
    pairs = candidate_pairs(tx, open_lines, cfg, blocks, side)
    found = Found(materialize(found_pairs(pairs, cfg), "found"), tx, open_lines)
    return finish_match(found, cfg, check_ids, blocks=blocks, side=side, prefiltered=pre, signals=sig, pairs=pairs)


def finish_match(found: Found, cfg: MatchConfig, check_ids: bool = True, **more) -> MatchRun:
    """From the numbers of the pairs to the report; ``more`` goes into the result."""
    lines = found.lines.select(*OPEN_LINE_COLUMNS)
    found = replace(found, count=found.pairs.count())
    few = found.count <= cfg.wide_max_pairs
    most = None if few else found_per_transaction(found, check_ids)
    if most is not None and most <= cfg.rank_max_rows:
        return MatchRun(cfg, lines, found.scored(cfg), most, found, check_ids, **more)
    scored = materialize(found.scored(cfg, few), "scored")
    return MatchRun(cfg, lines, scored, pairs_per_transaction(scored, check_ids), **more)
