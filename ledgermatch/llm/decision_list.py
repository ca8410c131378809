"""Quality rules: an ordered list of learned threshold conjunctions.

Sequential covering over a bounded labelled sample: a rule for bad documents is
grown on two thirds of the rows not yet covered, one threshold at a time by
FOIL gain, and pruned on the other third by dropping its last conditions while
that raises precision.  A rule is kept if it is precise on the pruning rows;
what it covers leaves the sample, and the next rule is learned on the rest.
The list becomes one Spark conditional expression over statistic columns, so
that the verdict on 100 TB is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_gbt import MAX_TRAIN_ROWS, training_counts
from .textstats import COUNTS, with_counts



#: Interpretable statistics as SQL over the counts; ``greatest(.., 1)`` guards empty texts.
STATISTICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "sign_rate": "n_signs / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "distinct_rate": "n_distinct_words / greatest(n_words, 1)",
    "words": "n_words / 1",
}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def sql(self) -> str:
        sign = ">" if self.above else "<="
        return f"{STATISTICS[self.statistic]} {sign} {self.threshold!r}D"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.statistic]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def statistics(counts: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of rows of COUNTS, as Spark computes them."""
    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    out = {}
    for name, sql in STATISTICS.items():
        over, under = sql.split(" / ")
        if under.startswith("greatest"):
            out[name] = c[over] / np.maximum(c[under[len("greatest(") :].split(",")[0]], 1)
        else:
            out[name] = c[over] / float(under)
    return out


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, dtype=bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, cuts: int) -> Rule:
    """Add the threshold of the highest FOIL gain until only bad rows are covered or nothing gains."""
    rule: Rule = ()
    live = np.ones(len(bad), dtype=bool)
    while len(rule) < max_conditions and (~bad[live]).any():
        p0, n0 = bad[live].sum(), live.sum()
        best, gain = None, 1e-9
        for name, v in x.items():
            seen = np.unique(v[live])
            if len(seen) < 2:
                continue
            mids = (seen[:-1] + seen[1:]) / 2
            for t in np.unique(np.quantile(mids, np.linspace(0, 1, cuts))):
                high = live & (v > t)
                for above, part in ((True, high), (False, live & ~high)):
                    p, n = bad[part].sum(), part.sum()
                    if p:
                        g = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if g > gain:
                            best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        rule += (best,)
        live &= best.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """Precision with a Laplace correction, and rows covered."""
    hit = _covers(rule, x, len(bad))
    return (bad[hit].sum() + 1) / (hit.sum() + 2), int(hit.sum())


def learn_rules(
    counts: np.ndarray, label: np.ndarray, min_precision: float = 0.9, max_conditions: int = 4, cuts: int = 24, seed: int = 5
) -> list[Rule]:
    """The ordered rules; a row that meets one is bad (label 0), any other good."""
    x, bad = statistics(counts), label < 0.5
    deal = np.random.default_rng(seed).random(len(label))
    rules: list[Rule] = []
    while bad.sum() >= 8:
        grow, prune = deal < 2 / 3, deal >= 2 / 3
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions, cuts)
        held = {k: v[prune] for k, v in x.items()}
        while len(rule) > 1 and _worth(rule[:-1], held, bad[prune])[0] >= _worth(rule, held, bad[prune])[0]:
            rule = rule[:-1]
        if not rule:
            break
        hit = _covers(rule, x, len(bad))
        precision, met = _worth(rule, held, bad[prune])
        if met < 2 or precision < min(min_precision, (met + 1) / (met + 2)) or not hit.any():
            break
        rules.append(rule)
        x, bad, deal = {k: v[~hit] for k, v in x.items()}, bad[~hit], deal[~hit]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for a good document: the ordered rules as one conditional expression over the counts."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        meets = F.expr(" AND ".join(f"({c.sql()})" for c in rule))
        out = F.when(meets, F.lit(False)) if out is None else out.when(meets, F.lit(False))
    return out.otherwise(F.lit(True))


def train_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    counts, y = training_counts(docs, labels, "quality", max_rows, id_col, text_col)
    return learn_rules(counts, y)


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the counts, ``base_failed`` and ``kept`` to every row.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    3-word windows; such a document is not kept whatever the rules say.  NULL
    and empty texts have no words.  Input columns of these names are replaced.
    """
    out = with_counts(docs, text_col, keep).withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    )
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
