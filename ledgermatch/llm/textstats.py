"""Statistics of whole texts, batch-wise in numpy: the inputs of the quality models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8, with_text_columns

# The counted symbols, and the ASCII classes.
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SIGNS = b".,;:!?\"'()[]{}-_/\\@^~`+="

#: Counts per text, in this order.
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_upper", "n_digits", "n_signs", "n_distinct_words", "longest_word",
]


def _index(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, dtype=np.uint8)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found at least twice; ``ids`` numbers the words of a text."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    wide = ids.astype(np.int64)
    pairs = wide[:-2] * distinct + wide[1:-1]
    if distinct >= 1 << 20:  # three factors would not fit
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs * distinct + wide[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> list[int]:
    """The COUNTS of one text; NULL counts as empty."""
    data = utf8(text)
    if not data:
        return [0] * len(COUNTS)
    kinds = np.zeros(256, dtype=np.int64)
    for at in range(0, len(data), 1 << 20):
        kinds += np.bincount(np.frombuffer(data, dtype=np.uint8, count=min(1 << 20, len(data) - at), offset=at), minlength=256)
    chars = len(data) - int(kinds[0x80:0xC0].sum())
    words = data.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    lines = data.split(b"\n")
    worded = [x for x in lines if x.strip()] if len(lines) > 1 else lines
    return [
        len(words),
        chars - int(kinds[_index(_SPACES)].sum()),
        int(kinds[_index(SYMBOLS)].sum()),
        len(worded) - len(set(worded)),
        repeated_words(ids, len(numbers)),
        chars,
        len(lines),
        int(kinds[_index(_UPPER)].sum()),
        int(kinds[_index(_DIGITS)].sum()),
        int(kinds[_index(_SIGNS)].sum()),
        len(numbers),
        max(map(len, numbers), default=0),
    ]


def batch_counts(texts: list) -> np.ndarray:
    return np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the COUNTS of every whole text as long columns; input columns of those names are replaced."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    return with_text_columns(docs, text_col, fields, lambda texts: list(batch_counts(texts).T), keep)
