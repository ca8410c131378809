"""Language identification with a blended-spectrum string kernel.

k(x, y) counts the n-grams (n = 1 to 3, over letters and word boundaries of the
lower-cased whole text) that occur in both, once each, normalised by the square
roots of the texts' own counts.  ASCII letters and all characters beyond ASCII
count as themselves; n-grams are numbered by a hash of their code points.  Landmarks drawn per language give a Nyström
map of the kernel; kernel ridge regression on it is fitted one language against
the rest.  As the kernel to a landmark is a product of presence vectors, map
and weights multiply out to one weight per n-gram and language, and a batch of
texts is scored by a single matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, split_remainder, text_hash, with_text_columns

#: Labelled documents per language for the ridge regression, and landmarks among them, at most.
MAX_TRAIN_ROWS = 600
LANDMARKS = 24
#: Bits of an n-gram's number.
GRAM_BITS = 21
RIDGE = 1e-2
#: Longest text that teaches, and languages that are learned, at most.
MAX_TRAIN_BYTES = 1 << 16
MAX_LANGUAGES = 500
#: Bounds over all languages together: training rows, landmarks, bytes of the
#: texts that teach, and weights (n-grams times languages).  Many languages
#: share them evenly, down to the least of each.
TOTAL_ROWS, LEAST_ROWS = 6000, 12
TOTAL_LANDMARKS, LEAST_LANDMARKS = 1200, 2
TOTAL_TRAIN_BYTES = 160_000_000
TOTAL_WEIGHTS = 1 << 24
#: N-grams whose presence is laid out densely at a time.
GRAM_BLOCK = 1 << 12
SEED = 43

_LETTER = regex.compile(r"\p{L}")
_BOUNDARY = 0
#: Odd multipliers of the hash, by place from the end of the n-gram.
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Grams:
    """Numbers the n-grams of texts by a hash of their code points, whatever the script."""

    size = 1 << GRAM_BITS

    def __init__(self):
        self.symbol = None
        self.place = None

    @property
    def alphabet(self) -> np.ndarray:
        """Code points that count as themselves; the others are boundaries."""
        letters = [i for i in range(128) if chr(i).isalpha()]
        return np.r_[np.array(letters, dtype=np.uint32), np.arange(0x80, 0x110000, dtype=np.uint32)]

    def _prepare(self):
        self.symbol = np.full(0x110000, _BOUNDARY, dtype=np.uint32)
        self.symbol[self.alphabet] = self.alphabet
        self.place = np.zeros(self.size, dtype=np.int32)

    def distinct(self, text: str) -> np.ndarray:
        """Numbers of the distinct n-grams of the whole text."""
        if self.symbol is None:
            self._prepare()
        found = []
        last = np.array([_BOUNDARY], dtype=np.uint32)
        step = 1 << 18
        for at in range(0, len(text), step):
            s = self.symbol[code_points(text[at : at + step])]
            s = np.r_[last, s, [_BOUNDARY]].astype(np.uint32) if at + step >= len(text) else np.r_[last, s]
            s = s[np.r_[True, (s[1:] != _BOUNDARY) | (s[:-1] != _BOUNDARY)]]
            # One more than the symbol, so that a boundary counts; sums of products differ by order and place.
            one, two, three = ((s.astype(np.uint64) + np.uint64(1)) * m for m in _MULTIPLIERS)
            pairs = two[:-1] + one[1:]
            codes = np.concatenate([one, pairs, three[:-2] + pairs[1:]])
            codes ^= codes >> np.uint64(32)
            codes *= _MULTIPLIERS[0]
            codes >>= np.uint64(64 - GRAM_BITS)
            found.append(self._once(codes.astype(np.int32)))
            last = s[-2:]
        if not found:
            return np.zeros(0, dtype=np.int32)
        return found[0] if len(found) == 1 else self._once(np.concatenate(found))

    def _once(self, codes: np.ndarray) -> np.ndarray:
        # The last writer of each slot is the one that stays: no sort, no clearing.
        order = np.arange(len(codes), dtype=np.int32)
        self.place[codes] = order
        return codes[self.place[codes] == order]

    def __getstate__(self):
        return {"symbol": None, "place": None}


@dataclass
class LanguageModel:
    grams: Grams
    languages: list[str]
    weights: np.ndarray  # (known n-grams + 1, languages); the last row is for unknown ones
    column: np.ndarray  # n-gram number to row of ``weights``
    base: np.ndarray

    def decide(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages:
            return names, scores
        width = len(self.weights)
        batch = max(1, min(batch, (1 << 23) // width))
        for at in range(0, len(asked), batch):
            some = asked[at : at + batch]
            present = np.zeros((len(some), width), dtype=np.float32)
            norm = np.ones(len(some), dtype=np.float32)
            for r, i in enumerate(some):
                found = self.grams.distinct(texts[i])
                present[r, self.column[found]] = 1
                norm[r] = max(1, len(found))
            present[:, -1] = 0
            margin = (present @ self.weights) / np.sqrt(norm)[:, None] + self.base
            top = margin.argmax(axis=1)
            sharp = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
            best = 1 / sharp.sum(axis=1)
            for r, i in enumerate(some):
                names[i], scores[i] = self.languages[top[r]], float(best[r])
        return names, scores


def fit_languages(texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> LanguageModel:
    grams = Grams()
    return fit_presence([grams.distinct(t) for t in texts], langs, landmarks)


def _known_grams(sets: list[np.ndarray], most: int) -> np.ndarray:
    """The n-grams of the landmarks, in order; of too many, those in most landmarks, ties by number."""
    counts = np.zeros(1 << GRAM_BITS, np.int32)
    for s in sets:
        counts[s] += 1
    known = np.flatnonzero(counts)
    if len(known) > most:
        known = np.sort(known[np.argsort(-counts[known], kind="stable")[:most]])
    return known


def _dense(columns: list[np.ndarray], low: int, high: int) -> np.ndarray:
    """Presence of the n-grams ``low`` to ``high`` in each of the sorted sets."""
    out = np.zeros((len(columns), high - low), dtype=np.float32)
    for r, c in enumerate(columns):
        first, stop = np.searchsorted(c, (low, high))
        out[r, c[first:stop] - low] = 1
    return out


def fit_presence(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS) -> LanguageModel:
    """Nyström landmarks: the first ``landmarks`` sets of each language; ridge regression on all.

    Sets of n-gram numbers stay sparse; their common n-grams are counted by
    products over GRAM_BLOCK of them at a time (exact in 32-bit floats).
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel(Grams(), [], np.zeros((1, 0), np.float32), np.zeros(0, np.int32), np.zeros(0))
    seen: dict[str, int] = {}
    marks = []
    for i, name in enumerate(langs):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= landmarks:
            marks.append(i)
    marks.sort(key=lambda i: (langs[i], i))
    known = _known_grams([sets[i] for i in marks], max(1, TOTAL_WEIGHTS // len(names)))
    column = np.full(Grams.size, len(known), dtype=np.int32)
    column[known] = np.arange(len(known))
    columns = [np.sort(c[c < len(known)]) for c in (column[s] for s in sets)]
    root = np.sqrt(np.array([max(1, len(s)) for s in sets], dtype=np.float64))
    common = np.zeros((len(sets), len(marks)), dtype=np.float32)
    for low in range(0, len(known), GRAM_BLOCK):
        high = min(low + GRAM_BLOCK, len(known))
        spectrum = _dense([columns[i] for i in marks], low, high).T
        for at in range(0, len(sets), 256):
            common[at : at + 256] += _dense(columns[at : at + 256], low, high) @ spectrum
    kernel = common / root[:, None] / root[marks]
    among = kernel[marks]
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-8 * value.max()
    nystrom = vector[:, good] / np.sqrt(value[good])
    mapped = kernel @ nystrom
    number = {name: k for k, name in enumerate(names)}
    own = np.array([number[g] for g in langs])
    target = np.full((len(langs), len(names)), -1.0)
    target[np.arange(len(langs)), own] = 1.0
    # Languages weigh alike, whatever their share of the sample.
    share = (1 / np.bincount(own))[own] * len(langs) / len(names)
    centre = np.average(mapped, axis=0, weights=share)
    middle = np.average(target, axis=0, weights=share)
    x, t = mapped - centre, target - middle
    solved = np.linalg.solve((x * share[:, None]).T @ x + RIDGE * len(langs) * np.eye(x.shape[1]) / 100, (x * share[:, None]).T @ t)
    per_mark = ((nystrom @ solved) / root[marks][:, None]).astype(np.float64)
    weights = np.zeros((len(known) + 1, len(names)), np.float32)
    for low in range(0, len(known), GRAM_BLOCK):
        high = min(low + GRAM_BLOCK, len(known))
        weights[low:high] = _dense([columns[i] for i in marks], low, high).T @ per_mark
    return LanguageModel(Grams(), names, weights, column, middle - centre @ solved)


def _gram_sets(rows: DataFrame) -> DataFrame:
    """(_lang, _rank, _grams): the distinct n-grams of each text, found in the workers."""
    fields = [T.StructField("_grams", T.ArrayType(T.IntegerType()))]

    def run(texts):
        grams = Grams()
        return [[np.sort(grams.distinct(t)) for t in texts]]

    return with_text_columns(rows, "_text", fields, run, ["_lang", "_rank"])


def train_languages(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``max_rows`` ids of each language, outside the held-out quarter, lowest id hashes first.

    An id that repeats within a language teaches with one of its texts.  The
    MAX_LANGUAGES languages with most ids are learned; many languages share
    TOTAL_ROWS, TOTAL_LANDMARKS and TOTAL_TRAIN_BYTES, so that rows, landmarks
    and the longest text that teaches shrink, and the driver's memory does not
    grow with their number.  Counting them gives each a hash threshold that lets
    about twice the wanted ids through, so that only a bounded remainder is
    ordered.  The driver gets n-gram numbers, no texts.  Of languages with equal
    margins the first by name is predicted.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    usable = usable.filter(
        (split_remainder(F.col("_id"), 4) != 2) & F.col("_lang").isNotNull()
        & (F.octet_length("_text") <= MAX_TRAIN_BYTES) & F.col("_text").rlike(r"\p{L}")
    ).withColumn("_hash", text_hash("_text")).withColumn("_size", F.octet_length("_text"))
    span = 1 << 40
    order = F.pmod(F.xxhash64(F.lit(SEED), F.col("_id")), F.lit(span)).alias("_order")
    one_each = usable.groupBy("_id", "_lang").agg(F.min(F.struct("_hash", "_size")).alias("_one"))
    narrow = materialize(one_each.select("_id", "_lang", "_one.*", order), "language-ids")
    n_langs = max(1, min(MAX_LANGUAGES, narrow.select("_lang").distinct().count()))
    max_rows = min(max_rows, max(LEAST_ROWS, TOTAL_ROWS // n_langs))
    marks = min(LANDMARKS, max(LEAST_LANDMARKS, TOTAL_LANDMARKS // n_langs))
    narrow = narrow.filter(F.col("_size") <= min(MAX_TRAIN_BYTES, TOTAL_TRAIN_BYTES // (max_rows * n_langs)))
    per_lang = narrow.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_LANGUAGES)
    limit = F.least(F.lit(1.0), F.lit(2.0 * max_rows + 50) / F.col("count")) * float(span)
    near = narrow.join(F.broadcast(per_lang.select("_lang", limit.alias("_limit"))), "_lang").filter("_order < _limit")
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_id"))
    chosen = near.withColumn("_rank", rank).filter(F.col("_rank") <= max_rows).select("_id", "_lang", "_hash", "_rank")
    met = usable.join(F.broadcast(chosen), ["_id", "_lang", "_hash"]).select("_lang", "_rank", "_text").distinct()
    one = met.groupBy("_lang", "_rank").agg(F.min("_text").alias("_text"))
    sample = _gram_sets(one).toPandas().sort_values(["_lang", "_rank"])
    return fit_presence([np.asarray(g, dtype=np.int32) for g in sample["_grams"]], sample["_lang"].tolist(), marks)


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred`` and ``score`` from every whole text.

    NULL texts and texts without a letter are ``und`` with score 0, and so is
    every text if no language was learned.  Input columns of these names are
    replaced; repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_text_columns(docs, text_col, fields, lambda texts: list(shared.value.decide(texts)), keep)
