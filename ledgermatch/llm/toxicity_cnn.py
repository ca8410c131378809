"""Toxicity: a convolutional text classifier trained in numpy.

Words are embedded by hashing, without a vocabulary: one table for the whole
word, one for its first letters, side by side.  Filters of several widths slide
over the embedded words of the whole text; each filter's maximum feeds a
logistic output.  The raw probability is mapped, per language guessed from the
text's function words, so that the threshold that separates best there comes
out as THRESHOLD; the ``lang`` column is never read.

Training uses every labelled document outside the held-out third: parts of
them train at the same time and their moves are averaged, round by round.  A
caller may ask for a bounded sample instead.  For scoring, embedding and filters are multiplied out once, so a word
costs two table rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, split_remainder, text_hash, utf8, with_text_columns, word_blocks

#: Words of the longest document of a bounded sample (``max_rows``).
MAX_TRAIN_WORDS = 4000
#: Folds and rounds of the training on all labelled documents; words of a part, steps it takes in a round,
#: documents of a step, passes at most; floats that are averaged in one group.
FOLDS_OF_ALL = 2
ROUNDS = 2
TASK_WORDS = 1 << 21
PART_STEPS = 150
PART_BATCH = 16
MAX_PASSES = 8
BLOCK = 1 << 13
#: Labelled ids (with label, hash and size: narrow rows) that are broadcast to the texts, at most.
BROADCAST_IDS = 2_000_000
#: Score at which a document counts as toxic; languages are calibrated to it.
THRESHOLD = 0.7
#: Parts of the sample that are scored by a model of the others, and the weight of the pooled cut in rows.
FOLDS = 5
PRIOR_ROWS = 10
SEED = 29

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIX = 4
#: Ids whose language is guessed, for each place of the sample.
CANDIDATES = 8
#: Words that are scored in one piece; longer texts are taken in overlapping pieces.
PIECE_WORDS = 1 << 15

_STRIP = b".,;:!?\"'()[]{}#*$%&|<>-_"
# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is was that for with are this from have you they which were not",
    "de": "der die das und ist nicht ein eine von zu mit den dem sich auf auch wird werden",
    "fr": "le les et des du est une pour dans qui sur pas plus avec sont ce au",
    "es": "el los las y del por con para una su como lo sus al esta son muy",
}
LANGUAGES = ["other", *FUNCTION_WORDS]


class _Ids(dict):
    """Word to packed (language, prefix bucket, word bucket); bounded, refilled when full."""

    def __init__(self):
        self.votes = {w.encode(): i for i, ws in enumerate(FUNCTION_WORDS.values(), 1) for w in ws.split()}

    def __missing__(self, word: bytes) -> int:
        import xxhash

        bare = word.strip(_STRIP)
        head = bare.decode("utf-8", "replace")[:PREFIX].encode()
        value = xxhash.xxh64_intdigest(bare, 1) % BUCKETS | (xxhash.xxh64_intdigest(head, 2) % BUCKETS) << 16
        value |= self.votes.get(bare, 0) << 32
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = value
        return value


_IDS = _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """Packed ids of all words of the text, as int64."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    parts = [np.array([_IDS[w] for w in words], dtype=np.int64) for words in word_blocks(utf8(text.lower())) if words]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def guess_language(ids: np.ndarray) -> int:
    """Index in LANGUAGES of the language with most function words; 0 if there is none."""
    votes = np.bincount(ids >> 32, minlength=len(LANGUAGES))
    return int(votes[1:].argmax()) + 1 if votes[1:].any() else 0


def _pieces(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (owner, start, windows, ids): documents, or pieces of long ones, each with the context of its last windows.

    Positions past the end hold -1, an empty word; a text without words is one empty word.
    """
    extra = max(WIDTHS) - 1
    owner, lengths, parts, size = [], [], [], 0
    for d, ids in enumerate(docs):
        n = max(1, len(ids))
        full = np.r_[ids, np.full(extra + n - len(ids), -1, dtype=np.int64)]
        for at in range(0, n, PIECE_WORDS):
            windows = min(PIECE_WORDS, n - at)
            owner.append(d)
            lengths.append(windows)
            parts.append(full[at : at + windows + extra])
            size += windows
            if size >= PIECE_WORDS:
                yield _batch(owner, lengths, parts, extra)
                owner, lengths, parts, size = [], [], [], 0
    if owner:
        yield _batch(owner, lengths, parts, extra)


def _batch(owner, lengths, parts, extra):
    lengths = np.array(lengths)
    start = np.r_[0, np.cumsum(lengths + extra)[:-1]]
    return np.array(owner), start, lengths, np.concatenate(parts)


def _rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two tables; the last row of each is the empty word."""
    empty = ids < 0
    return np.where(empty, BUCKETS, ids & 0xFFFF), np.where(empty, BUCKETS, (ids >> 16) & 0xFFFF)


_COLUMNS = [(w, j) for w in WIDTHS for j in range(w)]


def _windows(words: np.ndarray) -> np.ndarray:
    """Filter outputs at each position from the per-word products (columns by width and offset)."""
    n = len(words) - max(WIDTHS) + 1
    out = np.empty((n, len(WIDTHS) * FILTERS), dtype=words.dtype)
    at = 0
    for k, w in enumerate(WIDTHS):
        part = words[:n, at : at + FILTERS].copy()
        for j in range(1, w):
            part += words[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
        out[:, k * FILTERS : (k + 1) * FILTERS] = part
        at += w * FILTERS
    return out


def _segment_max(values: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    stop = np.minimum(start + lengths, len(values))
    bounds = np.stack([start, stop], axis=1).ravel()
    if bounds[-1] == len(values):
        bounds = bounds[:-1]
    return np.maximum.reduceat(values, bounds, axis=0)[::2]


@dataclass
class ToxicityModel:
    words: np.ndarray  # (BUCKETS + 1, DIM), last row zero
    heads: np.ndarray
    filters: np.ndarray  # (2 * DIM, len(_COLUMNS) * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    cuts: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), THRESHOLD))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words @ self.filters[:DIM], self.heads @ self.filters[DIM:]

    def raw(self, docs: list[np.ndarray], tables=None) -> np.ndarray:
        """Uncalibrated probabilities; the windows of whole documents."""
        a, b = tables or self.tables()
        pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        for owner, start, lengths, ids in _pieces(docs):
            i, j = _rows(ids)
            best = _segment_max(_windows(a[i] + b[j]), start, lengths)
            np.maximum.at(pooled, owner, best)
        hidden = np.maximum(pooled + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base, -30, 30).astype(np.float64)))

    def calibrate(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Piecewise linear in the probability, the language's cut at THRESHOLD."""
        cut = self.cuts[language]
        low = THRESHOLD * raw / cut
        high = THRESHOLD + (1 - THRESHOLD) * (raw - cut) / (1 - cut)
        return np.clip(np.where(raw < cut, low, high), 0, 1)


def bucket_counts(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(table, label, row): documents of the label in which the row of the table occurs."""
    counts = np.zeros((2, 2, BUCKETS + 1))
    for ids, label in zip(docs, y, strict=True):
        for t, shift in enumerate((0, 16)):
            counts[t, int(label), np.unique((ids >> shift) & 0xFFFF)] += 1
    return counts


def start_model(counts: np.ndarray, sizes: np.ndarray, rng) -> ToxicityModel:
    """The model before training; ``sizes`` are the documents of either label.

    The first embedding dimension starts at the bucket's smoothed log-odds of
    occurring in toxic documents, the others at small noise.  With one label
    only, the model is that label's share.
    """
    model_rows = BUCKETS + 1

    def table(count):
        share = (count + 2) / (np.maximum(sizes, 1)[:, None] + 4)
        t = rng.normal(0, 0.05, (model_rows, DIM)).astype(np.float32)
        t[:, 0] = np.clip(np.log(share[1] / share[0]), -2, 4) / 2
        t[count.sum(axis=0) == 0] = 0
        t[-1] = 0
        return t

    n_out = len(WIDTHS) * FILTERS
    filters = rng.normal(0, 0.3, (2 * DIM, len(_COLUMNS) * FILTERS)).astype(np.float32)
    scale = np.repeat([1 / w for w, _ in _COLUMNS], FILTERS)
    filters[[0, DIM]] = np.abs(filters[[0, DIM]]) * scale + 0.2 * scale
    m = ToxicityModel(table(counts[0]), table(counts[1]), filters, np.full(n_out, -0.2, np.float32), np.full(n_out, 0.2, np.float32), -1.0)
    if not sizes.all():
        m.out[:] = 0
        m.base = float(np.log((sizes[1] + 1) / (sizes[0] + 1))) if sizes.any() else 0.0
    return m


def start_memory(m: ToxicityModel) -> dict:
    """Adagrad's sums of squares."""
    return {k: np.full_like(v, 1e-2) for k, v in (("w", m.words), ("h", m.heads), ("f", m.filters), ("b", m.bias), ("o", m.out))} | {"base": 1e-2}


def _best_windows(m: ToxicityModel, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each whole document and filter the maximum and the ids of the words of its window, piece by piece."""
    n_out, reach = len(WIDTHS) * FILTERS, np.arange(max(WIDTHS))
    top = np.full((len(docs), n_out), -np.inf, dtype=np.float32)
    words = np.full((len(docs), n_out, len(reach)), -1, dtype=np.int64)
    for owner, start, lengths, ids in _pieces(docs):
        i, j = _rows(ids)
        z = _windows(np.concatenate([m.words[i], m.heads[j]], axis=1) @ m.filters)
        for d, s, n in zip(owner, start, lengths, strict=True):
            at = z[s : s + n].argmax(axis=0) + s
            best = z[at, np.arange(n_out)]
            better = best > top[d]
            top[d, better] = best[better]
            words[d, better] = ids[at[better][:, None] + reach]
    return top, words


def train_pass(m: ToxicityModel, seen: dict, docs: list[np.ndarray], y: np.ndarray, order: np.ndarray, batch: int, rate: float = 0.05) -> None:
    """One pass of Adagrad over whole documents; the gradient reaches the words of each filter's best window."""
    for at in range(0, len(docs), batch):
        some = order[at : at + batch]
        top, words = _best_windows(m, [docs[d] for d in some])
        hidden = np.maximum(top + m.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.base, -30, 30)))
        err = ((p - y[some]) / len(some)).astype(np.float32)
        g_out = hidden.T @ err
        g_hidden = err[:, None] * m.out[None, :] * (hidden > 0)
        g_filters = np.zeros_like(m.filters)
        spots, grads, col = [], [], 0
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            gh = g_hidden[:, own]
            for off in range(w):
                cols = slice(col, col + FILTERS)
                word = words[:, own, off]
                i, j = _rows(word)
                g_filters[:, cols] += np.einsum("dfe,df->ef", np.concatenate([m.words[i], m.heads[j]], axis=2), gh)
                spots.append(word.ravel())
                grads.append((gh[:, :, None] * m.filters[:, cols].T[None]).reshape(-1, 2 * DIM))
                col += FILTERS
        i, j = _rows(np.concatenate(spots))
        g = np.concatenate(grads)
        for key, tab, rows, part in (("w", m.words, i, g[:, :DIM]), ("h", m.heads, j, g[:, DIM:])):
            uniq, inv = np.unique(rows, return_inverse=True)
            total = np.zeros((len(uniq), DIM), dtype=np.float32)
            np.add.at(total, inv, part)
            total[uniq == BUCKETS] = 0
            seen[key][uniq] += total**2
            tab[uniq] -= rate * total / np.sqrt(seen[key][uniq])
        for key, par, grad in (("f", m.filters, g_filters), ("b", m.bias, g_hidden.sum(axis=0)), ("o", m.out, g_out)):
            seen[key] += grad**2
            par -= rate * grad / np.sqrt(seen[key])
        seen["base"] += float(err.sum()) ** 2
        m.base -= rate * float(err.sum()) / seen["base"] ** 0.5


def fit_cnn(docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, min_steps: int = 300, batch: int = 64, rate: float = 0.05, seed: int = 3) -> ToxicityModel:
    """Fit on documents in memory."""
    rng = np.random.default_rng(seed)
    sizes = np.array([(y == 0).sum(), (y == 1).sum()])
    m = start_model(bucket_counts(docs, y), sizes, rng)
    if sizes.all():
        seen = start_memory(m)
        for _ in range(max(epochs, -(-min_steps // -(-len(docs) // batch)))):
            train_pass(m, seen, docs, y, rng.permutation(len(docs)), batch, rate)
    return m


def best_cut(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Threshold of the highest weighted F1, in the middle of the gap where it is reached."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-raw, kind="stable")
    r, hit, w = raw[order], y[order], weight[order]
    tp, fp = np.cumsum(hit * w), np.cumsum((1 - hit) * w)
    f1 = 2 * tp / (tp + fp + (y * weight).sum())
    f1[:-1][r[:-1] == r[1:]] = -1
    k = int(f1.argmax())
    below = r[k + 1] if k + 1 < len(r) else 0.0
    return float(np.clip((r[k] + below) / 2, 0.02, 0.98))


def _quotas(counts: dict[int, int], rows: int) -> dict[int, int]:
    """Rows to take per language, at most ``rows``: half are dealt evenly, the others by count."""
    even = {k: min(n, rows // (2 * len(LANGUAGES))) for k, n in counts.items()}
    left, more = rows - sum(even.values()), sum(counts.values()) - sum(even.values())
    return {k: even[k] + ((n - even[k]) * min(left, more) // more if more else 0) for k, n in counts.items()}


def language_cuts(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, language: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The best cut of each language, in logits drawn to the pooled one as much as PRIOR_ROWS of the rarer class would.

    ``rows``: documents that an entry stands for (one each).
    """
    rows = np.ones(len(y)) if rows is None else rows

    def logit(p):
        return np.log(p / (1 - p))

    pooled = best_cut(raw, y, weight)
    cuts = np.full(len(LANGUAGES), pooled)
    for k in range(len(LANGUAGES)):
        own = language == k
        n = min(rows[own & (y == 1)].sum(), rows[own & (y == 0)].sum())
        if n:
            mean = (n * logit(best_cut(raw[own], y[own], weight[own])) + PRIOR_ROWS * logit(pooled)) / (n + PRIOR_ROWS)
            cuts[k] = 1 / (1 + np.exp(-mean))
    return cuts


def _flat(m: ToxicityModel, seen: dict) -> np.ndarray:
    parts = [m.words, m.heads, m.filters, m.bias, m.out, m.base, *[seen[k] for k in ("w", "h", "f", "b", "o", "base")]]
    return np.concatenate([np.ravel(p) for p in parts]).astype(np.float32)


def _unflat(flat: np.ndarray) -> tuple[ToxicityModel, dict]:
    n_out, row = len(WIDTHS) * FILTERS, (BUCKETS + 1, DIM)
    shapes = [row, row, (2 * DIM, len(_COLUMNS) * FILTERS), (n_out,), (n_out,), (1,)] * 2
    ends = np.cumsum([np.prod(s) for s in shapes])[:-1]
    parts = [p.reshape(s).copy() for p, s in zip(np.split(flat, ends), shapes, strict=True)]
    seen = dict(zip(("w", "h", "f", "b", "o"), parts[6:11], strict=True)) | {"base": float(parts[11][0])}
    return ToxicityModel(*parts[:5], float(parts[5][0])), seen


def _parts(batches) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(fold, documents, labels, languages) of each part of a written table in order; a repeated id counts once."""

    def done():
        return key[0], docs, np.array(y, dtype=float), np.array(langs, dtype=int)

    key, last, docs, y, langs = None, None, [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["_fold"], r["_part"]) != key:
                if docs:
                    yield done()
                key, last, docs, y, langs = (r["_fold"], r["_part"]), None, [], [], []
            if r["_id"] != last:
                docs.append(np.frombuffer(r["_words"], dtype=np.uint32).astype(np.int64))
                y.append(r["_label"])
                langs.append(r["_lang"])
            last = r["_id"]
    if docs:
        yield done()


def _labelled_words(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All usable labelled ids with the words of one whole text each, written in parts of about TASK_WORDS words.

    A part holds documents of one fold; a row that repeats id and text follows its like.
    """
    usable = labels.filter((split_remainder(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull())
    usable = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(split_remainder(F.col("_id"), 3) != 1)
    texts = texts.withColumn("_hash", text_hash("_text"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    usable = materialize(usable, "toxicity-labels")

    def near(ids):
        """Up to BROADCAST_IDS ids go to the texts; more are joined by a shuffle."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    one = texts.select("_id", "_hash", size.alias("_size")).join(near(usable), "_id")
    one = materialize(one.groupBy("_id", "_label").agg(F.min("_hash").alias("_hash"), F.max("_size").alias("_size")), "toxicity-ids")
    total = one.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (6 * FOLDS_OF_ALL * TASK_WORDS)))

    def words(batch):
        ids = [word_ids(t) for t in batch]
        return [[(w & 0xFFFFFFFF).astype(np.uint32).tobytes() for w in ids], [guess_language(w) for w in ids]]

    fields = [T.StructField("_words", T.BinaryType()), T.StructField("_lang", T.IntegerType())]
    rows = with_text_columns(texts.join(near(one), ["_id", "_hash"]), "_text", fields, words, ["_id", "_label"])
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(SEED), F.col("_id")), F.lit(FOLDS_OF_ALL)).cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("_id")), F.lit(parts)).cast("int"))
    rows = rows.repartition(FOLDS_OF_ALL * parts, "_fold", "_part").sortWithinPartitions("_fold", "_part", "_id")
    return materialize(rows, "toxicity-words")


def _all_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``bucket_counts`` and documents per label of each fold, added up on the cluster: one row per bucket."""
    names = [f"n{i}" for i in range(FOLDS_OF_ALL * 4)]

    def count(batches):
        met = np.zeros((FOLDS_OF_ALL, 2, 2, BUCKETS + 2))
        for fold, docs, y, _ in _parts(batches):
            met[fold, :, :, :-1] += bucket_counts(docs, y)
            met[fold, :, :, -1] += [[(y == 0).sum(), (y == 1).sum()]] * 2
        flat = met.reshape(-1, BUCKETS + 2).astype(np.int64)
        used = np.flatnonzero(flat.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(n[used]) for n in flat]], names=["bucket", *names])

    got = map_arrow(rows, count, "bucket long, " + ", ".join(f"{n} long" for n in names))
    got = got.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    met = np.zeros((FOLDS_OF_ALL * 4, BUCKETS + 2))
    met[:, got["bucket"].to_numpy(int)] = got[names].to_numpy(float).T
    met = met.reshape(FOLDS_OF_ALL, 2, 2, BUCKETS + 2)
    return met[..., :-1], met[:, 0, :, -1]


def _train_round(rows: DataFrame, models: dict[int, np.ndarray], of_fold: dict[int, int], seed: int) -> dict[int, np.ndarray]:
    """Every part trains the model of its fold over all its documents; a weight moves by the mean of the parts that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for fold, docs, y, _ in _parts(batches):
            if fold not in of_fold:
                continue
            before = shared.value[of_fold[fold]]
            m, seen = _unflat(before)
            rng = np.random.default_rng(seed)
            passes = min(MAX_PASSES, -(-PART_STEPS // -(-len(docs) // PART_BATCH)))
            for _ in range(passes):
                train_pass(m, seen, docs, y, rng.permutation(len(docs)), PART_BATCH)
            moved = _flat(m, seen) - before
            blocks = [moved[at : at + BLOCK] for at in range(0, len(moved), BLOCK)]
            number = pa.array(range(len(blocks)), type=pa.int32())
            model = pa.array([of_fold[fold]] * len(blocks), type=pa.int32())
            yield pa.RecordBatch.from_arrays([model, number, pa.array([b.tobytes() for b in blocks])], names=["model", "block", "moved"])

    def mean(part):
        total, parts = 0.0, 0
        for data in part["moved"]:
            one = np.frombuffer(data, dtype=np.float32)
            total, parts = total + one.astype(np.float64), parts + (one != 0)
        part = part[["model", "block"]].iloc[:1].copy()
        part["moved"] = [(total / np.maximum(parts, 1)).astype(np.float32).tobytes()]
        return part

    form = "model int, block int, moved binary"
    out = {k: v.copy() for k, v in models.items()}
    for r in map_arrow(rows, run, form).groupBy("model", "block").applyInPandas(mean, form).toLocalIterator():
        moved = np.frombuffer(r["moved"], dtype=np.float32)
        out[r["model"]][r["block"] * BLOCK : r["block"] * BLOCK + len(moved)] += moved
    shared.unpersist()
    return out


def _out_of_fold(rows: DataFrame, models: dict[int, ToxicityModel]):
    """Documents per label, language and probability (in steps of a 128th of a logit), from the other folds' models."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for fold, docs, y, langs in _parts(batches):
            if fold in shared.value:
                raw = np.clip(shared.value[fold].raw(docs), 1e-12, 1 - 1e-12)
                step = np.rint(np.log(raw / (1 - raw)) * 128).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(langs.astype(np.int32)), pa.array(step)], names=["y", "lang", "step"])

    return map_arrow(rows, run, "y int, lang int, step int").groupBy("y", "lang", "step").count().orderBy("y", "lang", "step").toPandas()


def train_all(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on every labelled document outside the held-out third, on the cluster.

    The counts come from all of them.  A model per fold is trained in rounds:
    the parts train at the same time, each over its whole documents, and their
    moves are averaged.  The cuts come from the scores that each document gets
    from the other fold's model.  The mean of both goes on for a round over all.
    """
    rows = _labelled_words(docs, labels, id_col, text_col)
    counts, sizes = _all_counts(rows)
    trained = [f for f in range(FOLDS_OF_ALL) if sizes[f].all()]
    models = {}
    for f in trained:
        m = start_model(counts[f], sizes[f], np.random.default_rng(3))
        models[f] = _flat(m, start_memory(m))
    for r in range(ROUNDS if models else 0):
        models = _train_round(rows, models, {f: f for f in models}, 3 + r)
    if models:
        final = {0: np.mean(list(models.values()), axis=0, dtype=np.float32)}
    else:
        m = start_model(counts.sum(axis=0), sizes.sum(axis=0), np.random.default_rng(3))
        final = {0: _flat(m, start_memory(m))}
    if sizes.sum(axis=0).all():
        final = _train_round(rows, final, dict.fromkeys(range(FOLDS_OF_ALL), 0), 3 + ROUNDS)
    model = _unflat(final[0])[0]
    if models:
        met = _out_of_fold(rows, {(f + 1) % FOLDS_OF_ALL: _unflat(v)[0] for f, v in models.items()})
        raw, n = 1 / (1 + np.exp(-met["step"].to_numpy(float) / 128)), met["count"].to_numpy(float)
        model.cuts = language_cuts(raw, met["y"].to_numpy(float), n, met["lang"].to_numpy(int), n)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on labelled documents outside the held-out third; cuts per language from out-of-fold scores of all of them.

    All of them by default, on the cluster (``train_all``).  With ``max_rows``
    on the driver: at most ``max_rows`` ids of each class, dealt by guessed language, lowest id
    hashes first; a repeated id counts once, with one of its texts.  Languages
    are guessed for about CANDIDATES times as many ids of each class, those with
    the lowest hashes, so only their texts are read by Python here.
    """
    if max_rows is None:
        return train_all(docs, labels, id_col, text_col)
    usable = labels.filter((split_remainder(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull())
    usable = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(split_remainder(F.col("_id"), 3) != 1)
    texts = texts.withColumn("_hash", text_hash("_text"))
    span = 1 << 40
    order = F.pmod(F.xxhash64(F.lit(SEED), F.col("_id")), F.lit(span))
    usable = materialize(usable.withColumn("_order", order), "toxicity-labels")
    labelled = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    reach = {y: min(span, CANDIDATES * max_rows * span // n) for y, n in labelled.items()}
    within = F.when(F.col("_label") == 1, F.lit(reach.get(1, span))).otherwise(F.lit(reach.get(0, span)))
    usable = usable.filter(F.col("_order") < within)
    asked = texts.join(F.broadcast(usable), "_id")  # about 2 * CANDIDATES * max_rows ids

    def guesses(batch):
        ids = [word_ids(t) for t in batch]
        return [[guess_language(w) if len(w) <= MAX_TRAIN_WORDS else None for w in ids]]

    guessed = with_text_columns(asked, "_text", [T.StructField("_lang", T.IntegerType())], guesses, ["_id", "_hash", "_label", "_order"])
    guessed = guessed.filter("_lang IS NOT NULL").groupBy("_id", "_label", "_order")
    narrow = materialize(guessed.agg(F.min_by("_lang", "_hash").alias("_lang"), F.min("_hash").alias("_hash")), "toxicity-ids")
    there = {(r["_label"], r["_lang"]): r["count"] for r in narrow.groupBy("_label", "_lang").count().collect()}
    quota = {(y, k): n for y in (0, 1) for k, n in _quotas({k: n for (of, k), n in there.items() if of == y}, max_rows).items()}
    # Thresholds let about twice the wanted ids through, so that only a bounded remainder is ordered.
    bounds = [(y, k, n, min(span, (2 * n + 50) * reach[y] // there[y, k])) for (y, k), n in quota.items()]
    bounds = docs.sparkSession.createDataFrame(bounds, "_label int, _lang int, _quota long, _limit long")
    near = narrow.join(F.broadcast(bounds), ["_label", "_lang"]).filter("_order < _limit")
    rank = F.row_number().over(Window.partitionBy("_label", "_lang").orderBy("_order", "_id"))
    chosen = near.withColumn("_rank", rank).filter("_rank <= _quota").select("_id", "_hash", "_label", "_lang")
    picked = texts.join(F.broadcast(chosen), ["_id", "_hash"]).select("_id", "_label", "_lang", "_text").distinct()
    field_ = T.StructField("ids", T.BinaryType())
    sample = with_text_columns(picked, "_text", [field_], lambda batch: [[word_ids(t).tobytes() for t in batch]], ["_id", "_label", "_lang"])
    sample = sample.toPandas().sort_values(["_id", "ids"]).drop_duplicates("_id")
    words = [np.frombuffer(b, dtype=np.int64) for b in sample["ids"]]
    y = sample["_label"].to_numpy(np.float64)
    language = sample["_lang"].to_numpy(int)
    fold = np.random.default_rng(7).permutation(len(y)) % FOLDS
    raw = np.zeros(len(y))
    for f in range(FOLDS if len(y) else 0):
        part = fit_cnn([w for w, k in zip(words, fold, strict=True) if k != f], y[fold != f])
        raw[fold == f] = part.raw([w for w, k in zip(words, fold, strict=True) if k == f])
    model = fit_cnn(words, y)
    # The sample is dealt by class and language, and the classes reach to different hashes; the corpus is not.
    met = Counter(zip(y.astype(int), language, strict=True))
    weight = np.array([there[g] / met[g] * (span / reach[g[0]]) for g in zip(y.astype(int), language, strict=True)])
    model.cuts = language_cuts(raw, y, weight, language)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` from every whole text; THRESHOLD or more means toxic.

    NULL, empty and blank texts are scored as one empty word.  Every row is
    scored on its own; an input column named ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        m = shared.value
        if not hasattr(m, "_tables"):
            m._tables = m.tables()
        ids = [word_ids(t) for t in texts]
        return [m.calibrate(m.raw(ids, m._tables), np.array([guess_language(w) for w in ids], dtype=int))]

    return with_text_columns(docs, text_col, [T.StructField("score", T.DoubleType())], run, keep)
