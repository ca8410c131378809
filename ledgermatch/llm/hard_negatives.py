"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

A row's score for an anchor is the inner product of their integer vectors.  The
rows are dealt into blocks of bounded size and the anchors into chunks; each
(block, chunk) is one group of a cogrouped join.  A block sorts its rows once
per dimension.  An anchor walks all lists side by side, from the end that its
sign in that dimension favours (sorted access), scores every row it meets by
the whole vector (random access), and stops when the threshold, the score of a
row that stood at the current place of every list, is strictly below what it
still needs.  No row outside the lists read so far can reach the threshold, so
the result is exact, ties included.

Two passes: the best rows of the anchor's own label (its positives), then for
each positive the best rows of other labels whose score lies between two shares
of the positive's.  Each block answers with its own best few, and Spark merges
these by a window, so that no task sees more than a block and a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import checked_broadcast
from .common import materialize, ship_package

#: Rows whose lists are sorted together, and anchors that walk them in one task.
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 1024
#: Places of every list that the first round reads; each further round doubles them.
FIRST_DEPTH = 8
#: A table of labels up to this size is broadcast, above it joined.
LABEL_ROWS, LABEL_BYTES = 100_000, 8 << 20


class SortedLists:
    """The rows of one block, sorted by id, with a list of row numbers per dimension by rising value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        """``most``: the largest absolute component of any anchor, which decides the exact number type."""
        by_id = np.argsort(ids, kind="stable")
        self.ids, x = ids[by_id], vectors[by_id]
        bound = float(np.abs(x).max(initial=0)) * most * max(1, x.shape[1])
        if bound >= 2.0**63:
            raise OverflowError("an inner product of these vectors may pass 64 bits")
        # Sums of whole numbers are exact in a float as long as they fit its mantissa.
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.x = x.astype(kind)
        self.met = 0  # rows scored so far, over all anchors

    def rounds(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        """After each round: which rows were met, their scores, the threshold, whether all were met.

        The arrays are changed in place by the next round.
        """
        n, a = len(self.ids), anchor.astype(self.x.dtype)
        used = np.flatnonzero(anchor)
        up = anchor[used] > 0
        seen, scores = np.zeros(n, bool), np.zeros(n, self.x.dtype)
        if not len(used):  # every score is 0
            seen[:] = True
            self.met += n
            yield seen, scores, 0, True
            return
        rising, weights = self.order[:, used], anchor[used].astype(object if self.x.dtype == np.int64 else np.int64)
        last, depth = 0, min(FIRST_DEPTH, n)
        while True:
            fresh = np.zeros(n, bool)
            fresh[np.where(up, rising[n - depth : n - last], rising[last:depth])] = True
            fresh &= ~seen
            rows = np.flatnonzero(fresh)
            scores[rows] = self.x[rows] @ a
            seen |= fresh
            self.met += len(rows)
            standing = np.where(up, self.values[n - depth, used], self.values[depth - 1, used])
            done = depth == n or bool(seen.all())
            yield seen, scores, int(weights @ standing), done
            if done:
                return
            last, depth = depth, min(2 * depth, n)

    def best(self, anchor: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the ``k`` best rows but the anchor itself; ties by smaller id."""
        others = self.ids != own_id
        for seen, scores, threshold, done in self.rounds(anchor):
            ok = seen & others
            known = scores[ok]
            kth = np.partition(known, len(known) - k)[-k] if len(known) >= k else None
            if done or kth is not None and threshold < kth:
                break
        rows = np.flatnonzero(ok if kth is None else ok & (scores >= kth))
        rows = rows[np.argsort(-scores[rows], kind="stable")][:k]
        return rows, scores[rows]

    def windows(self, anchor: np.ndarray, others: np.ndarray, spans: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each span (least, most) the ``k`` best of the rows ``others`` whose score lies in it."""
        highest = max(high for _, high in spans)
        for seen, scores, threshold, done in self.rounds(anchor):
            if threshold > highest and not done:
                continue
            known = np.sort(scores[seen & others])
            floors = []
            for low, high in spans:
                first, stop = np.searchsorted(known, low), np.searchsorted(known, high, "right")
                floors.append(int(known[stop - k]) if stop - first >= k else low)
            if done or all(threshold < f for f in floors):
                break
        out, ok = [], seen & others
        for (_, high), floor in zip(spans, floors, strict=True):
            rows = np.flatnonzero(ok & (scores >= floor) & (scores <= high))
            rows = rows[np.argsort(-scores[rows], kind="stable")][:k]
            out.append((rows, scores[rows]))
        return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    arrays = column.combine_chunks()
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(arrays).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def window_bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def integer_vectors(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v, is_anchor) of the rows that take part, one per id, as a written table.

    Each component becomes floor(scale * x).  Rows without an id, a label or a
    vector, or with a NULL or non-finite component, take no part; of rows that
    share an id the one with the smallest label, then the smallest vector, does.
    """
    def whole(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) < (1 << 31), y).otherwise(F.raise_error(F.lit("a scaled component passes 31 bits"))).cast("int")

    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_x"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    finite = F.forall("_x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("id", F.struct("label", F.transform("_x", whole).alias("v"), "is_anchor").alias("_row"))
    return materialize(rows.groupBy("id").agg(F.min("_row").alias("_row")).select("id", "_row.*"), "vectors")


def _hash_part(parts) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.col("id")), parts)


def _parts(rows: Column, most: int) -> Column:
    return F.greatest(F.ceil(rows / most), F.lit(1)).cast("long")


def _each(parts) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def best_positives(vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first ``k`` other rows of each anchor's label."""
    counts = vectors.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("m"))
    counts = counts.select("label", _parts(F.col("n"), BLOCK_ROWS).alias("blocks"), _parts(F.col("m"), CHUNK_ANCHORS).alias("chunks"))
    counts, _ = checked_broadcast(counts, LABEL_ROWS, LABEL_BYTES)
    dealt = vectors.join(counts, "label")
    rows = dealt.select("label", _hash_part(F.col("blocks")).alias("block"), _each(F.col("chunks")).alias("chunk"), "id", "v")
    own = [F.col(c).alias(f"own_{c}") for c in ("label", "id", "v")]  # names of their own: both sides are one table
    anchors = dealt.filter("is_anchor").select(*own, _each(F.col("blocks")).alias("block"), _hash_part(F.col("chunks")).alias("chunk"))

    def search(own: pa.Table, block: pa.Table) -> pa.Table:
        found = ([], [], [])
        if own.num_rows and block.num_rows:
            a = _matrix(own["own_v"], dim)
            lists = SortedLists(_longs(block["id"]), _matrix(block["v"], dim), float(np.abs(a).max(initial=0)))
            for anchor_id, anchor in zip(_longs(own["own_id"]).tolist(), a, strict=True):
                hit, scores = lists.best(anchor, anchor_id, k)
                found[0].extend([anchor_id] * len(hit))
                found[1].extend(lists.ids[hit].tolist())
                found[2].extend(map(int, scores))
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["anchor_id", "positive_id", "positive_score"])

    ship_package(vectors.sparkSession)
    met = anchors.groupBy("own_label", "block", "chunk").cogroup(rows.groupBy("label", "block", "chunk")).applyInArrow(
        search, "anchor_id long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return met.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``anchor`` holds.  An anchor's positives are
    its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 *
    score <= high * positive_score are its hard negatives, ranked from 1.
    Higher scores come first, ties by smaller id.  Vectors of unequal lengths
    count as filled up with zeros; only id, label, vector and the columns of
    ``anchor`` are read, so other columns cannot clash.  An empty table, no
    anchor or no row in a window give no row.
    """
    vectors = integer_vectors(rows, anchor, id_col, label_col, vector_col, scale)
    n, m, dim = vectors.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    best = materialize(best_positives(vectors, dim, positives), "positives")
    spans = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("spans"))
    blocks, chunks = (F.lit(max(1, -(-x // most))).cast("long") for x, most in ((n, BLOCK_ROWS), (m, CHUNK_ANCHORS)))
    dealt = vectors.select(_hash_part(blocks).alias("block"), _each(chunks).alias("chunk"), "id", "label", "v")
    anchors = vectors.filter("is_anchor").join(spans, F.col("id") == F.col("anchor_id"))
    own = [F.col(c).alias(f"own_{c}") for c in ("id", "label", "v")]
    anchors = anchors.select(_each(blocks).alias("block"), _hash_part(chunks).alias("chunk"), *own, "spans")

    def search(own: pa.Table, block: pa.Table) -> pa.Table:
        found = ([], [], [], [], [])
        if own.num_rows and block.num_rows:
            a = _matrix(own["own_v"], dim)
            ids = _longs(block["id"])
            lists = SortedLists(ids, _matrix(block["v"], dim), float(np.abs(a).max(initial=0)))
            codes = pa.chunked_array([*own["own_label"].chunks, *block["label"].chunks]).combine_chunks().dictionary_encode().indices
            codes = codes.to_numpy(zero_copy_only=False)
            labels = codes[own.num_rows :][np.argsort(ids, kind="stable")]
            for i, (anchor_id, wanted) in enumerate(zip(_longs(own["own_id"]).tolist(), own["spans"].to_pylist(), strict=True)):
                bounds = [(w, window_bounds(w["positive_score"], low, high)) for w in wanted]
                bounds = [(w, b) for w, b in bounds if b[0] <= b[1]]
                if not bounds:
                    continue
                hits = lists.windows(a[i], labels != codes[i], [b for _, b in bounds], negatives)
                for (w, _), (hit, scores) in zip(bounds, hits, strict=True):
                    found[0].extend([anchor_id] * len(hit))
                    found[1].extend([w["positive_id"]] * len(hit))
                    found[2].extend([w["positive_score"]] * len(hit))
                    found[3].extend(lists.ids[hit].tolist())
                    found[4].extend(map(int, scores))
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    keys = ["block", "chunk"]
    met = anchors.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
        search, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
