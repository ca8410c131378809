"""SimHash near-duplicates with a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint.  Fingerprints within ``radius`` = 2
bits are linked, and documents take the smallest id of their component.

The search over the distinct fingerprints has two layers of the same index:

* Spark routes fingerprints down the upper nodes.  Two differences cannot touch
  all three bands of a fingerprint, so under one of three rotations a linked
  pair agrees on the leading band; that band is the root node (mask: the band;
  differences so far: none).  A node with more than ``leaf`` fingerprints is
  split on its next eight bits.  A fingerprint lives in one child and visits
  each sibling that it can still reach: the differences of the branch are added
  up, and branches over the radius are never taken.  So a hot node is split
  until every leaf is small, at any size of the input.
* Inside a leaf, fingerprints are sorted by Gray rank and sixteen neighbours at
  a time are factored into a node that holds the bits they share (mask and
  pattern), level by level.  A query starts at the root, adds the differences
  on the bits that each level adds, and drops whole nodes beyond the radius.

A leaf returns links to one member of each local component instead of all
pairs, which keeps connectivity and is linear in the leaf.  Components are then
contracted by joins: every vertex moves to its smallest neighbour, edges are
rewritten and de-duplicated, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, semi_rows, text_hash, utf8, with_text_columns, word_blocks

RADIUS = 2
SHINGLE_WORDS = 3
#: Fingerprints that one leaf may hold; visitors are dealt out in chunks of the same size.
LEAF = 2048
#: Children of a node inside a leaf, and bits by which Spark splits a hot node.
FANOUT = 16
SPLIT_BITS = 8
#: Leading bands of the three rotations: left shift and width.
BANDS = ((0, 22), (22, 21), (43, 21))

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints -----------------------------------------------------------


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Bit-wise majority of the XXH64 values (seed 42) of all k-word shingles, as a signed 64-bit integer.

    No word: zero.  Fewer than k words: the one shingle of all words.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    total = 0
    tail: list[bytes] = []
    for words in word_blocks(utf8(text).lower()):
        words = tail + words
        n = len(words) - k + 1
        if n > 0:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: n - 1].tolist()]
            stops = (ends[k - 1 :] - 1).tolist()
            hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
            for at in range(0, n, 1 << 16):
                part = hashes[at : at + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        tail = words[max(0, len(words) - k + 1) :]
    if total == 0:
        if not tail:
            return 0
        value = digest(b" ".join(tail), 42)
        return value - (1 << 64) if value >> 63 else value
    packed = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, k: int = SHINGLE_WORDS) -> DataFrame:
    """Append ``fp`` (long), the fingerprint of the whole text; NULL text counts as empty."""
    return with_text_columns(docs, text_col, [T.StructField("fp", T.LongType())], lambda texts: [[fingerprint(t, k) for t in texts]], keep)


# -- index inside a leaf ----------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayForest:
    """One Gray-ordered hierarchy per group; ``codes`` sorted by group, then by Gray rank."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        self.levels = []
        pattern, mask, group = codes, np.full(len(codes), _FULL), groups
        first = None
        while True:
            self.levels.append((pattern, mask, first))
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[heads, len(group)])
            if sizes.max() == 1:
                break
            place = np.arange(len(group)) - np.repeat(heads, sizes)
            first = np.flatnonzero(place % fanout == 0)
            both, either = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            mask = np.bitwise_and.reduceat(mask, first) & ~(both ^ either)
            pattern = both & mask
            group = group[first]
            first = np.r_[first, len(self.levels[-1][0])]
        self.root_groups = group

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (query, item) positions within ``radius``; ``roots`` holds each query's root node."""
        for at in range(0, len(queries), chunk):
            q = np.arange(at, min(at + chunk, len(queries)))
            node = roots[q]
            pattern, mask, _ = self.levels[-1]
            apart = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            held = mask[node]
            for depth in range(len(self.levels) - 1, -1, -1):
                near = apart <= radius
                q, node, apart, held = q[near], node[near], apart[near], held[near]
                if depth == 0:
                    break
                first = self.levels[depth][2]
                count = first[node + 1] - first[node]
                child = np.repeat(first[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                q, apart, held, node = np.repeat(q, count), np.repeat(apart, count), np.repeat(held, count), child
                pattern, mask, _ = self.levels[depth - 1]
                # Only the bits that this level adds; those above are counted.
                apart = apart + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node] & ~held)
                held = mask[node]
            yield q, node


def _components(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position of each position's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def leaf_links(key: np.ndarray, code: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions among the rows of whole groups: home with home, visitor with home.

    Each row is linked to one row of its component, not to all its partners.
    """
    order = np.lexsort((gray_rank(code), key))
    key, code, home = key[order], code[order], home[order]
    items = np.flatnonzero(home)
    if not len(items):
        return items, items
    forest = GrayForest(code[items], key[items])
    root = np.minimum(np.searchsorted(forest.root_groups, key), len(forest.root_groups) - 1)
    asked = np.flatnonzero(forest.root_groups[root] == key)
    pairs = []
    for q, item in forest.search(code[asked], root[asked], radius):
        a, b = asked[q], items[item]
        wanted = ~home[a] | (a < b)
        pairs.append((a[wanted], b[wanted]))
    label = _components(len(code), pairs)
    linked = np.flatnonzero(label != np.arange(len(code)))
    return order[linked], order[label[linked]]


# -- routing to leaves ------------------------------------------------------


def _rotl(col: Column, by: int) -> Column:
    return col if by == 0 else F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, 64 - by))


def _top(code: Column, bits: Column | int) -> Column:
    shift = F.lit(64) - (F.lit(bits) if isinstance(bits, int) else bits)
    return F.call_function("shiftrightunsigned", code, shift.cast("int"))


NODE = ["rot", "depth", "prefix"]


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """Move the rows of hot nodes to their children and to reachable siblings.

    A home takes its own child and visits smaller siblings only (the pair is
    met from the other side otherwise); a visitor takes every child in reach.
    """
    flips = [x for x in range(1 << SPLIT_BITS) if bin(x).count("1") <= radius]
    rows = rows.withColumn("next", (F.least(F.lit(SPLIT_BITS), F.lit(64) - F.col("depth"))).cast("int"))
    return (
        rows.withColumn("bits", _top(F.col("code"), F.col("depth") + F.col("next")))
        .withColumn("bits", F.expr("bits & (shiftleft(1L, next) - 1)"))
        .withColumn("flip", F.explode(F.array(*[F.lit(x) for x in flips])))
        .filter("flip < shiftleft(1, next)")
        .withColumn("acc", (F.col("acc") + F.bit_count("flip")).cast("int"))
        .filter(F.col("acc") <= radius)
        .withColumn("child", F.expr("bits ^ cast(flip AS bigint)"))
        .filter("flip = 0 OR NOT home OR child < bits")
        .select(
            "rot",
            (F.col("depth") + F.col("next")).cast("int").alias("depth"),
            F.expr("shiftleft(prefix, next) | child").alias("prefix"),
            "code",
            "acc",
            (F.col("home") & (F.col("flip") == 0)).alias("home"),
        )
    )


def fingerprint_links(codes: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) whose closure joins all distinct ``fp`` within ``radius`` bits."""
    if radius > len(BANDS) - 1:
        raise ValueError(f"radius must be below {len(BANDS)}")
    rotated = F.array(
        *[
            F.struct(
                F.lit(r).alias("rot"),
                F.lit(width).alias("depth"),
                _top(_rotl(F.col("fp"), shift), width).alias("prefix"),
                _rotl(F.col("fp"), shift).alias("code"),
            )
            for r, (shift, width) in enumerate(BANDS)
        ]
    )
    rows = codes.select(F.inline(rotated)).withColumn("acc", F.lit(0)).withColumn("home", F.lit(True))
    leaves = []
    while True:
        rows = materialize(rows, "simhash-nodes")
        counts = rows.groupBy(*NODE).agg(
            F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")
        )
        counts = materialize(counts.filter("homes > 0 AND homes + visitors > 1"), "simhash-counts")
        hot = (F.col("homes") > leaf) & (F.col("depth") < 64)
        met = rows.join(counts, NODE)
        chunks = F.greatest(F.lit(1), F.ceil(F.col("visitors") / F.lit(leaf))).cast("int")
        leaves.append(
            met.filter(~hot)
            .withColumn(
                "chunk",
                F.explode(
                    F.when(F.col("home"), F.sequence(F.lit(0), chunks - 1)).otherwise(
                        F.array(F.pmod(F.hash("code"), chunks))
                    )
                ),
            )
            .select(*NODE, "chunk", "code", "home")
        )
        if counts.filter(hot).isEmpty():
            break
        rows = _split(met.filter(hot).select(*NODE, "code", "acc", "home"), radius)
    dealt = leaves[0]
    for more in leaves[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.withColumn("leaf", F.xxhash64(*NODE, "chunk"))
    key = ["leaf", *NODE, "chunk"]
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of the batch's last leaf wait for the next batch.
            ids = _leaf_ids(batch)
            others = np.flatnonzero(ids != ids[-1])
            start = int(others[-1]) + 1 if len(others) else 0
            if held and _leaf_ids(held[-1])[-1] != ids[0]:
                yield _links(pa.Table.from_batches(held), radius)
                held = []
            if start:
                held.append(batch.slice(0, start))
                yield _links(pa.Table.from_batches(held), radius)
                held = []
            held.append(batch.slice(start))
        if held:
            yield _links(pa.Table.from_batches(held), radius)

    parts = dealt.repartition("leaf").sortWithinPartitions(*key)
    return map_arrow(parts, run, schema)


def _leaf_ids(batch) -> np.ndarray:
    return batch.column("leaf").to_numpy(zero_copy_only=False)


def _links(table: pa.Table, radius: int) -> pa.RecordBatch:
    change = np.zeros(table.num_rows, dtype=bool)
    for name in ("leaf", *NODE, "chunk"):
        v = table.column(name).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    code = table.column("code").to_numpy().astype(np.int64).view(np.uint64)
    a, b = leaf_links(np.cumsum(change), code, table.column("home").to_numpy().astype(bool), radius)
    shift = np.array([s for s, _ in BANDS], dtype=np.uint64)[table.column("rot").to_numpy()]
    fp = ((code >> shift) | (code << ((np.uint64(64) - shift) & np.uint64(63)))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])


# -- components -------------------------------------------------------------


def contract_components(links: DataFrame) -> list[DataFrame]:
    """Moves (v, to) per round of contraction; applied in order they take a vertex to its component's name.

    Every round puts the vertices in a new order by a hash of round and vertex,
    and each moves to the first of itself and its neighbours.  On a path about
    half of the vertices are left, whatever their numbers, so the rounds grow
    with the logarithm of a component's length.
    """
    moves = []
    edges = materialize(links.filter("a <> b").distinct(), "component-edges")
    while not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("to")).union(edges.select("b", "a"))
        first = both.groupBy("v").agg(F.min(place("to")).alias("first"))
        move = materialize(first.select("v", F.least(place("v"), "first").getField("id").alias("to")), "component-moves")
        moves.append(move)
        left, right = move.toDF("a", "a2"), move.toDF("b", "b2")
        edges = materialize(
            edges.join(left, "a").join(right, "b").filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            "component-edges",
        )
    return moves


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    k: int = SHINGLE_WORDS,
    leaf: int = LEAF,
) -> DataFrame:
    """One row per document: (doc_id, fp, text_hash, component_id), ``component_id`` the smallest reachable id.

    NULL, empty and blank texts have fingerprint zero, linked like any other.
    Repeated rows are returned as often as they occur; a NULL id never names a
    component unless no member has an id.  Only the id and text columns are
    read, so other columns cannot clash.  No rows give no rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), text_hash(text_col).alias("text_hash"))
    rows = materialize(with_fingerprints(narrow, "body", ["doc_id", "text_hash"], k), "simhash-fingerprints")
    names = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    names = materialize(names, "simhash-distinct")
    members = names.withColumn("at", F.col("fp"))
    for move in contract_components(fingerprint_links(names.select("fp"), radius, leaf)):
        step = move.withColumnRenamed("v", "at")
        members = members.join(step, "at", "left").select("fp", "first_id", F.coalesce("to", "at").alias("at"))
    members = materialize(members, "simhash-members")
    heads = members.groupBy("at").agg(F.min("first_id").alias("component_id"))
    component = members.join(heads, "at").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", "fp", "text_hash", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document names its component; a row repeated whole stays once."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy(F.col("component_id").alias("doc_id")).agg(F.min("text_hash").alias("text_hash"))
    return semi_rows(docs, first, id_col, text_col)
