"""Best-fit packing of token sequences under several capacities at once.

A document's ids are cut into pieces, and pieces are packed into sequences that
have a capacity of tokens, of documents and of attention cost (the sum of the
squared lengths).  What a piece needs of each depends on its length alone, so
the packing is decided on the histogram of lengths, at most one row per length
however many documents there are: pieces come longest first, and bins whose
residual capacities are equal form one cohort.  Of the cohorts in which a piece
fits under every constraint, the one with the least weighted residual norm (or
the greatest weighted dot product) takes it; a new bin is opened only if none
fits.  The decision is a table of ranges: the pieces of a length ranked so to
so go to these bins at this offset.  Spark ranks the pieces of each length by
two-level counts and looks their ranges up, so no piece passes the driver and
no two tasks pack against each other.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize

# White space as the library's regular expressions have it, Latin letters, ASCII signs but the apostrophe.
_W, _L, _P = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-&(-/:-@\[-`{-~"
#: Units of a text: white space and what follows it, up to the sign after a word.  No token crosses their borders.
_UNIT = re.compile(f"[{_W}]?[{_L}]+(?=[{_W}{_P}]|\\Z)|[{_W}]*[^{_W}]+|[{_W}]+")
#: Units that are one word for the pre-tokenizer.
_WORD = re.compile(f" ?[{_L}]+\\Z")
_BORDER = re.compile(f"(?<=[^{_W}])(?=[{_W}])")
#: Longer texts are cut into stretches of about so many characters.
STRETCH_CHARS = 1 << 20
#: Units up to this many characters are remembered: the last KEPT_UNITS and the KEPT_UNITS before (about 0.3 KB each).
KEPT_CHARS, KEPT_UNITS = 48, 250_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; ``weights`` are those of the selection rule, in this order."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)

    @property
    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.attention)) if self.documents > 0 else 0


# ---------------------------------------------------------------------------
# Pieces
# ---------------------------------------------------------------------------


class UnitIds(dict):
    """Ids of units, by the ``tokenizers`` library where they are not known yet.

    A unit that is one word goes to the library's merges without its
    pre-tokenizer.  When KEPT_UNITS are known they become the generation
    before, whose units are still found, and a new one begins.
    """

    def __init__(self, library):
        super().__init__()
        self.library, self.merges, self.before = library, library.model, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.before.get(unit)
        if ids is None:
            if _WORD.match(unit):
                ids = _packed([t.id for t in self.merges.tokenize(unit.encode().decode("latin-1").translate(_LETTERS))])
            else:
                ids = _packed(self.library.encode_batch_fast([unit], add_special_tokens=False)[0].ids)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= KEPT_UNITS:
                self.before = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class UnitEncoder:
    """Ids of texts by the ``tokenizers`` library, as packed little-endian 32-bit integers.

    The pre-tokenizer of a byte-level vocabulary never joins a non-space with
    white space after it, nor a letter with a sign after it but the apostrophe,
    so the ids of a text are those of its units in a row; units come back
    often, and their ids are kept.  Texts for a tokenizer of another kind go to
    the library whole.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        # Names of special tokens in a text are ordinary text.
        self.library.encode_special_tokens = True
        parts = json.loads(definition)
        own = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.in_units = parts.get("normalizer") is None and own.items() <= (parts.get("pre_tokenizer") or {}).items()
        self.ids = UnitIds(self.library)

    def encode(self, text: str) -> bytes:
        """The ids of a text; a long one goes stretch by stretch, each of whole units."""
        if not self.in_units:
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        if len(text) <= STRETCH_CHARS:
            return b"".join(map(self.ids.__getitem__, _UNIT.findall(text)))
        pos, parts = 0, []
        while pos < len(text):
            border = _BORDER.search(text, pos + STRETCH_CHARS)
            stop = border.start() if border else len(text)
            parts.append(b"".join(map(self.ids.__getitem__, _UNIT.findall(text[pos:stop]))))
            pos = stop
        return b"".join(parts)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@lru_cache(maxsize=2)
def _encoder(definition: str) -> UnitEncoder:
    return UnitEncoder(definition)


def cut_pieces(ids: bytes, longest: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces of a document: whole if it fits, else all but the first of ``longest`` ids."""
    n = len(ids) // 4
    first = n if n <= longest else n % longest or longest
    edges = [0, *range(first, n + 1, longest)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def tokenize_pieces(
    docs: DataFrame, definition: str, longest: int, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, token_ids) of every row of ``docs``, one row per piece.

    ``definition`` is the JSON of a byte-level tokenizer; it travels with the
    tasks.  ``end_id`` follows each document's ids.  NULL and empty texts have
    no other id; without an ``end_id`` they have no piece.  Repeated rows and
    NULL ids are documents of their own.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("token_ids", T.BinaryType()),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encoder = _encoder(sent.value)
        end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows, piece, start, ids = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for k, (at, own) in enumerate(cut_pieces(encoder.encode(text) + end, longest)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at)
                        ids.append(own)
                arrays = [part.column("doc_id").take(pa.array(rows, pa.int64())), piece, start, [len(x) // 4 for x in ids], ids]
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=arrow.field(j).type) for j, a in enumerate(arrays)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_arrow(given, run, schema)


# ---------------------------------------------------------------------------
# The plan
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks from ``rank`` on go to ``bins`` bins from ``bin`` on, ``each`` in a row, at ``offset``."""

    length: int
    rank: int
    bin: int
    bins: int
    each: int
    offset: int


def plan_bins(histogram: list[tuple[int, int]], capacity: Capacity, rule: str = "norm") -> tuple[list[Placement], int]:
    """Best-fit decreasing of (length, pieces): placements and the number of bins.

    ``rule`` "norm" prefers the bin whose residual, after the piece, is least in
    the weighted norm; "dot" the one whose residual has the greatest weighted
    dot product with the piece's needs.  Capacities count as shares of an empty
    bin's.  Doubling all counts doubles the bins of the cohorts, not their
    number, so plan and time follow the number of different lengths.
    """
    full = (capacity.tokens, capacity.documents, capacity.attention)
    shares, weights = np.array(full, float), np.array(capacity.weights, float)
    cohorts: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> ranges of bins (first, number)
    placements: list[Placement] = []
    opened = 0
    by_length = sorted(((int(n), int(c)) for n, c in histogram if c > 0), reverse=True)
    if by_length and by_length[0][0] > capacity.longest:
        raise ValueError("a piece is longer than an empty sequence allows")
    smallest = by_length[-1][0] if by_length else 0

    for length, pieces in by_length:
        need = (length, 1, length * length)
        rank = 0

        def room(residual):
            return min(r // d for r, d in zip(residual, need, strict=True))  # noqa: B023

        def cost(residuals):
            residuals = np.array(residuals, float)
            if rule == "dot":
                return (-(weights * residuals / shares) @ (np.array(need) / shares)).tolist()  # noqa: B023
            return (weights * ((residuals - need) / shares) ** 2).sum(axis=1).tolist()  # noqa: B023

        def put(residual, ranges, copies):
            """So many pieces into each bin of the ranges; returns what is then left of a bin."""
            nonlocal rank
            for first, bins in ranges:
                placements.append(Placement(length, rank, first, bins, copies, full[0] - residual[0]))  # noqa: B023
                rank += bins * copies
            rest = tuple(r - copies * d for r, d in zip(residual, need, strict=True))  # noqa: B023
            if rest[0] >= smallest and rest[1] >= 1 and rest[2] >= smallest * smallest:
                cohorts.setdefault(rest, []).extend(ranges)
            return rest

        fitting = [r for r in cohorts if room(r) > 0]
        queue = list(zip(cost(fitting), fitting, strict=True)) if fitting else []
        heapq.heapify(queue)
        while rank < pieces:
            left = pieces - rank
            if queue:
                residual = heapq.heappop(queue)[1]
                ranges = cohorts.pop(residual, None)
                if not ranges:  # a cohort that was queued twice
                    continue
                # A bin that is the best by its norm stays so until it is full; by the dot product its turn is over.
                each = room(residual) if rule == "norm" else 1
            else:
                residual, each = full, room(full)
                ranges = [(opened, -(-left // each))]
                opened += ranges[0][1]
            whole, over = [], []
            for first, bins in ranges:
                take = min(bins, left // each)
                left -= take * each
                if take:
                    whole.append((first, take))
                if take < bins:
                    over.append((first + take, bins - take))
            if whole:
                rest = put(residual, whole, each)
                if rest in cohorts and room(rest) > 0:
                    heapq.heappush(queue, (cost([rest])[0], rest))
            if left and over:  # fewer pieces than one bin takes
                first, bins = over.pop(0)
                put(residual, [(first, 1)], left)
                over = [(first + 1, bins - 1), *over] if bins > 1 else over
            if over:
                cohorts.setdefault(residual, []).extend(over)
    return placements, opened


# ---------------------------------------------------------------------------
# Packing
# ---------------------------------------------------------------------------


def _ranked(pieces: DataFrame) -> DataFrame:
    """Add ``_rank`` (from 0) within each length.

    Pieces are numbered inside (length, stripe), a stripe being a share of the
    written table, and each stripe goes on where the one before ends.  A length
    that a third of all pieces have is spread over all stripes.
    """
    inside = Window.partitionBy("length", "_stripe").orderBy("_rid")
    across = Window.partitionBy("length").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "_stripe").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    numbered = pieces.withColumn("_within", F.row_number().over(inside) - 1).join(counts, ["length", "_stripe"])
    return numbered.withColumn("_rank", F.col("_before") + F.col("_within")).drop("_before", "_within")


def pack_pieces(pieces: DataFrame, capacity: Capacity, rule: str = "norm") -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to pieces that have a ``length`` of at least 1.

    Pieces of one sequence follow each other without a gap from offset 0, the
    longest first.  ``pieces`` must be a written table or otherwise come out
    alike when it is read again, with a unique ``_rid`` (``numbered_pieces``).
    Only ``length`` and ``_rid`` of the other rows matter to a piece.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = [(r[0], r[1]) for r in pieces.groupBy("length").count().collect()]  # one row per length
    placements, _ = plan_bins(histogram, capacity, rule)
    table = np.array([(p.length, p.rank, p.bin, p.each, p.offset) for p in placements], np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = pieces.sparkSession.sparkContext.broadcast(table)
    stripes = pieces.withColumn("_stripe", F.shiftright("_rid", 33))
    ranked = _ranked(stripes)
    schema = T.StructType(
        [f for f in ranked.schema.fields if f.name not in ("_rank", "_stripe")]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, bins, each, offsets = sent.value.T
        shift = np.int64(1) << 48
        keys = lengths * shift + ranks
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = np.searchsorted(keys, length * shift + rank, "right") - 1
            turn = rank - ranks[row]
            sequence = bins[row] + turn // each[row]
            offset = offsets[row] + turn % each[row] * length
            kept = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return map_arrow(ranked, run, schema).drop("_rid")


def numbered_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with a unique ``_rid``, as a written table: the stripe of the number is the task that wrote them."""
    return materialize(pieces.withColumn("_rid", F.monotonically_increasing_id()), "pieces")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, token_ids, lengths) of placed pieces that carry their ``token_ids``: one training row per sequence."""
    row = F.struct("offset", "length", "token_ids")
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("_parts"))
    ids = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["token_ids"]))
    return parts.select("sequence_id", ids.alias("token_ids"), F.transform("_parts", lambda p: p["length"]).alias("lengths"))
