"""Fill-in-the-middle over chunks whose summaries are remembered by content.

A text is a row of tokens: a word with the white space before it, or white
space that ends the text.  To cut it after a given number of tokens, its UTF-8
bytes are divided where a rolling hash of the last 32 bytes has low zero bits,
so that passages which documents share give the same chunks wherever they
stand.  A chunk's summary says how many words end inside it, how many code
points it has, and whether it begins and ends with white space; it is computed
once per content and found again by the content itself, in a cache of bounded
size.  The summaries of a text's chunks add up, with a word end at a border
where a word meets white space, to its number of tokens, and their running sums
tell in which chunk a cut lies; only that chunk is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: What marks the parts of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The hash looks at the last so many bytes; its chunks have about 2 ** CHUNK_BITS bytes.
WINDOW, CHUNK_BITS = 32, 9
#: Contents longer than this are not kept; a cache that has grown to CACHE_BYTES is begun anew.
LONGEST_KEPT, CACHE_BYTES = 1 << 14, 32 << 20
#: Documents are taken together up to about so many bytes.
BATCH_BYTES = 1 << 20

_GEAR = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 32, 256, dtype=np.uint32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the WINDOW bytes up to it (fewer at the start): sum of gear[b[i - j]] << j.

    Windows of 1, 2, 4, ... bytes are doubled: the hash of a window is that of
    its later half plus that of its earlier half, shifted.
    """
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = wider, 2 * width
    return h


def chunk_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks begin: at every text's start (``begins``), and after a byte whose window's hash says so.

    Windows that reach into the text before never cut, so a text's chunks do
    not depend on its neighbours; no code point is divided.
    """
    hit = np.flatnonzero(rolling_hash(data)[:-1] >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    hit = hit[(data[hit] & 0xC0) != 0x80]
    own = begins[np.searchsorted(begins, hit, "right") - 1]
    return np.union1d(begins, hit[hit - own >= WINDOW])


def summarize(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(words that end inside, code points, begins with white space, ends with white space) of a non-empty chunk."""
    b = np.frombuffer(chunk, np.uint8)
    space = _IS_SPACE[b]
    ends = int(np.count_nonzero(space[1:] & ~space[:-1]))
    return ends, int(np.count_nonzero((b & 0xC0) != 0x80)), bool(space[0]), bool(space[-1])


class ChunkCache:
    """Summaries by content.  A dictionary compares whole contents, so a hash that two share does no harm."""

    def __init__(self, most_bytes: int = CACHE_BYTES):
        self.known, self.size, self.most_bytes = {}, 0, most_bytes
        self.found = self.made = 0

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        s = self.known.get(chunk)
        if s is not None:
            self.found += 1
            return s
        s = summarize(chunk)
        self.made += 1
        if len(chunk) <= LONGEST_KEPT:
            if self.size > self.most_bytes:
                self.known.clear()
                self.size = 0
            self.known[chunk] = s
            self.size += len(chunk) + 200
        return s


class ChunkedTexts:
    """The chunks of several non-empty texts, with running counts of word ends and code points."""

    def __init__(self, texts: list[bytes], cache: ChunkCache):
        self.data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        self.starts = chunk_starts(np.frombuffer(self.data, np.uint8), self.text_start)
        self.stops = np.append(self.starts[1:], len(self.data))
        rows = [cache.summary(self.data[a:b]) for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True)]
        ends, points, head, tail = (np.array(c) for c in zip(*rows, strict=True))
        self.inner = ends.astype(np.int64)
        self.first = np.searchsorted(self.starts, self.text_start)
        self.last = np.append(self.first[1:], len(self.starts)) - 1
        # A word also ends at a chunk's end if white space or the end of the text follows.
        follows = np.append(head[1:], True)
        follows[self.last] = True
        self.word_ends = np.concatenate(([0], np.cumsum(self.inner + (~tail & follows))))
        self.points = np.concatenate(([0], np.cumsum(points.astype(np.int64))))
        self.words = self.word_ends[self.last + 1] - self.word_ends[self.first]
        self.tokens = self.words + tail[self.last]

    def cut(self, text: int, count: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``count`` tokens of a text."""
        start, first = int(self.text_start[text]), int(self.first[text])
        if count == 0:
            return 0, 0
        if count > self.words[text]:
            at, chunk = int(self.text_end[text]), int(self.last[text]) + 1
            return at - start, int(self.points[chunk] - self.points[first])
        target = int(self.word_ends[first]) + count
        chunk = int(np.searchsorted(self.word_ends, target)) - 1
        left = target - int(self.word_ends[chunk])
        a, b = int(self.starts[chunk]), int(self.stops[chunk])
        points = int(self.points[chunk] - self.points[first])
        if left > self.inner[chunk]:
            return b - start, points + int(self.points[chunk + 1] - self.points[chunk])
        inside = np.frombuffer(self.data, np.uint8, b - a, a)
        space = _IS_SPACE[inside]
        stop = int(np.flatnonzero(space[1:] & ~space[:-1])[left - 1]) + 1
        return a + stop - start, points + int(np.count_nonzero((inside[:stop] & 0xC0) != 0x80))


def rearrange(text: bytes, form: str, cuts: tuple[int, int]) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    parts = (p, prefix, s, suffix) if form == "psm" else (s, suffix, p, prefix)
    return b"".join((*parts, m, middle))


def restore_text(output: Column, form: Column) -> Column:
    """The text that an output and its form came from.

    Texts that hold a mark stay plain, and none can arise where a part meets a
    mark, so each mark stands exactly once in any other output.
    """
    def rest(first, second):
        """The parts after the first mark, after the second, and after the last."""
        i, j = F.instr(output, F.lit(second)), F.instr(output, F.lit(MIDDLE))
        size = F.lit(len(first))
        return F.substring(output, size + 1, i - size - 1), F.substring(output, i + size, j - i - size), F.substring(output, j + size, F.length(output))

    prefix, suffix, middle = rest(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = rest(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed and id; a NULL id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def fim_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
) -> DataFrame:
    """Append ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    The draws depend on seed and id alone, so repeated rows come out alike and
    a rerun agrees; a NULL id draws like the empty string.  A NULL text counts
    as empty: no tokens, plain, an empty output.  White space alone is one
    token.  A text that holds a mark stays plain.  Input columns named like a
    result column are replaced; ``keep`` names those to carry (default: all).
    """
    new = [f.name for f in FIELDS]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = T.StructType([docs.schema[c] for c in carried] + FIELDS)
    given = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)],
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"),
        *_draws(f"`{id_col}`", seed),
    )
    n_carried = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, cache = to_arrow_schema(schema), ChunkCache()
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right")))
                part = batch.slice(begin, stop - begin)
                results = _transform(part, cache, fim_percent, spm_percent)
                arrays = [part.column(i) for i in range(n_carried)]
                arrays += [pa.array(r, type=arrow.field(name).type) for name, r in zip(new, results, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *new])
                begin = stop

    return map_arrow(given, run, schema)


def _transform(part: pa.RecordBatch, cache: ChunkCache, fim_percent: int, spm_percent: int) -> tuple[list, ...]:
    texts = part.column("_text").to_pylist()
    h1, h2, h3, h4 = (part.column(f"_h{i}").to_numpy() for i in range(1, 5))
    filled = [i for i, t in enumerate(texts) if t]
    chunks = ChunkedTexts([texts[i] for i in filled], cache) if filled else None
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    place = dict(zip(filled, range(len(filled)), strict=True))
    out: tuple[list, ...] = ([], [], [], [], [])
    for i, text in enumerate(texts):
        n = int(chunks.tokens[place[i]]) if text else 0
        form, cuts, points = "plain", (0, 0), (None, None)
        if text and h3[i] % 100 < fim_percent and not any(m in text for m in marks):
            form = "spm" if h4[i] % 100 < spm_percent else "psm"
            a, b = sorted((int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)))
            (x, px), (y, py) = chunks.cut(place[i], a), chunks.cut(place[i], b)
            cuts, points = (x, y), (px, py - px)
        for column, value in zip(out, (n, form, *points, rearrange(text, form, cuts)), strict=True):
            column.append(value)
    return out
