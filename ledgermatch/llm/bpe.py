"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before they reach the library, where white space follows a
non-space: a match of the splitting pattern that holds a non-space ends there,
and none looks behind.  A stretch without such a place is cut into its matches:
a run of letters, of digits or of other signs is one, with the space before it,
apart from contractions; a run of white space is one without its last
character, which is taken along if it is a space and stands alone otherwise.
A match too long for the library is merged here.  So ids equal those of the
library over the whole text at any length.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8, with_text_columns

#: Texts up to this many characters go to the library as they are.
DIRECT_CHARS = 8192

# White space as the library's regular expressions have it.
_SPACE_START = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
_STRETCH = regex.compile(r"(\p{White_Space}*)(\P{White_Space}*)", regex.DOTALL)
_RUNS = regex.compile(r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+")
#: What the pattern takes along after an apostrophe that stands alone.
_CONTRACTIONS = regex.compile("s|t|re|ve|m|ll|d")


@lru_cache(maxsize=4)
def load_encoding(rank_file: str, pattern: str):
    """The library's encoder for a rank file of ``base64 id`` lines, no special tokens."""
    import tiktoken

    ranks = {}
    with open(rank_file, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, limit: int = DIRECT_CHARS):
    """Cut ``text`` into chunks whose encodings join to that of the whole.

    Yields (chunk, single): ``single`` marks a chunk that is one match of the
    pattern and longer than ``limit``.
    """
    pos, n = 0, len(text)
    while n - pos > limit:
        cut = pos
        for m in _SPACE_START.finditer(text, pos + 1, pos + limit):
            cut = m.start()
        if cut > pos:
            yield text[pos:cut], False
        else:
            following = _SPACE_START.search(text, pos + limit)
            cut = following.start() if following else n
            yield from _stretch_chunks(text[pos:cut], limit)
        pos = cut
    if pos < n:
        yield text[pos:], False


def _matches(stretch: str):
    """(match, is white space) for each match of the pattern in a stretch: white space, then none."""
    space, rest = _STRETCH.fullmatch(stretch).groups()
    if not rest:
        yield space, True
        return
    if len(space) > 1:
        yield space[:-1], True
    lead = space[-1:]
    if lead and lead != " ":
        yield lead, True
        lead = ""
    taken = 0
    runs = _RUNS.findall(rest)
    for run, after in zip(runs, [*runs[1:], ""], strict=True):
        run, taken = run[taken:], 0
        if run == "'" and not lead and (m := _CONTRACTIONS.match(after)):
            run, taken = run + m.group(), m.end()
        if run:
            yield lead + run, False
        lead = ""


def _stretch_chunks(stretch: str, limit: int):
    group: list[str] = []
    size = 0
    for match, is_space in _matches(stretch):
        alone = is_space or len(match) > limit
        if group and (alone or size + len(match) > limit):
            yield "".join(group), False
            group, size = [], 0
        if alone:
            yield match, len(match) > limit
        else:
            group.append(match)
            size += len(match)
    if group:
        yield "".join(group), False


def _merge_piece(enc, piece: bytes) -> list[int]:
    """Byte-pair merges of one long piece: a heap of adjacent pairs, lowest rank first, leftmost on ties."""
    import heapq

    ranks = enc._mergeable_ranks
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = nxt[i]
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if nxt[i] < n:
            r = ranks.get(piece[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        p = prv[i]
        if p >= 0:
            r = ranks.get(piece[p : end[i]])
            if r is not None:
                heapq.heappush(heap, (r, p, end[i]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def encode_text(enc, text: str, limit: int = DIRECT_CHARS) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for chunk, single in safe_chunks(text, limit):
        ids += _merge_piece(enc, chunk.encode("utf-8")) if single else enc.encode_ordinary(chunk)
    return ids


def encode_documents(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``n_tokens``, ``token_ids`` and ``decoded`` to every row.

    ``token_ids`` packs the ids as little-endian unsigned 32-bit integers;
    ``decoded`` holds the raw bytes that the ids stand for.  A NULL or empty
    text has no ids and no bytes.  Every row is encoded on its own, so
    repeated rows and any other column are carried unchanged.
    """

    def run(texts):
        enc = load_encoding(rank_file, pattern)
        counts, packed, decoded = [], [], []
        for text in texts:
            ids = encode_text(enc, utf8(text).decode("utf-8", "replace"))
            counts.append(len(ids))
            packed.append(np.asarray(ids, dtype="<u4").tobytes())
            decoded.append(enc.decode_bytes(ids))
        return [counts, packed, decoded]

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("token_ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
    return with_text_columns(docs, text_col, fields, run, keep)
