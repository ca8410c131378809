import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import packing, queries

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def definition():
    with open(BYTE_BPE, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return t


def whole_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_gapless(rows, most):
    """Each sequence is filled from offset 0 without a gap, up to ``most`` tokens."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return by


def plain_best_fit(lengths, capacity, rule):
    """One piece after the other, longest first, against every open bin."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    w = np.array(capacity.weights)
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], float)
        fit = [b for b in range(len(bins)) if (bins[b] >= need).all()]
        if not fit:
            bins.append(full - need)
            continue
        if rule == "dot":
            best = max(fit, key=lambda b: (w * bins[b] / full) @ (need / full))
        else:
            best = min(fit, key=lambda b: (w * ((bins[b] - need) / full) ** 2).sum())
        bins[best] = bins[best] - need
    return len(bins)


def unfold(placements):
    for p in placements:
        for b, j in itertools.product(range(p.bins), range(p.each)):
            yield p.length, p.rank + b * p.each + j, p.bin + b, p.offset + j * p.length


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_is_best_fit_under_every_constraint(rule):
    rng = random.Random(5)
    for trial in range(40):
        capacity = packing.Capacity(
            tokens=rng.choice([20, 64, 100]), documents=rng.choice([2, 3, 50]), attention=rng.choice([500, 2000, 10_000]),
            weights=(1.0, rng.choice([0.0, 0.5]), rng.choice([0.0, 0.5])),
        )
        lengths = [rng.randint(1, capacity.longest) for _ in range(rng.choice([1, 30, 200]))]
        histogram = Counter(lengths)
        placements, opened = packing.plan_bins(list(histogram.items()), capacity, rule)
        bins, ranks = defaultdict(list), defaultdict(list)
        for length, rank, b, offset in unfold(placements):
            bins[b].append((offset, length))
            ranks[length].append(rank)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        assert set(bins) == set(range(opened))
        for parts in bins.values():
            ends = list(itertools.accumulate(n for _, n in sorted(parts)))
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
            assert ends[-1] <= capacity.tokens and len(parts) <= capacity.documents
            assert sum(n * n for _, n in parts) <= capacity.attention
        # Ties between bins of equal score may fall otherwise.
        assert abs(opened - plain_best_fit(lengths, capacity, rule)) <= max(1, opened // 20)


def test_plan_follows_the_lengths_not_the_counts():
    rng = random.Random(1)
    histogram = Counter(min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    one, opened = packing.plan_bins(list(histogram.items()), packing.Capacity())
    many, more = packing.plan_bins([(n, 1000 * c) for n, c in histogram.items()], packing.Capacity())
    assert len(many) <= 1.5 * len(one)
    assert abs(more - 1000 * opened) <= 0.01 * more
    tokens = sum(n * c for n, c in histogram.items())
    assert opened <= -(-tokens // 1024) * 1.01 + 1


def test_plan_edges():
    assert packing.plan_bins([], packing.Capacity()) == ([], 0)
    assert packing.plan_bins([(3, 0)], packing.Capacity()) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan_bins([(11, 1)], packing.Capacity(tokens=10))
    assert packing.Capacity(tokens=1024, attention=100).longest == 10


@pytest.mark.parametrize(("n", "lengths"), [(0, []), (1, [1]), (8, [8]), (9, [1, 8]), (16, [8, 8]), (21, [5, 8, 8])])
def test_cut_pieces(n, lengths):
    ids = np.arange(n, dtype="<u4").tobytes()
    pieces = packing.cut_pieces(ids, 8)
    assert [len(p) // 4 for _, p in pieces] == lengths
    assert b"".join(p for _, p in pieces) == ids
    assert [a for a, _ in pieces] == [sum(lengths[:i]) for i in range(len(lengths))]


def test_units_equal_the_library(library, definition, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "Zz", "é", "word", "ñandú,", "_", "数据", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "'", "'s", "'ll", "12", ".", "!?", "<|endoftext|>", "\U0001f600", "​", "٣"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    monkeypatch.setattr(packing, "STRETCH_CHARS", 16)
    monkeypatch.setattr(packing, "KEPT_UNITS", 100)
    encoder = packing.UnitEncoder(definition)
    for _ in range(2):
        for t in texts:
            assert encoder.encode(t) == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert encoder.ids.before and len(encoder.ids) <= 100


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["Two words,  and MORE.", "", "é\n数据", "x" * 50]
    with open(path, encoding="utf-8") as f:
        encoder = packing.UnitEncoder(f.read())
    for t in texts:
        assert encoder.encode(t) == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    rows = [r.asDict() for r in queries.op13_vector_packing(spark, "/root/testdata/sf0.001").collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(docs)
    for doc_id, pieces in by.items():
        ids, at = whole_ids(library, docs[doc_id]), 0
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        for k, p in enumerate(pieces):
            assert p["start"] == at and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            assert p["length"] == 1024 if k else p["length"] <= 1024
            at += p["length"]
        assert at == len(ids)
    sequences = check_gapless(rows, 1024)
    assert len(sequences) <= plain_best_fit([r["length"] for r in rows], packing.Capacity(), "norm") + 1


def test_edges(make_docs, edge_rows, library, definition):
    docs = make_docs(edge_rows)
    pieces = packing.numbered_pieces(packing.tokenize_pieces(docs, definition, 1024))
    placed = packing.pack_pieces(pieces, packing.Capacity())
    got = [r.asDict() for r in placed.collect()]
    check_gapless(got, 1024)
    expected = Counter()
    for r in edge_rows:
        ids = whole_ids(library, r[1])
        head = len(ids) % 1024 or 1024
        for a in [0, *range(head, len(ids), 1024)] if len(ids) > 1024 else [0]:
            b = min(len(ids), head if a == 0 and len(ids) > 1024 else a + 1024)
            expected[(r[0], a, crc(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["start"], zlib.crc32(r["token_ids"])) for r in got) == expected
    # Sequences as training rows hold all ids of their pieces in order.
    rows = packing.packed_sequences(placed).collect()
    assert sum(len(r.token_ids) // 4 for r in rows) == sum(r["length"] for r in got)
    assert all(sum(r.lengths) * 4 == len(r.token_ids) for r in rows)
    by = {(r["sequence_id"], r["offset"]): r["token_ids"] for r in got}
    for r in rows:
        at = 0
        for n in r.lengths:
            assert bytes(r.token_ids[4 * at : 4 * (at + n)]) == bytes(by[(r.sequence_id, at)])
            at += n


def test_tight_capacities_and_clashing_names(spark):
    capacity = packing.Capacity(tokens=100, documents=3, attention=4000)
    lengths = [1 + (7 * i) % capacity.longest for i in range(500)]
    frame = spark.createDataFrame([(i, n, "x", i) for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id string, offset long")
    placed = packing.pack_pieces(packing.numbered_pieces(frame.repartition(5)), capacity, "dot")
    assert placed.columns.count("sequence_id") == 1
    per = placed.groupBy("sequence_id").agg(F.sum("length"), F.count("*"), F.sum(F.col("length") * F.col("length"))).collect()
    assert all(r[1] <= 100 and r[2] <= 3 and r[3] <= 4000 for r in per)
    check_gapless([r.asDict() for r in placed.collect()], 100)
    assert sorted(r.doc_id for r in placed.collect()) == list(range(500))


def test_no_rows(no_docs, definition):
    pieces = packing.numbered_pieces(packing.tokenize_pieces(no_docs, definition, 1024))
    assert packing.pack_pieces(pieces, packing.Capacity()).count() == 0
    assert packing.packed_sequences(packing.pack_pieces(pieces, packing.Capacity())).count() == 0
