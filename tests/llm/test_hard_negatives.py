import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm import hard_negatives as hn
from ledgermatch.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block string, v string, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Every anchor against every row, in plain Python."""
    one = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (label, [math.floor(scale * float(np.float32(c))) for c in x])
        one[vec_id] = min(one.get(vec_id, row), row)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = set()
    for a, (label, x) in one.items():
        if not anchor(a):
            continue
        scored = sorted((-dot(x, y), i, other) for i, (other, y) in one.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [(s, i) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p]
            out |= {(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(hits[:negatives], 1)}
    return out


def mined(df, anchor, **options):
    rows = hn.mine_hard_negatives(df, anchor, **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ).collect()
    got = [tuple(r) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, dim, seed, labels=3, copies=0.3, step=0.05):
    """Coarse values and many copies, so that scores tie."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < copies:
            rows.append((i, rng.choice(rows)[1], rng.randrange(labels)))
        else:
            rows.append((i, [round(rng.gauss(0.1, 0.3) / step) * step for _ in range(dim)], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_across_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hn, "CHUNK_ANCHORS", 5)
    rows = vectors(300, 6, seed)
    got = mined(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert got


def test_other_windows_and_numbers(spark):
    rows = vectors(200, 4, 9, labels=5)
    options = {"positives": 2, "negatives": 7, "low": 10, "high": 130, "scale": 10}
    assert mined(table(spark, rows), F.col("vec_id") < 30, **options) == brute(rows, lambda i: i < 30, **options)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.3, 0.3], 2), (3, [0.3, 0.3], 2), (4, None, 1), (5, [0.5, None], 1),
        (6, [nan, 0.5], 1), (7, [inf, 0.5], 2), (8, [0.4, 0.4], None), (None, [0.4, 0.4], 2), (9, [0.35], 3), (10, [], 3),
        (11, [0.0, 0.0], 4), (12, [0.0, 0.0], 4), (13, [-0.5, -0.5], 5), (14, [0.5, 0.4, 0.1], 5), (0, [0.5, 0.5], 1),
        (2, [0.1, 0.3], 2), (15, [0.3, 0.3], 2),
    ]
    got = mined(table(spark, rows), F.col("vec_id") >= 0)
    assert got == brute(rows, lambda i: True)
    # A positive of score 0 has the rows of score 0 as its negatives.
    assert any(p == 0 for *_, p, _ in got)


def test_nothing_to_mine(spark):
    assert mined(table(spark, []), F.col("vec_id") >= 0) == set()
    rows = vectors(20, 3, 1)
    assert mined(table(spark, rows), F.col("vec_id") < 0) == set()
    assert mined(table(spark, rows), F.lit(None).cast("boolean")) == set()


def test_text_labels_and_small_ids(spark):
    rows = vectors(80, 4, 2)
    df = spark.createDataFrame([(i, x, f"label {lab}") for i, x, lab in rows], "vec_id int, embedding array<float>, label string")
    assert mined(df, F.col("vec_id") % 4 == 0, scale=1 << 10) == brute(rows, lambda i: i % 4 == 0, scale=1 << 10)


def test_large_components(spark):
    rows = [(i, [float((i * 37 % 101) * 70_000), float(i)], i % 2) for i in range(40)]
    assert mined(table(spark, rows), F.col("vec_id") < 9, scale=16) == brute(rows, lambda i: i < 9, scale=16)
    with pytest.raises(Exception, match="31 bits"):
        mined(table(spark, [(0, [1e9], 0)]), F.col("vec_id") == 0)


@pytest.mark.parametrize("kind", ["peaked", "flat", "equal"])
def test_lists_stop_early_and_stay_exact(kind):
    rng = np.random.default_rng(4)
    n, dim = 2000, 5
    x = rng.integers(-100, 100, (n, dim))
    if kind == "peaked":
        x[:20] = 400 + rng.integers(0, 50, (20, dim))
    if kind == "equal":
        x[:] = x[0]
    ids = rng.permutation(n) * 3
    lists = hn.SortedLists(ids, x, 500.0)
    for trial in range(10):
        anchor = rng.integers(-60, 500, dim) if kind != "peaked" else np.full(dim, 300)
        if trial == 9:
            anchor = np.zeros(dim, np.int64)
        rows, scores = lists.best(anchor, int(ids[trial]), 5)
        full = sorted((-int(x[i] @ anchor), int(ids[i])) for i in range(n) if ids[i] != ids[trial])[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, lists.ids[rows], strict=True)] == full
    if kind == "peaked":
        assert lists.met < 0.2 * n * 10


def test_exact_number_types():
    for big in (1000, 1 << 24, 1 << 27):
        x = np.array([[big, 1], [big, 2], [big - 1, 5]], np.int64)
        anchor = np.array([big, 1])
        rows, scores = hn.SortedLists(np.arange(3), x, float(big)).best(anchor, -1, 3)
        assert [int(s) for s in scores] == sorted((int(v) for v in x @ anchor), reverse=True)
    with pytest.raises(OverflowError):
        hn.SortedLists(np.arange(2), np.full((2, 2), 1 << 32), 2.0**32)


def test_query_has_its_columns(spark):
    df = queries.op11_threshold_negatives(spark, "/root/testdata/sf0.001")
    assert df.schema["rank"].dataType == T.IntegerType()
    assert [c for c, t in df.dtypes if t == "bigint"] == ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
