import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgermatch.llm import decision_list, quality_gbt, textstats


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\t", "a", "a a a a", "a b c a b c", "a b c d\na b c d\n\n\na b c d", "x" * 50, "é # 数 * $ é # 数 *", "a b a b a b a",
     "one two\r\none two\r\n one two", " ".join(str(i % 7) for i in range(500))],
)
def test_counts(text):
    assert textstats.text_counts(text)[:5] == plain_counts(text)


def test_repeats_with_many_distinct_words():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 9])
    assert textstats.repeated_words(ids, 1 << 21) == textstats.repeated_words(ids, 10) == 6


def test_counts_on_edges(edge_docs, edge_rows):
    got = textstats.with_counts(edge_docs, keep=["doc_id"]).collect()
    want = sorted(([r[0], *plain_counts(r[1])] for r in edge_rows), key=str)
    assert sorted(([r.doc_id, *[r[c] for c in textstats.COUNTS[:5]]] for r in got), key=str) == want


def test_trees_traverse_like_single_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality_gbt.fit_trees(x, y, trees=20, depth=3)

    def one(row):
        margin = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            margin += v[node - len(f)]
        return 1 / (1 + np.exp(-margin))

    scores = model.score(x)
    assert np.allclose(scores, [one(r) for r in x])
    assert ((scores > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("y", [[], [1.0] * 5, [0.0] * 3])
def test_trees_without_two_classes(y):
    model = quality_gbt.fit_trees(np.zeros((len(y), 3)), np.array(y))
    assert np.isfinite(model.score(np.zeros((2, 3)))).all()


def test_rules_find_a_planted_conjunction():
    rng = np.random.default_rng(1)
    counts = rng.integers(50, 200, size=(1500, len(textstats.COUNTS)))
    x = decision_list.statistics(counts)
    bad = (x["repeat_rate"] > 1.2) & (x["symbols_per_word"] > 0.8)
    rules = decision_list.learn_rules(counts, (~bad).astype(float))
    hit = np.zeros(len(counts), dtype=bool)
    for rule in rules:
        hit |= decision_list._covers(rule, x, len(counts))
    assert (hit == bad).mean() > 0.97
    assert decision_list.learn_rules(counts[:0], np.zeros(0)) == []


def test_rules_as_spark_expression(spark, edge_docs, edge_rows, no_docs):
    rules = [
        (decision_list.Condition("symbols_per_word", True, 0.25), decision_list.Condition("words", False, 5.0)),
        (decision_list.Condition("distinct_rate", False, 0.5),),
    ]
    got = decision_list.apply_rules(edge_docs, rules).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        counts = np.array([[r[c] for c in textstats.COUNTS]])
        bad = any(decision_list._covers(rule, decision_list.statistics(counts), 1)[0] for rule in rules)
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (base, not base and not bad)
    assert decision_list.apply_rules(no_docs, []).count() == 0


def test_held_out_quality(spark, spark_sf):
    """Trained and judged on the small tables: labels of the held-out third are matched."""
    import zlib

    from ledgermatch.llm.queries import op1_quality_gbt, op10_decision_list

    sf = spark_sf.replace("0.001", "0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_quality_gbt(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    rows = op10_decision_list(spark, sf).collect()
    assert all([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == plain_counts(text[r.doc_id]) for r in rows)
    judged = [r for r in rows if r.doc_id in label and not r.base_failed]
    assert sum(r.kept == bool(label[r.doc_id]) for r in judged) >= 0.95 * len(judged)
    assert not any(r.kept and r.base_failed for r in rows)


def test_scores_of_edges(edge_docs, edge_rows, no_docs):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 100, (200, len(textstats.COUNTS)))
    model = quality_gbt.fit_trees(quality_gbt.features(counts), (counts[:, 2] < 50).astype(float), trees=5)
    got = quality_gbt.score_quality(edge_docs, model)
    assert got.columns == [c for c in edge_docs.columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality_gbt.score_quality(no_docs, model).count() == 0


def test_training_on_nothing(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_gbt.train_quality(no_docs, labels).score(np.zeros((1, 13)))[0] == pytest.approx(0.5)
    assert decision_list.train_rules(no_docs, labels) == []


def test_repeated_ids_teach_once(spark, make_docs):
    """An id that holds most rows comes to the driver as one row, the same in any order."""
    rows = [(1, " ".join(["word"] * (i % 50 + 1))) for i in range(2000)] + [(i, f"some text {i}") for i in range(2, 30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    counts, y = quality_gbt.training_counts(make_docs(rows), labels, "quality", 25)
    used = [i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert 1 in used and len(y) == len(counts) == min(25, len(used))
    again, _ = quality_gbt.training_counts(make_docs(rows[::-1]), labels, "quality", 25)
    assert (counts == again).all()
