import re

import pytest

from ledgermatch.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes):
    """Share by weight, stop at twice the size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 500, "c": 30, None: 7}, {"z": 1, "y": 0, "x": 0}, {"s": 40},
                                   {f"s{i}": (i * 37) % 101 for i in range(25)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def check(found, docs):
    """The contract: sizes, targets, and taken words near them, no document over twice its size."""
    by_source, taken = {}, {}
    for doc_id, text, source in docs:
        by_source[source] = by_source.get(source, 0) + len(words(text))
    want = plain_targets(by_source) if sum(by_source.values()) else {s: 0.0 for s in by_source}
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted((i, len(words(t))) for i, t, _ in docs if i is not None)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
    return by_source, want, taken


def test_edges(edge_docs, edge_rows):
    found = mixing.mix_sizes(edge_docs).collect()
    assert len(found) == len(edge_rows)
    by_source, want, _ = check(found, [(r[0], r[1], r[3] if len(r) > 3 else None) for r in edge_rows])
    source = {r[0]: r[3] if len(r) > 3 else None for r in edge_rows if r[0] is not None}
    taken = {}
    for r in found:
        if r.doc_id is not None:
            taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    # NULL ids belong to "a" and to no source.
    for s in ("b", "c"):
        assert taken[s] == int(want[s] + 1e-9)
    assert sum(r.taken for r in found) == sum(int(w + 1e-9) for w in want.values())


def test_schedule_follows_the_weights(spark, spark_sf):
    docs = spark.read.parquet(f"{spark_sf.replace('0.001', '0.01')}/documents.parquet")
    mix = mixing.plan_mix(docs)
    rows = sorted((r.slot, r.place, r.rank) for r in mix.schedule.collect())
    goal = {r.place: r.target for r in mix.targets.collect()}
    total = sum(goal.values())
    seen = {p: 0 for p in goal}
    assert len({r[0] for r in rows}) == len(rows)
    drawn = -(-int(total) // mix.block_words)
    for k, (slot, place, rank) in enumerate(rows, 1):
        if slot < drawn:
            assert rank == seen[place]  # ranks follow the slots
            if k % 997 == 0:
                assert all(abs(seen[p] - slot * goal[p] / total) < 12 for p in goal)
        seen[place] += 1
    for p, t in goal.items():
        assert seen[p] == -(-int(t) // mix.block_words)
    # Every slot finds a block, and a block holds as many words as any other but a source's last.
    words_in = {}
    for r in mix.takes().collect():
        words_in[r.slot] = words_in.get(r.slot, 0) + r.words
    assert len(words_in) == len(rows)
    assert sorted(set(words_in.values()))[-1] == mix.block_words
    assert sum(w < mix.block_words for w in words_in.values()) <= len(goal)


def test_sizes_of_the_query(spark, spark_sf):
    from ledgermatch.llm.queries import op5_source_mix

    sf = spark_sf.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op5_source_mix(spark, sf).collect()
    by_source, want, _ = check(found, docs)
    source = {i: s for i, _, s in docs}
    taken = {}
    for r in found:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == by_source[source[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = op5_source_mix(spark, sf).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_documents_of_the_mix(edge_docs, edge_rows, no_docs):
    mixed = mixing.mix_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    rows = mixed.collect()
    sizes = mixing.mix_sizes(edge_docs).collect()
    assert sum(len(words(r.text)) for r in rows) == sum(r.taken for r in sizes)
    text = {r[0]: r[1] for r in edge_rows}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert all(words(r.text) == words(text[r.doc_id])[: len(words(r.text))] for r in rows if r.doc_id is not None)
    assert mixing.mix_documents(no_docs).count() == mixing.mix_sizes(no_docs).count() == 0


def test_no_words(make_docs):
    docs = make_docs([(1, None, "en", "a"), (2, " \n", "en", None)])
    assert [(r.size, r.taken) for r in mixing.mix_sizes(docs).collect()] == [(0, 0), (0, 0)]
    assert mixing.mix_documents(docs).count() == 0


def test_running_sums_in_buckets(make_docs, monkeypatch):
    """Buckets of three rows give the same guarantees as one bucket."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    docs = [(i, "w " * (i % 7), "en", "ab"[i % 2] if i % 5 else None) for i in range(90)]
    found = mixing.mix_sizes(make_docs(docs)).collect()
    _, want, _ = check(found, [(i, t, s) for i, t, _, s in docs])
    taken = {}
    for r in found:
        s = docs[r.doc_id][3]
        taken[s] = taken.get(s, 0) + r.taken
    assert taken == {s: int(w + 1e-9) for s, w in want.items()}


def test_a_changed_schedule_changes_the_result(spark, spark_sf, monkeypatch):
    docs = spark.read.parquet(f"{spark_sf}/documents.parquet")
    golden = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix_sizes(docs).collect()}
    assert all((slot is None) == (taken == 0) for taken, slot in golden.values())
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    plain = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix_sizes(docs).collect()}
    assert {i: t for i, (t, _) in plain.items()} == {i: t for i, (t, _) in golden.items()}
    assert sum(plain[i] != golden[i] for i in golden) > len(golden) / 2


def test_blocks_are_the_mix_in_slot_order(spark, spark_sf, tmp_path):
    docs = spark.read.parquet(f"{spark_sf}/documents.parquet")
    text = {r.doc_id: words(r.text) for r in docs.collect()}
    mix = mixing.plan_mix(docs)
    slot_words = {}
    for r in mix.takes().collect():
        slot_words[r.slot] = slot_words.get(r.slot, 0) + r.words
    mixing.mix_blocks(docs, partitions=6).write.parquet(str(tmp_path / "mix"))
    rows = []
    for part in sorted((tmp_path / "mix").glob("part-*")):
        rows += spark.read.parquet(str(part)).coalesce(1).collect()
    assert [(r.slot, r.offset) for r in rows] == sorted((r.slot, r.offset) for r in rows)
    filled = {}
    for r in rows:
        assert r.text.split(" ") == text[r.doc_id][r.start : r.start + r.words]
        assert r.offset == filled.get(r.slot, 0)
        filled[r.slot] = r.offset + r.words
    assert filled == slot_words
    first = {}
    for r in rows:
        first.setdefault(r.doc_id, r.slot)
    assert first == {r.doc_id: r.first_slot for r in mixing.mix_sizes(docs).collect() if r.taken}
    # Any stretch of the mix is near the weights.
    goal = {r.source: r.target for r in mix.targets.collect()}
    total, seen = sum(goal.values()), {s: 0 for s in goal}
    for k, r in enumerate(rows, 1):
        seen[r.source] += r.words
        if k % 500 == 0:
            done = sum(seen.values())
            assert all(abs(seen[s] - done * goal[s] / total) < 15 * mix.block_words for s in goal)


def test_blocks_of_edges(edge_docs, edge_rows, no_docs):
    rows = mixing.mix_blocks(edge_docs).collect()
    assert sum(r.words for r in rows) == sum(r.taken for r in mixing.mix_sizes(edge_docs).collect())
    text = {r[0]: words(r[1]) for r in edge_rows}
    assert all(words(r.text) == text[r.doc_id][r.start : r.start + r.words] for r in rows if r.doc_id is not None)
    assert mixing.mix_blocks(no_docs).count() == 0
