import random

import numpy as np
import pytest
import xxhash

from ledgermatch.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_components(codes, radius=2):
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    codes = sorted(parent)
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                parent[root(b)] = root(a)
    return {c: root(c) for c in codes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "A b c d a b c d", "É é x y z w " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_stretches(monkeypatch):
    text = " ".join(f"w{i * i % 101}" for i in range(900))
    whole = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda data: whole(data, 64))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_gray_rank_orders_neighbours():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def _near_codes(seed, centres, each, flips):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(each):
            bits = rng.choice(64, rng.integers(0, flips + 1), replace=False)
            out.add(int(c) ^ sum(1 << int(b) for b in bits))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_forest_finds_exactly_the_near_pairs(fanout):
    codes = np.array(sorted(_near_codes(1, 6, 40, 3)), dtype=np.uint64)
    group = np.arange(len(codes)) % 3
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    forest = simhash.GrayForest(codes, group, fanout)
    got = {(int(q), int(i)) for a, b in forest.search(codes, group, 2, chunk=50) for q, i in zip(a, b, strict=True)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near & (group[:, None] == group[None, :])), strict=True)}


@pytest.mark.parametrize("leaf", [3, 64])
def test_links_join_what_brute_force_joins(spark, leaf):
    """A small leaf sends most nodes through several splits."""
    codes = _near_codes(2, 12, 40, 4) | {0, 1, 3, 2**64 - 1, 2**63, 7 << 40}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.fingerprint_links(spark.createDataFrame([(c,) for c in signed], "fp long"), leaf=leaf).collect()
    want = plain_components(signed)
    parent = {c: c for c in signed}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for r in links:
        assert want[r.a] == want[r.b]
        parent[root(r.a)] = root(r.b)
    for a in signed:
        for b in signed:
            if want[a] == want[b]:
                assert root(a) == root(b)


def test_long_chain_contracts(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    moves = simhash.contract_components(spark.createDataFrame(edges, "a long, b long"))
    at = {v: v for e in edges for v in e}
    for move in moves:
        step = {r.v: r.to for r in move.collect()}
        at = {v: step.get(x, x) for v, x in at.items()}
    assert len({at[i] for i in range(41)}) == 1 and len({at[i] for i in (100, 101, 102)}) == 1
    assert at[0] != at[100]


def test_edges_match_brute_force(edge_docs, edge_rows):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    prints = [(r[0], plain_fingerprint(r[1])) for r in edge_rows]
    comp = plain_components([p for _, p in prints])
    name = {}
    for i, p in prints:
        if i is not None:
            name[comp[p]] = min(i, name.get(comp[p], i))
    want = sorted(((i, p, name.get(comp[p])) for i, p in prints), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == want


def test_one_of_each_group_stays(edge_docs, no_docs):
    kept = simhash.keep_one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    found = simhash.near_duplicates(edge_docs).select("component_id").distinct().count()
    assert kept.count() == found
    assert simhash.keep_one_per_group(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_long_paths_contract_in_few_rounds(spark, order):
    """A path of 1,000 links, a star, a ring and single links: one name each, in rounds by the logarithm."""
    path = list(range(1001))
    if order == "falling":
        path.reverse()
    if order == "shuffled":
        random.Random(1).shuffle(path)
    links = list(zip(path, path[1:], strict=False))
    links += [(5000, 5000 + i) for i in range(1, 50)] + [(6000 + i, 6000 + (i + 1) % 40) for i in range(40)] + [(7000, 7001), (7001, 7000), (7002, 7002)]
    moves = simhash.contract_components(spark.createDataFrame(links, "a long, b long"))
    assert len(moves) <= 15
    name = {}
    for move in [{r.v: r.to for r in m.collect()} for m in moves]:
        name = {v: move.get(at, at) for v, at in name.items()} | {v: to for v, to in move.items() if v not in name}
    groups = {}
    for v, at in name.items():
        groups.setdefault(at, set()).add(v)
    assert sorted(map(sorted, groups.values())) == [list(range(1001)), list(range(5000, 5050)), list(range(6000, 6040)), [7000, 7001]]
