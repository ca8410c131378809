import hashlib
import random
import struct

import public_tokenizers
import pytest

from ledgermatch.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.load_encoding(RANKS, public_tokenizers.PATTERN)


PARTS = [
    "hello", " ", "  ", "\n", "\t", "\n\n ", "'", "'s", "'ll", "'t", "''", "1234", "x9", "9x", "!!!", "!'s", "été", "数据", "ß",
    " ", "  ", " 12", " 'd", "don't", "it's", "🙂", "é", "a" * 40, "7" * 33, "*" * 37, " " * 35, "'" * 30,
]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("limit", [4, 16, 64])
def test_cut_texts_encode_as_whole(enc, seed, limit):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))
        ids = bpe.encode_text(enc, text, limit)
        assert ids == enc.encode_ordinary(text), repr(text)
        assert enc.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 5000 + "x", "x" + " " * 5000, "é" * 3000, "ab " * 4000, "1" * 5000 + "a", "!" * 4000 + "'s"])
def test_runs(enc, text):
    assert bpe.encode_text(enc, text, 512) == enc.encode_ordinary(text)


def test_documents(enc, edge_docs, edge_rows, no_docs):
    got = bpe.encode_documents(edge_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        ids = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_equals_library(enc, spark, spark_sf):
    from ledgermatch.llm.queries import op6_byte_bpe

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{spark_sf}/documents.parquet").collect()}
    rows = op6_byte_bpe(spark, spark_sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
