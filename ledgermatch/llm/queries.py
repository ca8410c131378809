"""Queries that apply the text operators to their whole tables, with DuckDB SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decision_list, exact_dedup, fim, hard_negatives, langid, mixing, packing, pii, quality_gbt, simhash, toxicity_cnn, warc
)
from .common import read_table, split_remainder

#: A deployment passes its own secret.
SURROGATE_KEY = b"ledgermatch surrogate key"


def _held_out(parts: int, remainder: int):
    return F.coalesce(split_remainder(F.col("doc_id"), parts) == remainder, F.lit(False)).alias("held_out")


def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality_gbt.train_quality(docs, labels)
    scored = quality_gbt.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    records = warc.archive_pages(pages)
    kind = pages.schema["page_id"].dataType
    return records.select(
        warc.page_id_of("record_id").cast(kind).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        warc.page_id_of("refers_to").cast(kind).alias("refers_to"),
        "error",
    )


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.surrogate_documents(docs, SURROGATE_KEY)
    return done.select("doc_id", "text", F.size("spans").cast("long").alias("n_entities"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity_cnn.train_toxicity(docs, labels)
    scored = toxicity_cnn.score_toxicity(docs, model, keep=["doc_id"])
    toxic = F.col("score") >= toxicity_cnn.THRESHOLD
    return scored.select("doc_id", _held_out(3, 1), "score", toxic.cast("int").alias("predicted"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"]
    )
    return ids.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict_languages(docs, langid.train_languages(docs), keep=["doc_id"])
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rules = decision_list.train_rules(docs, labels)
    judged = decision_list.apply_rules(docs, rules, keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    vec_id, label = F.col("vec_id"), F.col("label")
    vectors = vectors.withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine_hard_negatives(vectors, vec_id % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fim_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    restored = fim.restore_text(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    capacity = packing.Capacity()
    pieces = packing.tokenize_pieces(read_table(spark, sf_dir, "documents"), definition, capacity.longest)
    digests = pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")
    placed = packing.pack_pieces(packing.numbered_pieces(digests), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_gbt, op2_warc_zstd, op3_pii_surrogates, op4_toxicity_cnn, op5_source_mix, op6_byte_bpe,
        op7_language_kernel, op8_simhash_gray, op9_block_naming, op10_decision_list, op11_threshold_negatives,
        op12_fill_in_middle, op13_vector_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        g AS (SELECT *, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS head FROM p)
        SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> head THEN head END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM g
    """,
    # A source is full if what all would take at its own level falls short of the mix.
    "op5_source_mix": """
        WITH d AS (
          SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
          FROM documents
        ),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
                 [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
          FROM d GROUP BY source
        ),
        f AS (
          SELECT a.source, a.source_size, a.cap, a.weight,
                 sum(least(b.weight * a.cap / a.weight, b.cap)) < 1.5::DOUBLE * sum(b.source_size) AS is_full
          FROM s a, s b GROUP BY ALL
        ),
        t AS (
          SELECT source, source_size,
                 CASE WHEN is_full THEN cap ELSE (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (is_full) OVER (), 0))
                   / (sum(weight) FILTER (NOT is_full) OVER ()) * weight END AS target
          FROM f
        ),
        lines AS (
          SELECT *, CAST(floor(target) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t
        ),
        facts AS (
          SELECT sum(words) AS total, count(*) AS n, greatest(16, least(4096, total // greatest(1, n * 2000))) AS block,
                 CAST((total + block - 1) // block AS BIGINT) AS n_slots
          FROM lines
        ),
        spans AS (
          SELECT place, (words + block - 1) // block AS slots,
                 sum(words) OVER (ORDER BY place) * 2147483648 // greatest(total, 1) AS hi,
                 (sum(words) OVER (ORDER BY place) - words) * 2147483648 // greatest(total, 1) AS lo
          FROM lines, facts
        ),
        -- The golden ratio's fraction in 31 bits, times the slot: a point per slot, looked up in the sources' spans.
        drawn AS (
          SELECT slot, place, slots, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank
          FROM (SELECT unnest(range(n_slots)) AS slot, slot % 2147483648 * 1327217885 % 2147483648 AS point FROM facts)
          JOIN spans ON point >= lo AND point < hi
        ),
        ranks AS (SELECT place, unnest(range(CAST(slots AS BIGINT))) AS rank FROM spans),
        slots AS (
          SELECT r.place, r.rank, coalesce(d.slot, n_slots + r.rank * n + r.place) AS slot
          FROM ranks r LEFT JOIN drawn d ON d.place = r.place AND d.rank = r.rank, facts
        ),
        laid AS (
          SELECT doc_id, size, target, source_size, rid, place, epoch, epoch * source_size + coalesce(sum(size) OVER (
                   PARTITION BY x.source, epoch ORDER BY md5(concat_ws('#', '11', epoch, doc_id, digest)), rid
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word
          FROM (SELECT *, row_number() OVER () AS rid FROM d) x JOIN lines t ON t.source IS NOT DISTINCT FROM x.source, (VALUES (0), (1)) AS e(epoch)
        ),
        sums AS (
          SELECT rid, doc_id, size, source_size, target, place,
                 sum(greatest(least(first_word + size, floor(target)) - first_word, 0)) AS taken, min(first_word) AS first_word
          FROM laid GROUP BY ALL
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken, slot AS first_slot
        FROM sums LEFT JOIN (FROM slots, facts) s ON s.place = sums.place AND s.rank = first_word // block AND taken > 0
    """,
    "op9_block_naming": """
        WITH d AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)
    """,
    "op11_threshold_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 [floor(256 * x::DOUBLE) FOR x IN embedding] AS x
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        s AS (
          SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
                 CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
          FROM v a JOIN v r ON r.vec_id <> a.vec_id AND a.vec_id % 50 = 0
        ),
        p AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id,
               positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY rank <= 3
    """,
    "op12_fill_in_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                 regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
          FROM documents
        ),
        h AS (SELECT *, len(units) AS n, [('0x' || substr(digest, i, 8))::BIGINT FOR i IN [1, 9, 17, 25]] AS h FROM d),
        c AS (
          SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 50
                      THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
          FROM h
        ),
        parts AS (
          SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                 array_to_string(units[b + 1:], '') AS suffix
          FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM parts
    """,
}
