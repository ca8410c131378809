"""From raw documents to token ids: the operators of ``ledgermatch.llm`` in a row.

Each stage takes what its predecessor kept (the columns of ``documents``),
applies one operator to all of it, and returns the rows that its decisions
leave; the last returns token ids.  ``run`` writes every stage as Parquet to
the shared scratch folder and reads it back, so that a later loss of executors
costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import bpe, exact_dedup, mixing, quality_gbt, simhash
from ledgermatch.llm.common import materialize, read_table

#: Documents below this probability of good quality are rejected.
MIN_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds to be good stay; it is fitted on the labelled ones among them."""
    model = quality_gbt.train_quality(docs, read_table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = quality_gbt.score_quality(docs.toDF(*names), model, names[docs.columns.index("text")])
    return scored.filter(F.col("score") >= MIN_QUALITY).select(*names).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest id."""
    return simhash.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: left out, once or twice, by their source's target."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the bytes that they decode to."""
    import public_tokenizers

    docs = docs.select("doc_id", "lang", "source", "text")
    ids = bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        keep=["doc_id", "lang", "source"],
    )
    return ids.select(
        "doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mix", mix),
    ("byte-level bpe", encode),
]

#: The classifier and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
