"""Exact duplicates by deterministic block naming.

White space is normalised, the UTF-8 bytes are cut into fixed-size blocks, the
distinct blocks of the whole corpus are dealt out, sorted and given integer
names in that order.  Then adjacent names of a document are paired, the distinct pairs are
sorted and named, and so on until every document has one name.  Two documents
have the same number of blocks and the same final name exactly if their
normalised texts are equal: names stand for contents, not for hashes of them.

Contents are shuffled to be sorted, never to be looked up: an occurrence finds
its block's name by a 64-bit hash, and the sorted name table is first checked
for hashes that stand for more than one block.  Where there are any, the
occurrences of those look up by hash and content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, materialize, semi_rows, text_hash

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SPACE, " ")


def _blocks(docs: DataFrame, text_col: str, size: int, digest: Callable[[Column], Column], carry: list[Column]) -> DataFrame:
    """Rows (carry..., n, pos, block, h), one per block; an empty text has one empty block."""
    body = docs.select(*carry, normalised(F.col(text_col)).cast("binary").alias("body"))
    body = body.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(size))).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.struct(i.alias("pos"), F.substring(F.col("body"), i * size + 1, F.lit(size)).alias("block")),
    )
    kept = [c for c in body.columns if c != "body"]
    return body.select(*kept, F.inline(cut)).withColumn("h", digest(F.col("block")))


def _sorted_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., name): an integer for each distinct key, in sorted order within each partition.

    Repeats are combined before the shuffle.  The partition number leads the
    name, so names need no sort across partitions, whose sampled bounds would
    bring whole blocks to the driver.
    """
    distinct = rows.select(*keys).distinct().sortWithinPartitions(*keys)
    return distinct.withColumn("name", F.monotonically_increasing_id())


def block_identity(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document row: (rid, doc_id, text_hash, text_sha256, n_blocks, name)."""
    plain = _blocks(docs, text_col, block_bytes, digest, [])
    named = materialize(_sorted_names(plain, ["h", "block"]).select("h", "name"), "block-names")
    shared = materialize(named.groupBy("h").count().filter("count > 1").select("h"), "block-shared-hashes")

    carry = [
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        text_hash(text_col).alias("text_hash"),
        F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
    ]
    found = _blocks(docs, text_col, block_bytes, digest, carry)
    if shared.isEmpty():
        found = found.withColumn("name", F.lit(None).cast("long"))
    else:
        own = _sorted_names(plain.join(shared, "h", "left_semi"), ["h", "block"])
        own = materialize(own.withColumn("name", -1 - F.col("name")), "block-shared-names")
        found = found.join(own, ["h", "block"], "left")
        named = named.join(shared, "h", "left_anti")
    found = materialize(found.select("rid", "doc_id", "text_hash", "text_sha256", "n", "pos", "h", "name"), "block-occurrences")
    deepest = found.agg(F.max("n")).first()[0] or 1

    rows = found.join(named.toDF("h", "by_hash"), "h", "left").withColumn("name", F.coalesce("name", "by_hash"))
    out = rows.filter("n = 1").select("rid", "n", "name")
    rows = rows.filter("n > 1").select("rid", "pos", "n", F.col("n").alias("left_over"), "name")
    while deepest > 1:
        pairs = materialize(
            rows.groupBy("rid", "n", "left_over", F.expr("pos div 2").cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("one"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("two"),
            ),
            "block-pairs",
        )
        names = materialize(_sorted_names(pairs, ["one", "two"]), "pair-names")
        met = (pairs["one"] == names["one"]) & pairs["two"].eqNullSafe(names["two"])
        rows = pairs.join(names, met).select(
            "rid", "pos", "n", F.ceil(F.col("left_over") / 2).cast("int").alias("left_over"), "name"
        )
        out = out.unionByName(rows.filter("left_over = 1").select("rid", "n", "name"))
        rows = rows.filter("left_over > 1")
        deepest = -(-deepest // 2)
    firsts = found.filter("pos = 0").select("rid", "doc_id", "text_hash", "text_sha256")
    return firsts.join(out, "rid").select("rid", "doc_id", "text_hash", "text_sha256", F.col("n").alias("n_blocks"), "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document row: (doc_id, keep_id, group_size, kept, text_sha256, text_hash).

    NULL text counts as empty.  The row with the smallest id stays; of rows
    that repeat an id with an equal text one stays; a NULL id stays only where
    no equal text has an id.  Only the id and text columns are read, so other
    columns cannot clash.  No rows give no rows.
    """
    rows = materialize(block_identity(docs, id_col, text_col, **options), "block-identities")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "rid")
    groups = rows.groupBy("n_blocks", "name").agg(F.min(order).alias("head"), F.count("*").alias("group_size"))
    # A table of its own: the join then reads plain shuffles, and Spark splits a hot group's rows.
    groups = materialize(groups, "block-groups")
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("head.rid")).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = exact_duplicates(docs, id_col, text_col, **options).filter("kept")
    return semi_rows(docs, rows.select("doc_id", "text_hash"), id_col, text_col)
