"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots of equally many words.  Slot t draws its source
by the golden-ratio point frac(t * phi), looked up in the cumulative weights of
the sources, so that every stretch of the mix is close to the target weights.
The slots of a source are ranked, and rank k takes the source's k-th block:
its documents, shuffled by hash, laid end to end and cut into blocks of equally
many words; a second epoch goes on with another shuffle.  A source's blocks end
exactly at its target; the few ranks that the points leave out are appended.

All running sums are two-level: a window inside hash buckets of bounded size,
and one over the bucket totals, so a source with a third of all documents is
spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_copies, keyed_rows, materialize, row_key, text_hash

#: Words that the mix takes, as a share of all words, and times that it may take one document.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Weights of the sources in code-point order, NULL last, repeating.
WEIGHTS = (3, 1, 2)
#: Rows per bucket of a running sum, about.
BUCKET_ROWS = 8192
#: Words per block lie between these, so that an average source has about SLOTS_PER_SOURCE slots.
BLOCK_WORDS = (16, 4096)
SLOTS_PER_SOURCE = 2000
#: The golden ratio's fraction in 31 bits (odd): t times it, modulo 2^31, visits every point once.
GOLDEN, POINTS = 1327217885, 1 << 31


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; NULL has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target), one row per source, of ``sizes`` (source, size).

    The mix is shared by weight; no target passes MAX_EPOCHS times its source,
    and what is over goes to the others by weight until none is above.  In the
    order of cap per weight the capped sources come first, so the common level
    follows from running sums.  One row per source goes through one window; no
    document does.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((place - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight)
    per = per.withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE))
        .withColumn("capped_words", F.coalesce(F.sum(F.col("source_size") * MAX_EPOCHS).over(before), F.lit(0)))
        .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped_words")) / (F.sum("weight").over(everything) - F.col("capped_weight")))
        .withColumn("free", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything))
    )
    level = F.col("free.level")
    target = F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(
        F.when(F.struct("ratio", "place") < F.struct("free.ratio", "free.place"), F.col("cap")).otherwise(level * F.col("weight"))
    )
    return per.select("source", "source_size", "place", "weight", F.least(target, F.col("cap")).alias("target"))


@dataclass
class Mix:
    """``documents``: (rid, doc_id, text_hash, digest, source, size); ``targets``: see source_targets;
    ``schedule``: (slot, place, rank); ``pieces``: (rid, place, epoch, rank, offset, start, words), ``offset`` counting from the block's, ``start`` from the document's first word."""

    documents: DataFrame
    targets: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    block_words: int

    def takes(self) -> DataFrame:
        """Slots joined with their blocks' pieces (slot, rid, epoch, offset, start, words)."""
        return self.schedule.join(self.pieces, ["place", "rank"]).select("slot", "rid", "epoch", "offset", "start", "words")


def _running(rows: DataFrame, group: list[str], order: str, value: str, name: str, buckets: int) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows with a smaller ``order`` (hexadecimal digests, ties by rid)."""
    lead = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(lead * buckets / F.lit(1 << 32)))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, "rid").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, [*group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> Mix:
    """Schedule the mix of ``docs``.

    Only the id, text and source columns are read, so other columns cannot
    clash.  NULL and blank texts have no words and are never taken; documents
    without a source form one of their own; repeated rows count and are taken
    as often as they occur.  Without any word the mix is empty.
    """
    documents = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        text_hash(text_col).alias("text_hash"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    documents = materialize(documents, "mix-documents")
    spark = docs.sparkSession
    targets = materialize(source_targets(documents), "mix-targets")
    n_rows = documents.count()
    # Whole words from here on, so that the schedule is the same wherever it is computed.
    facts = targets.agg(F.count("*"), F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()
    n_sources, total = facts[0], int(facts[1])
    block = min(max(total // max(1, n_sources * SLOTS_PER_SOURCE), BLOCK_WORDS[0]), BLOCK_WORDS[1])
    # What a source gives, and its interval of the points.
    lines = targets.withColumn("taken", F.floor("target"))
    ends = F.sum("taken").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)")
    lines = lines.withColumn("hi", F.floor(ends * F.lit(POINTS) / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("long"))
    lines = lines.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("place")), F.lit(0)))
    lines = lines.withColumn("slots", F.expr(f"(taken + {block - 1}) div {block}")).select("place", "source", "source_size", "taken", "slots", "lo", "hi")
    lines = materialize(lines, "mix-lines")

    pieces = _pieces(documents, lines, block, max(1, -(-n_rows // BUCKET_ROWS)), seed)
    return Mix(documents, targets, _schedule(spark, lines, n_sources, total, block), pieces, block)


def _schedule(spark, lines: DataFrame, n_sources: int, total: int, block: int) -> DataFrame:
    """(slot, place, rank): golden-ratio points through the cumulative weights, ranked per source."""
    n_slots = -(-total // block)
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % POINTS * GOLDEN % POINTS).alias("point"))
    # Equi-join on grid cells instead of a range join; a source covers the cells of its interval.
    cells = 4 * max(1, n_sources)
    width = -(-POINTS // cells)
    spread = lines.filter("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}L, (hi - 1) div {width}L)")))
    hit = points.withColumn("cell", F.expr(f"point div {width}L")).join(spread, "cell").filter("point >= lo AND point < hi")
    hit = hit.select("slot", "place", "slots", F.expr(f"slot div {BUCKET_ROWS}L").alias("stretch"))
    inside = Window.partitionBy("place", "stretch").orderBy("slot")
    counts = hit.groupBy("place", "stretch").agg(F.count("*").alias("n"))
    across = Window.partitionBy("place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0))), "mix-stretches")
    ranked = hit.withColumn("within", F.row_number().over(inside) - 1).join(counts, ["place", "stretch"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).filter("rank < slots").select("slot", "place", "rank")
    drawn = counts.groupBy("place").agg(F.sum("n").alias("drawn"))
    rest = lines.join(drawn, "place", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).filter("drawn < slots")
    rest = rest.select("place", F.explode(F.expr("sequence(drawn, slots - 1)")).alias("rank"))
    # Left-out ranks follow the last slot, by rank and then source; there are a few per source.
    rest = rest.select((F.lit(n_slots) + F.col("rank") * n_sources + F.col("place")).alias("slot"), "place", "rank")
    return ranked.unionByName(rest)


def _pieces(documents: DataFrame, lines: DataFrame, block: int, buckets: int, seed: int) -> DataFrame:
    """Cut each source's shuffled line of words into blocks (rid, place, epoch, rank, start, words)."""
    epochs = F.explode(F.expr("sequence(0L, greatest(taken - 1, 0) div source_size)"))
    lined = documents.filter("size > 0").join(lines.filter("taken > 0"), documents["source"].eqNullSafe(lines["source"]))
    lined = lined.select("rid", "doc_id", "digest", "size", "place", "source_size", "taken", epochs.alias("epoch"))
    # By id and text, so that the order is the same wherever the rows come from.
    shuffle = F.md5(F.concat_ws("#", F.lit(seed).cast("string"), F.col("epoch").cast("string"), F.col("doc_id").cast("string"), "digest"))
    lined = lined.withColumn("shuffle", shuffle).drop("doc_id", "digest")
    laid = _running(lined, ["place", "epoch"], "shuffle", "size", "offset", buckets)
    laid = laid.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("offset")).filter("at < taken")
    laid = laid.withColumn("stop", F.least(F.col("at") + F.col("size"), "taken"))
    laid = laid.withColumn("rank", F.explode(F.expr(f"sequence(at div {block}L, (stop - 1) div {block}L)")))
    begin = F.greatest(F.col("at"), F.col("rank") * block)
    end = F.least(F.col("stop"), (F.col("rank") + 1) * block)
    return laid.select(
        "rid", "place", "epoch", "rank", (begin - F.col("rank") * block).alias("offset"), (begin - F.col("at")).alias("start"), (end - begin).alias("words")
    )


def taken_words(mix: Mix) -> DataFrame:
    """(rid, epoch, taken): words that the mix takes of each document in each epoch."""
    return mix.takes().groupBy("rid", "epoch").agg(F.sum("words").alias("taken"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: (doc_id, size, source_size, target, taken, first_slot).

    ``first_slot`` is the place in the mix of the document's first words, NULL where none is taken.
    """
    mix = plan_mix(docs, **options)
    taken = mix.takes().groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = mix.documents.join(taken, "rid", "left")
    rows = rows.join(mix.targets, rows["source"].eqNullSafe(mix.targets["source"]))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, **options) -> DataFrame:
    """The mix itself, in slot order: (slot, offset, source, doc_id, start, words, text).

    A row is what one slot takes of one document, ``text`` being its words from
    number ``start`` (from 0) on with one space between; ``offset`` counts words
    inside the slot.  Partitions are ranges of slots, so the files of a written
    mix, read one after the other, are the mix.  A document's text is shuffled
    once, to all the slots it goes to, and cut where it meets them.
    """
    mix = plan_mix(docs, id_col, text_col, **options)
    own = F.struct("slot", "offset", "start", "words")
    takes = mix.takes().groupBy("rid").agg(F.collect_list(own).alias("_takes"))
    takes = takes.join(mix.documents.select("rid", "doc_id", "text_hash", "source"), "rid")
    takes = takes.select(row_key("doc_id").alias("_key"), F.col("text_hash").alias("_hash"), "doc_id", "source", "_takes")
    texts = first_copies(docs.select(row_key(id_col).alias("_key"), text_hash(text_col).alias("_hash"), F.col(text_col).alias("_text")))
    rows = takes.join(texts, ["_key", "_hash"])
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.select("doc_id", "source", "_takes", words.alias("_words"))
    part = lambda t: F.array_join(F.slice("_words", (t["start"] + 1).cast("int"), t["words"].cast("int")), " ")
    parts = F.transform("_takes", lambda t: F.struct(t["slot"], t["offset"], t["start"], t["words"], part(t).alias("text")))
    rows = rows.select("doc_id", "source", F.inline(parts)).select("slot", "offset", "source", "doc_id", "start", "words", "text")
    ranged = rows.repartitionByRange(partitions, "slot") if partitions else rows.repartitionByRange("slot")
    return ranged.sortWithinPartitions("slot", "offset")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: once per epoch, cut to the words taken where a target ends inside.

    The columns are those of ``docs``; ``size_col`` (if there) is set to the characters of the text.
    Of rows that repeat an id and a text, one is taken as often as they all are.
    """
    mix = plan_mix(docs, id_col, text_col, **options)
    taken = taken_words(mix).join(mix.documents, "rid").withColumn("_key", row_key("doc_id"))
    taken = taken.groupBy("_key", F.col("text_hash").alias("_hash")).agg(
        F.sum("taken").alias("_taken"), F.max("size").alias("_size")
    )
    rows = first_copies(keyed_rows(docs, id_col, text_col).join(taken, ["_key", "_hash"]))
    whole = F.explode(F.expr("sequence(0L, (_taken - 1) div _size)"))
    rows = rows.withColumn("_round", whole).withColumn("_words", F.expr("least(_size, _taken - _round * _size)"))
    body = F.col(f"c{docs.columns.index(text_col)}")
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("_words") < F.col("_size"), F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " "))
    rows = rows.withColumn("_text", F.coalesce(cut, body))
    out = []
    for i, f in enumerate(docs.schema):
        col = F.col("_text") if f.name == text_col else F.col(f"c{i}")
        if f.name == size_col:
            col = F.length("_text").cast(f.dataType)
        out.append(col.alias(f.name))
    return rows.select(*out)
