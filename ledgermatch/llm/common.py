"""Helpers shared by the text operators: whole-text scans, scratch tables, splits."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: ASCII white space, the only separator of words in all operators.
WORD_SPACE = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgermatch-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table is computed once, lineage ends at its files, and a lost executor
    costs a re-read instead of a re-run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once a session."""
    sc, name = spark.sparkContext, "ledgermatch-modules.zip"
    if name in sc._python_includes:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgermatch-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package's modules at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(id_col.cast("string")) % parts


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest keyed hash: stable under any partitioning."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    return df.orderBy(order, F.col(key)).limit(rows)


def with_text_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    fn: Callable[[list], list],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fields``, computed by ``fn`` from batches of whole texts.

    ``fn`` gets a list of texts (None for NULL) and returns one list or numpy
    array per field.  ``keep`` names the input columns to carry (default: all).
    Input columns named like a field are replaced by it.
    """
    new = [f.name for f in fields]
    carried = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in carried] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            results = fn(batch.column(text_col).to_pylist())
            arrays = [batch.column(c) for c in carried]
            arrays += [pa.array(r, type=arrow.field(n).type) for n, r in zip(new, results, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *new])

    wanted = list(dict.fromkeys([*carried, text_col]))
    return map_arrow(df.select(*wanted), run, schema)


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists from consecutive stretches of about ``size`` bytes."""
    pos, end = 0, len(data)
    while pos < end:
        stop = pos + size
        if stop < end:
            space = _SPACE.search(data, stop)
            stop = space.start() if space else end
        yield data[pos:stop].split()
        pos = stop


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def row_key(id_col: str) -> Column:
    """The id as text that is never NULL, so that joins and windows on it share one shuffle."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with its columns renamed c0, c1, ... and (_key, _hash) of id and text beside them."""
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*plain, row_key(id_col).alias("_key"), text_hash(text_col).alias("_hash"))


def first_copies(rows: DataFrame) -> DataFrame:
    """One of each repeated (_key, _hash)."""
    by_row = Window.partitionBy("_key", "_hash").orderBy("_hash")
    return rows.withColumn("_copy", F.row_number().over(by_row)).filter("_copy = 1").drop("_copy")


def semi_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are in ``wanted`` (doc_id, text_hash).

    A row that repeats the id and the text comes once.  The wide rows are
    shuffled once, by id and hash, for the join and the numbering alike.
    """
    keys = wanted.select(row_key("doc_id").alias("_key"), F.col("text_hash").alias("_hash"))
    hit = keyed_rows(docs, id_col, text_col).join(keys, ["_key", "_hash"], "left_semi")
    return first_copies(hit).drop("_key", "_hash").toDF(*docs.columns)
