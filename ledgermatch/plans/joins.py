"""Join helpers: broadcast only behind a measured size, materialise reused results."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, max_rows: int, max_bytes: int | None) -> bool:
        return self.rows <= max_rows and (max_bytes is None or self.bytes <= max_bytes)


def text_bytes(df: DataFrame):
    """Sum of the UTF-8 bytes of all text columns, as an aggregate."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
    return F.coalesce(F.sum(total), F.lit(0))


def measure(df: DataFrame) -> Size:
    """Rows and bytes (text as it is, sixteen bytes for any other value and the row), in one aggregate."""
    rows, text = df.agg(F.count(F.lit(1)), text_bytes(df)).first()
    return Size(rows, text + 16 * rows * (1 + len(df.columns)))


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast only if its measured size is within the bounds.

    Above them the join stays a shuffled join (AQE splits hot keys), with the
    same result, so nothing unbounded is ever shipped to every executor.
    """
    if measure(df).fits(max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgermatch-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a reused relation to the shared folder and read it back.

    Computed once; lineage ends at the files, so a lost executor costs a
    re-read, and nothing stays in the executors' memory after the run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
