"""WARC archives in Zstandard: writer, reader and validation.

An archive is one file.  It starts with a skippable frame that holds the
dictionary (magic 0x184D2A5D); every record follows as a Zstandard frame of its
own, compressed with that dictionary.  Spark's text writer stores the frames as
rows, byte for byte, through the commit protocol of any Hadoop file system, so
retries and lost executors leave no half archive; its line separator is an
empty skippable frame, which every Zstandard reader passes over.

The reader takes the files as Spark lists them, loads the dictionary from the
leading frame, decodes one record per frame and validates version line,
headers, lengths and digests.  An archive is as large as one partition of the
writer (a split of the input or of a shuffle), which bounds both sides.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, scratch_path

#: Payloads below this many bytes are stored again instead of referring to an equal one.
MIN_REVISIT_BYTES = 100
#: The dictionary is trained on the first payloads of an archive up to this many bytes, and holds at most so many.
SAMPLE_BYTES, DICT_BYTES = 1 << 19, 1 << 14
LEVEL = 3

# Fixed values of the formats.
ZSTD_MAGIC = 0xFD2FB528
DICT_FRAME_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame, as text: the row separator of an archive.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


# -- records ----------------------------------------------------------------


def _header_text(value: str) -> str:
    """A header value on one line: control characters and % as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def build_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, when: str) -> bytes:
    """One record: a response with the payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", when),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if uri is not None:
        headers.append(("WARC-Target-URI", _header_text(uri)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    headers.append(("Content-Length", str(len(block))))
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8")
    return lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ValueError where a header or a length is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"version line {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        key = name.strip().lower()
        if not colon or not key:
            raise ValueError(f"header line {line[:40]!r}")
        if key in headers:
            raise ValueError(f"repeated header {key}")
        headers[key] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(key):
            raise ValueError(f"no {key}")
    if not headers["content-length"].isdigit():
        raise ValueError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, header says {size}")
    block = rest[:size]
    _check_digest("block", headers.get("warc-block-digest"), block)
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    declared = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not declared.isdigit():
        raise ValueError("no HTTP content-length")
    kind = headers["warc-type"]
    if kind == "response":
        if int(declared) != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, HTTP header says {int(declared)}")
        _check_digest("payload", headers.get("warc-payload-digest"), payload)
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise ValueError("revisit with a payload or without a record that it refers to")
    else:
        raise ValueError(f"unknown type {kind}")
    return {
        "record_id": headers["warc-record-id"].strip("<>"),
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers["warc-refers-to"].strip("<>") if kind == "revisit" else None,
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:"),
        "payload_bytes": int(declared),
        "payload": payload if kind == "response" else None,
        "error": None,
    }


def _check_digest(what: str, stated: str | None, data: bytes) -> None:
    if stated and stated.startswith("sha256:") and stated[7:] != hashlib.sha256(data).hexdigest():
        raise ValueError(f"{what} digest differs")


# -- frames -----------------------------------------------------------------


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the samples: trained, or their own bytes where they are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 4096:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, total // 8), samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICT_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; its content is itself a Zstandard frame, as the format allows."""
    import zstandard

    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_FRAME_MAGIC, len(packed)) + packed


def _load(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def read_frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) per frame of an archive that starts with its dictionary.

    A frame that does not decode yields an error; as its end is then unknown,
    reading goes on at the next place where a frame can start and decode.
    """
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICT_FRAME_MAGIC:
            body = data[8 : 8 + size]
            if len(body) != size:
                yield 0, None, "dictionary frame is cut"
                return
            if body[:4] == struct.pack("<I", ZSTD_MAGIC):
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            dictionary, at = _load(body), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    start = struct.pack("<I", ZSTD_MAGIC)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8:
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                at += 8 + size
                continue
        frame = reader.decompressobj()
        try:
            # In steps, so that what follows the frame is not copied for each record.
            parts, pos = [], at
            while not frame.eof and pos < len(data):
                parts.append(frame.decompress(view[pos : pos + (1 << 14)]))
                pos += 1 << 14
            if not frame.eof:
                raise zstandard.ZstdError("frame is cut")
        except zstandard.ZstdError as e:
            yield at, None, str(e)
            at = data.find(start, at + 1)
            if at < 0:
                return
            continue
        yield at, b"".join(parts), None
        at = min(pos, len(data)) - len(frame.unused_data)


# -- Spark ------------------------------------------------------------------


def write_archives(records: DataFrame, path: str, when: datetime | None = None) -> None:
    """Write ``records`` (record_id, uri, payload, digest, refers_to) as one archive per partition under ``path``."""
    date = (when or datetime(2024, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield {c: b.column(c)[i].as_py() for c in ("record_id", "uri", "payload", "digest", "refers_to")}

        def record(r):
            return build_record(r["record_id"], r["uri"], r["payload"] or b"", r["digest"], r["refers_to"], date)

        source, first, sampled = rows(), [], 0
        for r in source:
            first.append(r)
            sampled += len(r["payload"] or b"")
            if sampled >= SAMPLE_BYTES:
                break
        if not first:
            return
        dictionary = train_dictionary([r["payload"] or b"" for r in first])
        known = _load(dictionary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
        frames, size = [dictionary_frame(dictionary)], 0
        for part in (first, source):
            for r in part:
                frames.append(packer.compress(record(r)))
                size += len(frames[-1])
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
                    frames, size = [], 0
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = map_arrow(records.select("record_id", "uri", "payload", "digest", "refers_to"), run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path`` as RECORD rows.

    A record that fails a check comes as a row with ``error`` and what could
    be told of it; no record is passed over in silence.  An empty file has no
    records.  Without ``with_payload`` payloads are checked and left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORD.names
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for at, record, error in read_frames(data.as_py()):
                    row = dict.fromkeys(names) | {"archive": f"{name}@{at}", "error": error}
                    if error is None:
                        try:
                            row |= parse_record(record)
                        except (ValueError, UnicodeDecodeError) as e:
                            row["error"] = str(e)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size >= 1 << 22:
                        yield _rows_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows_batch(rows)

    return map_arrow(files, run, RECORD)


def _rows_batch(rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(RECORD))


def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records for ``write_archives``: of equal payloads of MIN_REVISIT_BYTES or more, the smallest id keeps the payload.

    NULL html is an empty payload.  Rows that repeat the smallest id all keep
    it; a NULL id refers to the smallest id of its group, if there is one.
    """
    pages = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    heads = pages.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("head"), F.count("*").alias("copies")
    )
    heads = materialize(heads.filter("copies > 1 AND head IS NOT NULL").select("digest", "head"), "warc-heads")
    joined = pages.join(heads, "digest", "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), "uri", "payload", "digest",
        F.when(revisit, urn(F.col("head"))).alias("refers_to"),
    )


def page_id_of(urn):
    """The page id inside a record id; NULL for ``none``."""
    tail = F.regexp_extract(urn, r"^urn:page:(.*)$", 1)
    return F.when(tail != "none", tail)


def archive_pages(pages: DataFrame, path: str | None = None, with_payload: bool = False, **columns) -> DataFrame:
    """Write the pages as archives (to a fresh shared folder unless ``path`` is given) and read all records back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(page_records(pages, **columns), path)
    return read_archives(pages.sparkSession, path, with_payload)
