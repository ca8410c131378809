import gzip
import hashlib
import struct

import pytest
import zstandard

from ledgermatch.llm import warc

PAGES = [
    (1, "http://a/1", "x" * 150),
    (2, "http://a/2", "x" * 150),
    (3, "http://a/3\r\nWARC-Type: evil", "short"),
    (4, None, "short"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/%7", "é" * 60 + "\r\n\r\nWARC/1.1"),
    (8, "http://a/8", "é" * 60 + "\r\n\r\nWARC/1.1"),
    (0, "http://a/0", "x" * 150),
    (None, "http://a/n", "x" * 150),
    (9, "http://a/9", "long page " * 300_000),
    (9, "http://a/9", "long page " * 300_000),
    (10, "http://a/10", "y" * 99),
    (11, "http://a/11", "y" * 99),
    (12, "P*M\x18\0\0\0\0", "P*M\x18\0\0\0\0" * 30),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, digest string, head string")


def expected():
    heads = {}
    for i, _, html in PAGES:
        if i is not None:
            heads[html or ""] = min(i, heads.get(html or "", i))
    out = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        head = heads.get(html or "")
        again = len(body) >= 100 and head is not None and i != head and sum((p[2] or "") == (html or "") for p in PAGES) > 1
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, pages, tmp_path, parts):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.page_records(pages).repartition(parts), path)
    rows = warc.read_archives(spark, path).collect()
    assert [r.error for r in rows] == [None] * len(PAGES)
    number = lambda urn: None if urn in (None, "urn:page:none") else int(urn[9:])
    got = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows]
    assert sorted(got, key=str) == expected()
    bodies = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert all(bytes(r.payload) == bodies[number(r.record_id)] for r in rows if r.record_type == "response")
    assert {r.target_uri for r in rows if number(r.record_id) == 3} == {"http://a/3%0D%0AWARC-Type: evil"}


def test_files_are_plain_zstandard(spark, pages, tmp_path):
    path = tmp_path / "warc"
    warc.write_archives(warc.page_records(pages).coalesce(1), str(path))
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICT_FRAME_MAGIC
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20)
    known = zstandard.ZstdCompressionDict(dictionary)
    whole = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"\r\nWARC-Record-ID: ") == len(PAGES)


def test_query(spark, spark_sf):
    from ledgermatch.llm.queries import op2_warc_zstd

    rows = op2_warc_zstd(spark, spark_sf).collect()
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{spark_sf}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.payload_digest == hashlib.sha256(pages[r.page_id].encode()).hexdigest() and r.error is None for r in rows)


def test_no_pages(spark, pages):
    assert warc.archive_pages(pages.limit(0)).count() == 0


def _archive(*records, dictionary=b"common words " * 20):
    known = zstandard.ZstdCompressionDict(dictionary)
    packer = zstandard.ZstdCompressor(dict_data=known)
    return warc.dictionary_frame(dictionary) + b"".join(packer.compress(r) for r in records)


def _record(payload=b"<p>common words</p>", **change):
    r = warc.build_record("urn:page:1", "http://a", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")
    for old, new in change.values():
        assert old in r
        r = r.replace(old, new)
    return r


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"WARC/9.9"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"WARC-Date", b"X-Date"),
        (b"common", b"COMMON"), (b"\r\n\r\n", b"\r\n"), (b"WARC-Type: response", b"WARC-Type: other"),
        (b"WARC-Date: ", b"WARC-Type: "), (b"WARC-Date: ", b"WARC-Date "), (b"Content-Length: 19", b"Content-Length: 18"),
    ],
)
def test_bad_records_are_told(change):
    assert warc.parse_record(_record())["error"] is None
    with pytest.raises(ValueError):
        warc.parse_record(_record(c=change))


def test_broken_frames_do_not_hide_others():
    good = _record()
    data = _archive(good, good, good)
    (a, one, _), (b, _, _), (c, _, _) = list(warc.read_frames(data))
    assert one == good and a < b < c
    broken = data[: b + 6] + b"\xff" * 12 + data[b + 18 :]
    frames = list(warc.read_frames(broken))
    assert [f[1] for f in frames if f[2] is None] == [good, good] and any(f[2] for f in frames)
    cut = list(warc.read_frames(data[:-5]))
    assert [f[2] is None for f in cut] == [True, True, False]
    assert list(warc.read_frames(b"")) == []
    assert list(warc.read_frames(data[:20]))[0][2]
    assert all(f[2] for f in warc.read_frames(gzip.compress(good)))
