import collections
import gzip
import hashlib
import io

import pytest

from seqloom.llm import warc
from seqloom.session import durable_path

LONG = "<p>" + "ü and more " * 200
ROWS = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (2, "http://a/2", LONG), (3, None, "short"), (4, "http://a/4", "short"), (5, "u\r\nX: y", None),
        (6, "http://a/6", ""), (None, "http://a/7", LONG), (8, "http://a/8", "x" * 1000), (9, "http://a/9", "x" * 1000), (10, "u", "y" * 999), (11, "u", "y" * 999)]


def expected():
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == body and p is not None]
        head = max(same, default=None) if len(body) >= 1000 else None
        again = head is not None and page != head
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", head if again else None))
    return collections.Counter(out)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op3_warc(spark, str(tmp_path)).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected()


def test_payloads_and_file_rotation(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i * 37)) for i in range(40)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.deduplicated(pages), durable_path(spark, "warc"), file_bytes=500)
    assert manifest.count() > 10
    got = {int(r.record_id): r.payload.decode() for r in warc.read_archives(manifest).collect()}
    assert got == {i: f"page {i} " * (i * 37) for i in range(40)}


def record(page, body):
    return warc.page_record(page, "http://h/", body, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 18])
def test_reader_by_blocks_of_any_size(block):
    bodies = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n" * 50, bytes(range(256)) * 300]
    data = b"".join(record(str(i), b) for i, b in enumerate(bodies))
    assert data[:2] == b"\x1f\x8b" and gzip.decompress(data).count(b"WARC-Type") == 4
    read = [warc.parse_record(f, b) for f, b in warc.RecordReader(io.BytesIO(data), block)]
    assert [r[-1] for r in read] == bodies


def test_damage_is_an_error():
    good = record("1", b"some text " * 50)
    plain = gzip.decompress(good)
    for bad in (good[:-20], gzip.compress(plain.replace(b"some", b"same", 1)), gzip.compress(plain[:-10]), gzip.compress(plain[5:])):
        with pytest.raises(ValueError):
            list(warc.RecordReader(io.BytesIO(bad)))
