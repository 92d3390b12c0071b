"""WARC archives: one gzip member per record, read back in sequence.

The writer turns pages into response records, or into revisit records when a page with an equal payload of at least
`min_bytes` and a larger id exists. Every task writes files of its own name and reports them in a manifest, so files of
failed attempts are never read. The reader streams a file in blocks through an incremental decompressor, frames records by
Content-Length and checks block and payload digests.

Defined results. Null or empty page text: an empty payload. Null id: such a page is a response unless an equal page has an
id. Pages that repeat the largest id of their group are all responses. Null url: a record without target. Empty table: no
files, empty result. A file that ends inside a record, or fails a digest, is an error. Other columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.session import durable_path, materialize

MIN_BYTES, BLOCK_BYTES, FILE_BYTES = 1000, 1 << 18, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to string"


def base32_sha1(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def page_record(page: str, url: str | None, body: bytes, digest_hex: str, revisit_of: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the response's header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit_of is not None else http + body
    fields = [("WARC-Type", "response" if revisit_of is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"),
              ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c not in "\r\n" else "%0" + "AD"[c == "\r"] for c in url)))
    if revisit_of is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{revisit_of}>")]
    fields += [("WARC-Payload-Digest", base32_sha1(digest_hex)), ("WARC-Block-Digest", base32_sha1(hashlib.sha1(block).hexdigest())),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with payload, digest and, for revisits, the id of the page they revisit."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    # only payloads seen more than once take part in the join, so mostly it is small enough for Spark to broadcast
    heads = materialize(rows.where(F.octet_length("body") >= min_bytes).groupBy("digest")
                        .agg(F.max("page").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payload-heads")
    revisit = F.when(F.col("head").isNotNull() & ~F.col("page").eqNullSafe(F.col("head")), F.col("head").cast("string"))
    return rows.join(heads, "digest", "left").select(F.col("page").cast("string").alias("page"), "url", "body", "digest",
                                                     revisit.alias("revisit_of"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives into `folder`, which all executors share; returns the manifest (file, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            columns = [W.arrow_column(batch, c) for c in ("page", "url", "body", "digest", "revisit_of")]
            for i in range(batch.num_rows):
                page, url, body, digest, revisit_of = (c[i].as_py() for c in columns)
                if out is None:
                    name, count, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = page_record("" if page is None else page, url, body, digest, revisit_of, date)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out, _ = None, done.append((name, count, size))
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done], pa.int64()),
                                              pa.array([d[2] for d in done], pa.int64())], names=["file", "n_records", "n_bytes"])

    # the manifest is written once, so it names exactly the files of the attempts that counted
    return materialize(records.mapInArrow(write, "file string, n_records bigint, n_bytes bigint"), "manifest")


class RecordReader:
    """Records of one archive from a stream of compressed blocks, holding one record at a time."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        self.stream, self.block_bytes = stream, block_bytes
        self.packed, self.plain, self.member = b"", bytearray(), None

    def _more(self) -> bool:
        """Decompress one more block; False at the end of the file."""
        if not self.packed:
            self.packed = self.stream.read(self.block_bytes)
            if not self.packed:
                if self.member is not None:
                    raise ValueError("archive ends inside a gzip member")
                return False
        if self.member is None:
            self.member = zlib.decompressobj(wbits=31)
        self.plain += self.member.decompress(self.packed, 4 * self.block_bytes)
        self.packed = self.member.unconsumed_tail
        if self.member.eof:
            self.packed, self.member = self.member.unused_data, None
        return True

    def _until(self, mark: bytes) -> bytes | None:
        """Bytes up to `mark`, or None at the end of the file."""
        looked = 0
        while (at := self.plain.find(mark, looked)) < 0:
            looked = max(0, len(self.plain) - len(mark) + 1)
            if not self._more():
                if self.plain:
                    raise ValueError("archive ends inside a record header")
                return None
        out = bytes(self.plain[:at])
        del self.plain[:at + len(mark)]
        return out

    def _exactly(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("archive ends inside a record block")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while (head := self._until(b"\r\n\r\n")) is not None:
            version, *lines = head.decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a record: {version[:40]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            block = self._exactly(int(fields["content-length"]))
            if self._exactly(4) != b"\r\n\r\n":
                raise ValueError("record does not end where its length says")
            if "warc-block-digest" in fields and fields["warc-block-digest"] != base32_sha1(hashlib.sha1(block).hexdigest()):
                raise ValueError(f"block digest differs: {fields.get('warc-record-id')}")
            yield fields, block


def parse_record(fields: dict[str, str], block: bytes) -> tuple:
    """(id, type, target, payload length, payload digest, refers to, payload); the payload of a revisit is not stored."""
    head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = len(payload)
    if fields["warc-type"] == "revisit":
        http = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:])
        length, payload = int(http[b"content-length"]), None
    elif digest != hashlib.sha1(payload).hexdigest():
        raise ValueError(f"payload digest differs: {fields['warc-record-id']}")

    def name(key):
        return fields[key].removeprefix("<urn:page:").removesuffix(">") if key in fields else None

    return name("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), length, digest, name("warc-refers-to"), payload


def read_archives(manifest: DataFrame, with_payload: bool = True, batch_rows: int = 256) -> DataFrame:
    """Records of the archives named in the column `file`, each read in sequence by one task."""
    columns = RECORD + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()][:len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file in W.arrow_column(batch, "file").to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, block in RecordReader(stream):
                        rows.append(parse_record(fields, block)[:len(names)])
                        held += len(block) if with_payload else 0
                        if len(rows) == batch_rows or held > 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    n_files = manifest.count()
    return manifest.select("file").repartition(max(1, n_files)).mapInArrow(read, columns)


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(deduplicated(pages), durable_path(spark, "warc"))
    records = read_archives(manifest, with_payload=False)

    def number(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).cast("bigint")

    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          number("refers_to").alias("refers_to"), "target_uri")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM q)
SELECT page_id, payload_bytes, payload_digest, url AS target_uri,
       CASE WHEN payload_bytes >= 1000 AND head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM head THEN head END AS refers_to FROM r"""}
