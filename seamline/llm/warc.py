"""WARC archives: writer with revisit records, and a sequential reader (operator 6).

Writer: one gzip member per record, payload wrapped as an HTTP response. Of
records with equal payloads of `least` bytes or more, that with the smallest id
is the response; the others are revisits that carry the HTTP head with the full
length and refer to it. Each task writes archives of bounded size into a folder
that all executors share, under a temporary name that is renamed when complete,
so a task that runs again or is lost leaves no half archive; the manifest of
the tasks that succeeded says which archives count.

Reader: each archive is read front to back in blocks; every gzip member is
decompressed step by step, its header lines give the record's length, and block
and payload digests are verified. A damaged record raises ValueError.

Null pages have an empty payload; a very long page is held once, in its task. Ids
may be any text: they are percent-encoded in the header. Ids must be unique to be
referred to (rows with equal ids and payloads are all the response); a null id
sorts first. Extra columns are ignored, whatever their names; an empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import salted_join, shared_folder, table, written

LEAST = 100
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def filesystem(uri: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record_id(page: str | None) -> str:
    name = "no page" if page is None else f"page:{page}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page: str | None, url: str | None, kind: str, refers: str | None, payload: bytes, size: int, digest: str) -> bytes:
    """One record as a gzip member; the digest is the payload's hex SHA-256."""
    block = HEAD.format(size).encode() + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {(url or '').encode('ascii', 'backslashreplace').decode().translate({10: None, 13: None})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    # ids are percent-encoded, so any text stays one line and as it is; a null id has no line
    if page is not None:
        lines.append(f"X-Page-ID: {quote(page, safe='')}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}"]
        if refers is not None:
            lines.append(f"X-Refers-To-Page-ID: {quote(refers, safe='')}")
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def members(source, block: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after another."""
    inflate, out, rest = zlib.decompressobj(31), io.BytesIO(), b""
    fed = False
    while data := rest or source.read(block):
        fed = True
        out.write(inflate.decompress(data))
        rest = inflate.unused_data
        if inflate.eof:
            yield out.getvalue()
            inflate, out, fed = zlib.decompressobj(31), io.BytesIO(), False
    if fed:
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block, framed by Content-Length."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: length does not fit")
    block = rest[:n]
    if (d := fields.get("warc-block-digest")) and d != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"record {fields.get('warc-record-id')}: block digest differs")
    return fields, block


def read_records(source) -> Iterator[tuple[dict[str, str], int, str, bytes | None]]:
    """Fields, full payload size, payload digest (hex) and payload (None for a revisit)."""
    for raw in members(source):
        fields, block = parse(raw)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in head.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "revisit":
            yield fields, size, digest, None
            continue
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields.get('warc-record-id')}: payload digest differs")
        yield fields, size, digest, payload


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives and returns their manifest: path, records."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # payloads that occur once need no look-up: only repeated digests go into the join
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("first")).where("n > 1")
    repeated = written(repeated.select("digest", F.col("first.page_id").alias("first")), "repeated-payloads")
    # the same payload may be a third of all pages: no task gets all of a digest
    marked = written(salted_join(rows.where(F.col("size") >= least).select("page_id", "digest"), repeated, ["digest"]).distinct(), "revisits")
    rows = rows.join(marked.withColumnRenamed("digest", "same").withColumnRenamed("page_id", "page"), (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("page")), "left")
    revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first").cast("string")).alias("refers"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        name = sink = None
        n = size = 0

        def close() -> pa.RecordBatch:
            sink.close()
            files.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "records"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{root}/.{name}", compression=None)
                data = record(*r)
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return written(rows.mapInArrow(run, "path string, records long"), "manifest")


def named(fields: dict[str, str], key: str) -> str | None:
    return unquote(fields[key]) if key in fields else None


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id (string), payload_bytes, payload_digest, record_type, refers_to
    (string) and, if asked for, payload, of all records of the archives in the
    manifest's column path. One archive is one row; there are as many partitions as
    archives (a number that adaptive execution does not change)."""
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = filesystem(path)
                rows = []
                with files.open_input_stream(at, compression=None) as source:
                    for fields, size, digest, payload in read_records(source):
                        rows.append((named(fields, "x-page-id"), size, digest, fields["warc-type"], named(fields, "x-refers-to-page-id")) + (payload,) * payloads)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    folder = f"{shared_folder(pages.sparkSession)}/seamline-warc-{uuid.uuid4().hex}"
    kind = pages.schema[options.get("id_column", "page_id")].dataType
    out = read_archives(write_archives(pages, folder, **options))
    return out.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
}
