"""WARC archives with an index that comes first.

Writing gives one index row per record: file, offset, length, URL, payload
digest and type. Reading takes index rows, sorts them by file and offset,
coalesces near neighbours into byte-range reads of bounded size, and parses the
records out of those ranges; whole archives are never loaded.

Each record is its own gzip member, as the format advises, so a byte range is
readable alone. Of records with equal payloads of at least ``least_bytes``
bytes, that with the largest page id is a response and the others are revisits
that refer to it. Tasks write to files of unique names in the shared folder;
the index names only files of tasks that ended well, so a repeated or lost task
leaves no wrong rows behind. Files are reached by pyarrow's file systems, or
directly if the folder's scheme is ``file``.

Defined cases: a null html is an empty payload; a null page id loses against
every other; of rows that repeat page id and payload one is the response; a null
URL leaves out the target header; line breaks in URLs are percent-encoded;
records of any size are written, a record larger than a read range is read
alone; empty tables give empty archives and results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import saved, shared_folder, text_batches, whole

#: Bytes that one archive file holds at most, one record more or less.
FILE_BYTES = 256 << 20
#: Bytes that one task reads back, about.
PIECE_BYTES = 16 << 20
#: Bytes of one range read at most, and of a gap that is read over.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Names of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, file string, offset long, length long"
)


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return parts.path if parts.scheme in ("", "file") else None


class _Out:
    """Appends gzip members to one archive file."""

    def __init__(self, folder: str, name: str):
        self.path, self.size = f"{folder}/{name}", 0
        if local := _local(self.path):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            self.file = open(local, "wb")
        else:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(self.path)
            system.create_dir(at.rsplit("/", 1)[0])
            self.file = system.open_output_stream(at)

    def add(self, record: bytes) -> tuple[int, int]:
        data = gzip.compress(record, 5, mtime=0)
        at, self.size = self.size, self.size + len(data)
        self.file.write(data)
        return at, len(data)

    def close(self) -> None:
        self.file.close()


def _reader(path: str):
    if local := _local(path):
        f = open(local, "rb")

        def read(offset: int, size: int) -> bytes:
            f.seek(offset)
            return f.read(size)

        return read, f.close
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    f = system.open_input_file(at)
    return (lambda offset, size: f.read_at(size, offset)), f.close


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> tuple[bytes, str]:
    """The bytes of one record and its payload digest."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """Headers, HTTP block and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
    return {"headers": headers, "payload": payload, "said_bytes": said}


def decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload key, refers_to, rows): which page is the response of each payload. Narrow: no html."""
    html = whole("html")
    # two digests stand for the payload, so that a collision of one does no harm
    keys = pages.select("page_id", F.concat(F.sha1(html.cast("binary")), F.sha2(html, 256)).alias("payload"), F.octet_length(html).alias("bytes"))
    each = keys.groupBy("payload", "page_id").agg(F.max("bytes").alias("bytes"))
    last = each.groupBy("payload").agg(F.max("page_id").alias("response"))  # null only if all are
    return each.join(last, "payload").select(
        "page_id", "payload", F.when(F.col("bytes") >= least_bytes, F.col("response")).otherwise(F.col("page_id")).alias("response"),
        (F.col("bytes") >= least_bytes).alias("shared"),
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write an archive record per row of ``pages`` (page_id, url, html); returns the index, itself written once."""
    text_batches(pages.sparkSession)
    html = whole("html")
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.concat(F.sha1(html.cast("binary")), F.sha2(html, 256)).alias("payload"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"),
    )
    what = decisions(pages, least_bytes).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).drop("page_id")
    rows = rows.join(what, ["key", "payload"])
    copy = F.row_number().over(Window.partitionBy("key", "payload").orderBy(F.lit(1)))
    is_response = ~F.col("shared") | (F.col("page_id").eqNullSafe(F.col("response")) & (F.col("copy") == 1))
    rows = rows.withColumn("copy", copy).select(
        "page_id", "url", "html", F.when(is_response, "response").otherwise("revisit").alias("kind"), F.when(~is_response, F.col("response")).alias("refers_to")
    )

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        try:
            for batch in batches:
                index = []
                for page_id, url, text, kind, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "kind", "refers_to"))):
                    if out is None or out.size >= file_bytes:
                        if out is not None:
                            out.close()
                        out = _Out(folder, f"{uuid.uuid4().hex}.warc.gz")
                    page, to = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                    data, digest = record(page, url, text.encode("utf-8", "surrogatepass"), kind, to)
                    index.append((page, url, kind, to, digest, out.path, *out.add(data)))
                done = pd.DataFrame(index, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "file", "offset", "length"])
                yield done.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return saved(rows.mapInPandas(archive, _INDEX), "warc-index")


def read(index: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that ``index`` (file, offset, length) selects: page_id, record_type, refers_to, url, digest, html, payload_bytes."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at, close = None, None, None
        for batch in batches:  # sorted by file and offset
            for file, rows in batch.groupby("file", sort=False):
                if file != path:
                    if close:
                        close()
                    (at, close), path = _reader(file), file
                spans, todo = list(zip(rows["offset"], rows["length"])), []
                for n, (offset, length) in enumerate(spans):
                    todo.append((offset, length))
                    after = spans[n + 1] if n + 1 < len(spans) else None
                    if after and after[0] - (offset + length) <= gap_bytes and after[0] + after[1] - todo[0][0] <= read_bytes:
                        continue
                    data = at(int(todo[0][0]), int(offset + length - todo[0][0]))
                    yield _parsed([gzip.decompress(data[o - todo[0][0]:o - todo[0][0] + size]) for o, size in todo])
                    todo = []
        if close:
            close()

    # the index is small and what it selects is not: tasks go by the bytes to read
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spans = index.select("file", "offset", "length", F.floor(F.col("offset") / PIECE_BYTES).alias("piece"))
    ordered = spans.repartition(max(1, -(-total // PIECE_BYTES)), "file", "piece").sortWithinPartitions("file", "offset").drop("piece")
    return ordered.mapInPandas(
        fetch, "page_id long, record_type string, refers_to long, url string, digest string, payload_bytes long, payload_digest string, html string"
    )


def _parsed(records: list[bytes]) -> pd.DataFrame:
    rows = []
    for data in records:
        r = parse(data)
        h, response = r["headers"], r["headers"]["WARC-Type"] == "response"
        page, refers = h.get("X-Page-ID") or None, h.get("X-Refers-To-Page-ID") or None
        rows.append((
            page and int(page), h["WARC-Type"], refers and int(refers), h.get("WARC-Target-URI"), h["WARC-Payload-Digest"].split(":")[1],
            len(r["payload"]) if response else r["said_bytes"], payload_digest(r["payload"]) if response else h["WARC-Payload-Digest"].split(":")[1],
            r["payload"].decode("utf-8", "surrogatepass") if response else None,
        ))
    out = pd.DataFrame(rows, columns=["page_id", "record_type", "refers_to", "url", "digest", "payload_bytes", "payload_digest", "html"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write(pages, shared_folder(spark, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX, _BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits at a time are four digits of base 32.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
g AS (SELECT *, list_transform(range(8), lambda k: list_sum(list_transform(range(5), lambda m: (instr('{_HEX}', substr(x, 5 * k + m + 1, 1)) - 1) * (1 << (16 - 4 * m)::INTEGER)))::BIGINT) AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(v, lambda b: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('{_BASE32}', ((b >> s) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g
"""
