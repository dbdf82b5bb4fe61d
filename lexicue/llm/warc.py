"""WARC archives with an index written first, and reads by coalesced byte ranges.

Writing tasks put each record, as a gzip member of its own, at the end of their archive and give one index row for
it: archive, offset, length, URL, digest. Any selection of index rows is then read back by sorting them by archive
and offset, joining near neighbours into byte ranges, and reading each range once.

Archives lie in the shared folder. Tasks reach it through ``pyarrow.fs`` by its URI; a file has a name of its own
for each attempt, and only the rows of attempts that succeeded are in the index, so repeats leave no wrong record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexicue.llm.common import materialized
from lexicue.session import shared_dir

#: Bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
#: A range is read at once: at most this long (or one record), over gaps of at most this many bytes.
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Parts a group of equal payloads is dealt over.
SALT = 32
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_type string, url string, payload_digest string, archive string, offset long, length long"


def filesystem(uri: str):
    """(file system, path) of a folder or file named by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """A record's bytes and its payload's digest.

    A revisit keeps the HTTP header, with the length of the payload it leaves out, as the format has it.
    """
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha


def parse(data: bytes) -> dict:
    """Header fields in lower case, with ``payload`` and ``payload_bytes``; raises on a record that is not whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not the start of a record")
    out = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(out["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"record {out.get('warc-record-id')} is cut")
    http, _, out["payload"] = block.partition(b"\r\n\r\n")
    out["payload_bytes"] = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if out["warc-type"] == "response" and (
        len(out["payload"]) != out["payload_bytes"] or digest(out["payload"]) != out["warc-payload-digest"].removeprefix("sha1:")
    ):
        raise ValueError(f"record {out['warc-record-id']} does not have its digest")
    return out


def _clean(url: str | None) -> str:
    """A header value has no line ends; what is not there is empty."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()


def decide(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Every page with ``_top``: the largest id among the equal payloads of ``least`` bytes or more, where that is another.

    Payloads are equal when their SHA-1 is. Only groups of two or more are joined back, each to all parts its
    pages are dealt over. Pages that share the largest id are all responses; a null id is below every other.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    page = pages.select(
        F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha"),
        F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(SALT)).alias("_salt"),
    )
    tops = (
        page.where(F.octet_length("_body") >= least).groupBy("_sha")
        .agg(F.max("_id").alias("_top"), F.count("*").alias("_n")).where("_n > 1")
        .select(F.col("_sha").alias("_sha2"), "_top", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt2"))
    )
    joined = page.join(tops, (F.col("_sha") == F.col("_sha2")) & (F.col("_salt") == F.col("_salt2")), "left")
    return joined.select("_id", "_url", "_body", F.when(~F.col("_top").eqNullSafe(F.col("_id")), F.col("_top")).alias("_top"))


def write(pages: DataFrame, folder: str, key: str = "page_id", archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write one record per page below ``folder`` and return the stored index."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        out = name = None
        at = 0
        try:
            for b in batches:
                rows = {k: [] for k in ("record_type", "url", "payload_digest", "archive", "offset", "length")}
                for page, where, body, top in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    where = _clean(where)
                    data, sha = record("null" if page is None else str(page), where, body or b"", None if top is None else str(top))
                    member = gzip.compress(data, 6, mtime=0)
                    out.write(member)
                    for k, v in zip(rows, ("response" if top is None else "revisit", where, sha, name, at, len(member))):
                        rows[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(v, pa.int64() if k in ("offset", "length") else pa.string()) for k, v in rows.items())],
                    names=["page", *rows],
                )
        finally:
            if out is not None:
                out.close()

    kind = pages.schema[key].dataType.simpleString()
    return materialized(decide(pages, key, **columns).mapInArrow(put, f"page {kind}, {SCHEMA}"))


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """Byte ranges that cover the selected records: archive, first, last and the records' offsets and lengths.

    Archives are cut into stretches of ``range_bytes``, so a window holds no more than one stretch.
    """
    cut = index.select("archive", "offset", "length", F.floor(F.col("offset") / range_bytes).alias("_stretch"))
    order = W.partitionBy("archive", "_stretch").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap, F.lit(False))
    runs = cut.withColumn("_apart", apart.cast("int")).withColumn("_run", F.sum("_apart").over(order))
    return runs.groupBy("archive", "_stretch", "_run").agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    ).select("archive", "first", "last", "records")


def read(index: DataFrame, folder: str, kind: str = "bigint", payload: bool = False) -> DataFrame:
    """The selected records, read from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url and, if asked for, the payload of responses."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        ident = lambda x: None if x is None or x[10:-1] == "null" else x[10:-1]  # noqa: E731  <urn:page:...>
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{path}/{row['archive']}") as f:
                    data = f.read_at(row["last"] - row["first"], row["first"])
                got = [
                    parse(gzip.decompress(data[r["offset"] - row["first"] : r["offset"] - row["first"] + r["length"]]))
                    for r in row["records"]
                ]
                cols = [
                    [ident(x["warc-record-id"]) for x in got], [x["payload_bytes"] for x in got],
                    [x["warc-payload-digest"].removeprefix("sha1:") for x in got], [x["warc-type"] for x in got],
                    [ident(x.get("warc-refers-to")) for x in got], [x["warc-target-uri"] for x in got],
                    [x["payload"] if payload and x["warc-type"] == "response" else None for x in got],
                ]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"],
                )

    found = ranges(index).mapInArrow(
        get, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"
    )
    found = found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
    return found if payload else found.drop("payload")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, then read every record back: one row per page.

    A null payload is the empty one, a null address an empty header. Repeated rows are records of their own. An empty
    table gives no archive and no rows; other columns are not written.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write(pages, folder, key, url=url, html=html)
    return read(index, folder, pages.schema[key].dataType.simpleString())
