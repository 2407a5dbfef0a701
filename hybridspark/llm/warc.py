"""WARC archives: a writer that turns repeated payloads into revisits, and a sequential reader.

One gzip member holds one record. The reader inflates a file piece by piece, so a task holds one record at a time,
takes the record's length from its header and checks both digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shared_dir

#: Payloads below this many bytes are always written out.
LEAST = 1000
#: An archive is closed at this size.
ROLL_BYTES = 64 << 20
_PIECE = 1 << 18
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    """A digest as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of refers_to, as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    lines += [f"WARC-Payload-Digest: {sha1(payload)}", f"WARC-Block-Digest: {sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(read_some: Callable[[int], bytes], where: str) -> Iterator[bytes]:
    """What each gzip member of a file holds, in order."""
    rest, inflate, parts = b"", zlib.decompressobj(31), []
    begun = False
    while True:
        data = rest or read_some(_PIECE)
        rest = b""
        if not data:
            if begun:
                raise ValueError(f"{where}: it ends within a record")
            return
        begun = True
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts, begun = inflate.unused_data, zlib.decompressobj(31), [], False


def parse(member: bytes, where: str) -> dict:
    """Headers, HTTP headers and payload of a record; a ValueError if length or digests are not what the headers say."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError(f"{where}: no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) < size or end != b"\r\n\r\n":
        raise ValueError(f"{where}: {headers.get('warc-record-id')} is not {size} bytes long")
    if (said := headers.get("warc-block-digest")) and said != sha1(block):
        raise ValueError(f"{where}: {headers.get('warc-record-id')} does not match its block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")) and said != sha1(payload):
        raise ValueError(f"{where}: {headers.get('warc-record-id')} does not match its payload digest")
    return {"headers": headers, "http": fields, "payload": payload}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of pages to archives in folder and returns (path, records), one row an archive.

    Of records with equal payloads of least bytes or more, the one with the largest key is a response and the others
    are its revisits; rows with a null key are never referred to, and are responses where no other row has the payload.
    A null html is an empty payload. Rows that share the largest key are all responses. Further columns are left out.

    Archives belong to a task's attempt and only those of attempts that succeeded are in the returned list, so a task
    that is run again leaves no second record in it. The folder may be in any store that pyarrow.fs reaches."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    kept = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    # short payloads match nothing; a name of their own keeps them from meeting in one partition
    rows = rows.withColumn("digest", F.coalesce("digest", F.concat(F.lit("short "), F.xxhash64("page_id", "url", "payload").cast("string"))))
    rows = rows.join(kept, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, out, n, size, done = f"{root}/{task.partitionId():05d}-{task.taskAttemptId()}", None, 0, 0, []

        def close():
            out.close()
            done.append((path, n))

        for batch in batches:
            for page_id, address, payload, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    path, n, size = f"{stem}-{len(done):05d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record(page_id.as_py(), address.as_py(), payload.as_py(), refers_to.as_py())
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return cut(rows.mapInArrow(run, "path string, records long"))


_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_back(archives: DataFrame, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of archives (path, as write() returned them), in their order within an archive.

    A revisit has the digest and length of the payload it stands for, and a null payload."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    rows, held = [], 0
                    for member in members(f.read, path):
                        r = parse(member, path)
                        h, kind = r["headers"], r["headers"]["warc-type"]
                        payload = r["payload"] if kind == "response" else None
                        rows.append((_page(h.get("warc-record-id")), h.get("warc-target-uri"), kind, int(r["http"]["content-length"]), _hex(h["warc-payload-digest"]), _page(h.get("warc-refers-to")), payload))
                        held += len(member)
                        if held >= batch_bytes:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    # an archive a task, as the list of paths is small
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, _FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    archives = write(read(spark, sf_dir, "pages"), folder)
    return read_back(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN m.response IS NULL OR m.response = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.response <> d.page_id THEN m.response END AS refers_to
FROM d LEFT JOIN m ON d.payload_bytes >= 1000 AND d.payload_digest = m.payload_digest
"""
