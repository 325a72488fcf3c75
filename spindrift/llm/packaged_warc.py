"""WARC records in ZIP-packaged archives, read by ranges.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip members of
their own, and ``indexes/index.cdxj``, one line of JSON per record with its offset and length. The reader fetches the end
of the file, parses the end record, the ZIP64 end record where sizes or counts overflow, and the central directory,
locates the stored members by their local headers, reads the index, and fetches each record as one range. Nothing is
extracted, and no task holds more than a run of records.

Payloads that occur more than once (equal SHA-1, at least ``min_bytes`` long) are written once, as the response of the
largest page_id; the others become revisit records that refer to it. Digests that occur more than once (about 60 bytes
each) are broadcast up to a checked count; beyond it rows and digests are joined, hot digests spread, without payloads.

Defined results: null html is an empty payload; null urls become empty target URIs and are read back as null; a null
page_id counts as smaller than any other; repeated rows of the response's page are all responses, also where their urls
differ; a very long payload is a package of its own; further columns are ignored; an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, filesystem, partitions, pick, spread_join, utf8, work_dir, write_file, written

_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_record(raw: bytes) -> dict:
    """page_id, url, payload (None for revisits), payload_bytes, payload_digest, record_type and refers_to of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    http, _, body = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    kind, stated = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and payload_digest(body) != stated:
        raise ValueError(f"the payload of {warc['warc-record-id']} does not have its digest")
    return {
        "page_id": _page(warc["warc-record-id"]), "url": warc["warc-target-uri"] or None, "payload": body if kind == "response" else None,
        "payload_bytes": len(body) if kind == "response" else int(_headers(http)["content-length"]), "payload_digest": stated, "record_type": kind, "refers_to": _page(warc.get("warc-refers-to")),
    }


def package(records: list[tuple], zip64: bool = False) -> bytes:
    """A package of (page_id, url, payload, refers_to) rows. zip64: with ZIP64 extras in local headers, whatever the size."""
    data, index = io.BytesIO(), []
    for page_id, url, payload, refers_to in records:
        part = gzip.compress(record_bytes(page_id, url, payload, refers_to), 6, mtime=0)
        index.append(json.dumps({"url": url, "page_id": page_id, "filename": "data.warc.gz", "offset": data.tell(), "length": len(part)}))
        data.write(part)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        members = [("archive/data.warc.gz", data.getbuffer()), ("indexes/index.cdxj", ("\n".join(index) + "\n").encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": len(records)}).encode())]
        for name, content in members:
            with z.open(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(content)
    return out.getvalue()


class RangeFile:
    """Ranges of a file that any task can reach."""

    def __init__(self, url: str) -> None:
        fs, path = filesystem(url)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


def _zip64_field(extra: bytes, wanted: list[bool]) -> list[int | None]:
    """The 8-byte values of the ZIP64 extra for those fields that overflow, in the directory's order."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values, k = [], at + 4
            for w in wanted:
                values.append(struct.unpack_from("<Q", extra, k)[0] if w else None)
                k += 8 * w
            return values
        at += 4 + n
    if any(wanted):
        raise ValueError("a ZIP64 extra is missing")
    return [None] * len(wanted)


def zip_members(file) -> dict[str, tuple[int, int, int, int]]:
    """By name: method, compressed size, size and where the local header begins, from the (ZIP64) central directory."""
    tail_at = max(0, file.size - (1 << 16) - 22)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):  # the mark may stand in a comment
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = file.read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = file.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
    directory, members, k = file.read(at, size), {}, 0
    for _ in range(count):
        if directory[k : k + 4] != b"PK\1\2":
            raise ValueError("a damaged central directory")
        method, packed, full, n, m, c, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, k)
        name, extra = directory[k + 46 : k + 46 + n].decode("utf-8", "replace"), directory[k + 46 + n : k + 46 + n + m]
        big_full, big_packed, big_local = _zip64_field(extra, [full == 0xFFFFFFFF, packed == 0xFFFFFFFF, local == 0xFFFFFFFF])
        pick_ = lambda big, small: small if big is None else big
        members[name] = (method, pick_(big_packed, packed), pick_(big_full, full), pick_(big_local, local))
        k += 46 + n + m + c
    return members


def stored_range(file, member: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    method, packed, _, local = member
    if method:
        raise ValueError("the member is compressed; only stored ones can be read by ranges")
    head = file.read(local, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("a damaged local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return local + 30 + n + m, packed


def _index_rows(batches):
    for batch in batches:
        for url in batch.column(0).to_pylist():
            file = RangeFile(url)
            members = zip_members(file)
            for name, member in members.items():
                if name.startswith("indexes/") and name.endswith(".cdxj"):
                    at, n = stored_range(file, member)
                    starts, rows = {}, []
                    for line in file.read(at, n).decode().splitlines():
                        x = json.loads(line[line.index("{") :])
                        data = f"archive/{x['filename']}"
                        if data not in starts:
                            starts[data] = stored_range(file, members[data])[0]
                        rows.append((url, starts[data] + x["offset"], x["length"]))
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])


def _fetch(payloads: bool):
    def run(batches):
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            name, file = None, None
            for i in range(0, len(rows), 500):
                out = []
                for url, at, n in rows[i : i + 500]:
                    if url != name:
                        name, file = url, RangeFile(url)
                    out.append(parse_record(gzip.decompress(file.read(at, n))))
                get = lambda key: [x[key] for x in out]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("page_id"), pa.int64()), pa.array(get("url"), pa.string()), pa.array(get("payload_bytes"), pa.int64()), pa.array(get("payload_digest"), pa.string()), pa.array(get("record_type"), pa.string()), pa.array(get("refers_to"), pa.int64()), *([pa.array(get("payload"), pa.binary())] * payloads)],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads],
                )

    return run


def read_packages(files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the packages in column file; with payloads, also the bytes (null for revisits)."""
    spread = lambda df: df.repartition(partitions(files))
    index = spread(files.select("file")).mapInArrow(_index_rows, "file string, offset long, length long")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spread(index).mapInArrow(_fetch(payloads), schema)


def _writer(folder: str, package_bytes: int):
    def run(batches):
        attempt, made, rows, size = TaskContext.get().taskAttemptId(), [], [], 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal rows, size
            if rows:
                # an attempt has files of its own; the returned rows name those of the attempt that counts
                name = f"{folder}/{part:06d}-{len(made):05d}-{attempt}.wacz"
                write_file(name, package(rows))
                made.append((name, len(rows)))
            rows, size = [], 0

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = utf8(html)
                if size + len(payload) > package_bytes:
                    flush()
                rows.append((page_id, url, payload, refers_to))
                size += len(payload)
        flush()
        cols = list(zip(*made, strict=True)) if made else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64()), strict=True)], names=["file", "records"])

    return run


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 16 << 20) -> DataFrame:
    """file, records of each package written; a package holds about package_bytes of payloads, or one larger payload."""
    plain = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = plain.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.sha1("html")))
    copies = written(keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1"), "copies")
    responses = copies.select("key", "response")
    if copies.count() <= MAX_BROADCAST:
        rows = keyed.join(F.broadcast(responses), "key", "left")
    else:  # digests meet without the payloads, which move once, by row
        keyed = written(keyed, "pages")
        found = written(spread_join(keyed.where("key is not null").select("row", "key"), responses, ["key"], "row", copies.select("key", "n")).drop("key"), "revisits")
        rows = keyed.join(found, "row", "left")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))
    return written(rows.mapInArrow(_writer(folder, package_bytes), "file string, records long"), "packages")


def op4_packaged_warc(spark, sf_dir: str) -> DataFrame:
    files = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_dir(spark, "warc"))
    return read_packages(files).drop("url")
