"""WARC archives packaged in ZIP files: written with an index, read by ranges.

A package holds two stored members: ``archive/data.warc.gz``, records that are gzip members of their own, and
``indexes/index.cdxj``, a line for each record with its offset and length. The reader parses the end record, its ZIP64
form where there is one, and the central directory, finds the stored members, reads the index and then each record by its
byte range; nothing is extracted. Packages are written to the shared folder through pyarrow's file systems, under a new
name for each attempt; the manifest holds those of the attempts that counted.

Defined results: null html is an empty payload; a null URL is written as ``urn:page:<id>``; repeated page ids each get a
record, and the largest id of equal payloads is the response (a repeated largest id: all of its rows are); an empty table
gives an empty result; columns besides page_id, url and html are left out. A payload of any size is held whole once.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table_path, written

#: Payloads below this size are always written whole.
LEAST_SHARED = 1000
#: Bytes of records after which a task begins another package.
PACKAGE_BYTES = 128 << 20
#: Records that one range-reading task row covers.
RANGE_RECORDS = 256
#: Bytes of payloads that a reader holds before it passes them on, besides one record; bytes of packages that a task reads.
HELD_BYTES, READ_BYTES = 8 << 20, 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, records long, bytes long"
RANGES = "path string, base long, offsets array<long>, lengths array<long>"
RECORDS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary, path string, offset long, length long"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The path's file system; paths below the shared folder always have a scheme."""
    if "://" not in path and not path.startswith("file:/"):
        raise ValueError(f"{path} has no scheme")
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


# --- writing ---------------------------------------------------------------------------------------------------------


def warc_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload that names the record it refers to."""
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {(url or f'urn:page:{page_id}').translate({10: '%0A', 13: '%0D'})}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """One ZIP file that is written from front to back."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, at = opened(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        raw = gzip.compress(warc_record(page_id, url, payload, digest, refers_to), 5, mtime=0)
        self.index.append(json.dumps({"id": page_id, "offset": self.bytes, "length": len(raw)}))
        self.data.write(raw)
        self.bytes += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index), self.bytes


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in cols)
                package = package or Package(folder)
                package.add(page_id, url, (html or "").encode(), digest, refers_to)
                if package.bytes >= most:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Adds digest and refers_to: the response of a page whose payload an equal one with a larger id holds."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.encode(html, "UTF-8")))
    shared = pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least)
    largest = shared.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").drop("first")
    # small payloads, many of them equal, get keys of their own that match nothing, so that no task gets them all
    key = F.when(F.octet_length(html) >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    largest = written(largest.withColumnRenamed("digest", "shared__"), "largest")
    joined = rows.withColumn("shared__", key).join(largest, "shared__", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("last", "shared__")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes every page to packages below folder; returns the manifest, written itself."""
    return written(with_revisits(pages, least).mapInArrow(_writer(folder, package_bytes), MANIFEST), "manifest")


# --- reading ---------------------------------------------------------------------------------------------------------

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """The values of a ZIP64 extra field stand, in order, for those that are all ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body = extra[at + 4 : at + 4 + size]
            full, k = [], 0
            for value, ones in zip(wanted, (0xFFFFFFFF,) * 3, strict=True):
                if value == ones:
                    value, k = struct.unpack_from("<Q", body, k)[0], k + 8
                full.append(value)
            return full
        at += 4 + size
    return wanted


def directory(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Name to (start of the bytes, their number) of the stored members, from the central directory alone."""
    size = file.size()
    tail_at = max(0, size - 65_557 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the mark within a comment
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or cut short")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        file.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        end = file.read(56)
        if end[:4] != END64:
            raise ValueError("the ZIP64 locator points at something else")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    file.seek(start)
    raw, at, out = file.read(length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", raw, at + 20)
        offset = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, offset = _zip64(raw[at + 46 + names : at + 46 + names + extras], [full, packed, offset])
        if method == 0:
            file.seek(offset)
            head = file.read(30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            out[name] = (offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + names + extras + notes
    return out


def _locator(per_row: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = opened(path)
                with fs.open_input_file(at) as file:
                    members = directory(file)
                    base, _ = members[DATA]
                    start, size = members[INDEX]
                    file.seek(start)
                    lines = [json.loads(x) for x in file.read(size).decode().split("\n") if x]
                rows = [lines[i : i + per_row] for i in range(0, len(lines), per_row)]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array([base] * len(rows), pa.int64()), pa.array([[x["offset"] for x in r] for r in rows], longs), pa.array([[x["length"] for x in r] for r in rows], longs)],
                    names=["path", "base", "offsets", "lengths"],
                )

    return run


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one WARC record; the digest of a response's payload is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda k: None if headers.get(k, "<urn:page:None>") == "<urn:page:None>" else int(headers[k][len("<urn:page:") : -1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't have its digest")
    return {"page_id": number("WARC-Record-ID"), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"], "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload if headers["WARC-Type"] == "response" else None}


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "path", "offset", "length"]
    made = lambda found: pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)
    for batch in batches:
        for row in batch.to_pylist():
            fs, at = opened(row["path"])
            found, held = [], 0
            with fs.open_input_file(at) as file:
                for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                    file.seek(row["base"] + offset)
                    found.append(parse_record(gzip.decompress(file.read(length))) | {"path": row["path"], "offset": row["base"] + offset, "length": length})
                    held += len(found[-1]["payload"] or b"")
                    if held >= HELD_BYTES:
                        yield made(found)
                        found, held = [], 0
            if found:
                yield made(found)


def read_archives(spark: SparkSession, packages: DataFrame, per_row: int = RANGE_RECORDS) -> DataFrame:
    """All records of the packages whose paths are given; payload is null in revisits."""
    ranges = packages.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_locator(per_row), RANGES)
    # the ranges of a large package are read by many tasks, and more tasks read more bytes
    size = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] if "bytes" in packages.columns else 0
    return ranges.repartition(max(4 * spark.sparkContext.defaultParallelism, int(size) // READ_BYTES)).mapInArrow(_reader, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's size is its response's."""
    facts = records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    facts = written(facts, "records")
    own, visits = facts.where("record_type = 'response'"), facts.where("record_type = 'revisit'").drop("payload_bytes")
    held = own.groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    return own.unionByName(visits.join(held, "refers_to", "left"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to packages in the shared folder and reads them back."""
    spark = pages.sparkSession
    return resolved(read_archives(spark, write_archives(pages, table_path(spark, "packages"))))
