"""WARC archives with an index first: write records, then read selected ones by coalesced byte ranges.

Each task writes one file of gzip members, a member a record, into the shared folder, and returns an index row
(file, offset, length, URL, digest) for each record. File names are unique to an attempt and the index names
those of attempts that succeeded, so that a lost executor or a second attempt leaves nothing but a file that
no index knows. Readers sort the selected index rows by file and offset, join ranges that lie close together
and read each run with one request. Repeated payloads are written as revisits of the record with the
smallest id.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import time
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevier.llm.common import cut, new_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Repeated payloads (digest and id, some 100 bytes each) that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
CONTROL = re.compile(r"[\x00-\x20\x7F]")


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_id(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. The HTTP head of a revisit tells the length of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(lines.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 6, mtime=0)


def decode_record(member: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Header fields, payload length and payload (None for a revisit) of one gzip member."""
    raw = gzip.decompress(member)
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields, size, None if fields["WARC-Type"] == "revisit" else body


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder; Arrow opens local and remote ones alike."""
    return fs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 100,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each row of pages and return the index, read back from where it was written.

    Payloads are UTF-8; null is empty. Of rows with equal payloads of at least min_revisit bytes that with the
    smallest id is a response and the others are revisits of it; rows that share the smallest id are all
    responses, and a row with a null id is a revisit if any other has an id.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    counted = F.octet_length("payload") >= min_revisit
    # Digests and ids alone are shuffled to find the payloads that occur twice; the payloads stay where they are read
    # as long as those fit a broadcast.
    first = (
        rows.where(counted).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("digest").alias("key"), "first")
    )
    first = cut(first)
    first = F.broadcast(first) if first.count() <= MOST_BROADCAST else first
    # Short payloads join nothing; a key of their own keeps them from meeting in one partition.
    key = F.when(counted, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = rows.withColumn("key", key).join(first, "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to")
    )

    def write(batches):
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            found = []
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                member = encode_record(page_id, url, body, digest, refers_to, refers_to is not None, date)
                out.write(member)
                kind = "response" if refers_to is None else "revisit"
                found.append((page_id, url, digest, kind, refers_to, name, at, len(member)))
                at += len(member)
            yield rows_batch(found, INDEX)
        if out:
            out.close()

    typed.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def rows_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields]
    )


def byte_runs(ranges: list[tuple[int, int]], max_gap: int, max_run: int):
    """Sorted (offset, length) ranges as runs (first, last + 1, start, end) that one request reads."""
    first = 0
    for k in range(1, len(ranges) + 1):
        start, end = ranges[first][0], ranges[k - 1][0] + ranges[k - 1][1]
        if k == len(ranges) or ranges[k][0] - end > max_gap or ranges[k][0] + ranges[k][1] - start > max_run:
            yield first, k, start, end
            first = k


def read_range(store: fs.FileSystem, path: str, start: int, end: int, tries: int = 3) -> bytes:
    """Bytes of one range; a failing store is asked again."""
    for k in range(tries):
        try:
            with store.open_input_file(path) as source:
                return source.read_at(end - start, start)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(0.2 * 2**k)
    raise AssertionError


def read_records(
    index: DataFrame, with_payload: bool = True, max_gap: int = 65_536, max_run: int = 8_388_608, block: int = 67_108_864
) -> DataFrame:
    """The records of the selected index rows: ids, URL, type, payload length and digest, payload.

    Ranges of a file are read in order, a block of each file by one task. A payload must have the digest that
    its header and the index tell, or the read fails. A revisit has no payload of its own.
    """

    def read(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            low = 0
            while low < len(rows):
                high = low
                while high < len(rows) and rows[high][:2] == rows[low][:2]:
                    high += 1
                own = rows[low:high]
                store, path = open_folder(own[0][0])
                found = []
                for a, b, start, end in byte_runs([r[2:4] for r in own], max_gap, max_run):
                    data = read_range(store, f"{path}/{own[0][1]}", start, end)
                    for _, _, offset, length, digest in own[a:b]:
                        fields, size, body = decode_record(data[offset - start : offset - start + length])
                        told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if told != digest or body is not None and hashlib.sha256(body).hexdigest() != told:
                            raise ValueError(f"digest mismatch at {own[0][1]}:{offset}")
                        found.append(
                            (
                                record_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                                record_id(fields.get("WARC-Refers-To")), size, told, body if with_payload else None,
                            )
                        )
                yield rows_batch(found, RECORD)
                low = high

    chosen = index.select("folder", "file", "offset", "length", "digest")
    placed = chosen.repartition("folder", "file", F.floor(F.col("offset") / block)).sortWithinPartitions("folder", "file", "offset")
    return placed.mapInArrow(read, RECORD)
