"""WARC archives as a chunked record table.

An archive is a table of rows ``(archive, record, chunk, last, data, sha1)``: the
``data`` of an archive's rows in order of record and chunk is a WARC/1.1 file,
byte by byte.  ``sha1`` is the digest of the record's payload up to the end of
the chunk, so a reader can check each chunk as it passes, and neither writer nor
reader holds more of a record than one chunk.  Records with equal payloads are
written once and referred to by revisit records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import hot_join, hot_keys, scratch, stored

CHUNKS = "archive long, record long, chunk int, last boolean, data binary, sha1 string"
RECORDS = "record_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, chunks_ok boolean"
_END = b"\r\n\r\n"
_BATCH = 4 << 20
_HEAD = 1 << 20  # bytes within which a record's headers end, unless they say at their beginning that they are longer
_LONG = re.compile(rb"WARC/1\.1\r\nX-Header-Length: (\d{1,18})\r\n")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """``(_id, _url, _payload, _bytes, _digest, _refers)``: one row a page, ``_refers`` null for responses.

    Of pages with equal payloads of ``least`` bytes or more, those with the
    largest id are responses and the others refer to it; a null id counts as
    smallest, and where all are null all are responses.  Null payloads are empty.
    Repeated rows, null ids included, are pages each; an empty table stays empty;
    other columns are not read.  Only digests are grouped; counts come first, and a
    payload that a third of all pages share is dealt out in the join.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    base = base.withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_digest": F.sha1("_payload")})
    with scratch(pages.sparkSession) as keep:
        counts = base.filter(F.col("_bytes") >= least).groupBy("_digest", "_bytes").agg(F.max("_id").alias("_top"), F.count("*").alias("_n"))
        counts = keep(stored(counts.filter("_n > 1").withColumnRenamed("_digest", "_join")))
    # small payloads look for no other: keys of their own keep the many empty pages apart
    base = base.withColumn("_join", F.when(F.col("_bytes") >= least, F.col("_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("_id", "_url").cast("string"))))
    own = hot_join(base, counts.drop("_n"), ["_join", "_bytes"], hot_keys(counts, ["_join", "_bytes"], "_n"), "left")
    return own.select("_id", "_url", "_payload", "_bytes", "_digest", F.when(F.coalesce("_id", F.lit(-(1 << 63))) < F.col("_top"), F.col("_top")).alias("_refers"))


def _head(rid: object, url: str | None, size: int, digest: str, refers: int | None, date: str) -> bytes:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"" if refers is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{rid}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {clean}"] * bool(clean)
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers}>", f"X-Payload-Length: {size}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    head = "\r\n".join(lines).encode() + _END + http
    if 2 * len(head) > _HEAD:  # a very long URL: the reader is told how much to expect
        head = head.replace(b"\r\n", b"\r\nX-Header-Length: %d\r\n" % len(head), 1)
    return head


def _pieces(head: bytes, payload: memoryview, size: int) -> Iterator[tuple[bytes, memoryview]]:
    """(bytes of the record, its part of the payload) a chunk: chunks of ``size`` bytes but the last."""
    total, at = len(head) + len(payload) + len(_END), 0
    while at < total:
        a, b = max(0, at - len(head)), max(0, at + size - len(head))
        body = payload[a:b]
        room = size - len(head[at : at + size]) - len(body)
        tail_at = max(0, at - len(head) - len(payload))
        yield head[at : at + size] + bytes(body) + (_END[tail_at : tail_at + room] if b > len(payload) else b""), body
        at += size


def _write(batches: Iterator[pa.RecordBatch], chunk_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    archive, record = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        ids, urls, sizes, digests, refers = (batch.column(c).to_pylist() for c in ("_id", "_url", "_bytes", "_digest", "_refers"))
        payloads = batch.column("_payload")
        for i in range(batch.num_rows):
            body = memoryview(payloads[i].as_buffer()) if refers[i] is None else memoryview(b"")
            sha = hashlib.sha1(usedforsecurity=False)
            pieces = list(_pieces(_head(ids[i], urls[i], sizes[i], digests[i], refers[i], date), body, chunk_bytes)) if len(body) < chunk_bytes else _pieces(_head(ids[i], urls[i], sizes[i], digests[i], refers[i], date), body, chunk_bytes)
            before = None
            for k, (data, part) in enumerate(pieces):
                sha.update(part)
                if before is not None:
                    rows.append((*before, False))
                before = (archive, record, k, data, sha.copy().hexdigest())
                held += len(data)
                if held >= _BATCH:
                    yield _chunk_batch(rows)
                    rows, held = [], 0
            rows.append((*before, True))
            record += 1
    if rows:
        yield _chunk_batch(rows)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, r, k, d, s, last = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int32()), pa.array(last, pa.bool_()), pa.array(d, pa.binary()), pa.array(s, pa.string())],
        names=["archive", "record", "chunk", "last", "data", "sha1"],
    )


def to_chunks(records: DataFrame, chunk_bytes: int = 1 << 18, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The chunk rows of :func:`with_revisits`' records, one archive a task."""
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be 1 or more")
    return records.mapInArrow(lambda it: _write(it, chunk_bytes, date), CHUNKS)


class _Record:
    """Reads one record from chunks, keeping no more than the header and one chunk."""

    def __init__(self) -> None:
        self.head, self.fields, self.body, self.skip = b"", None, None, 0
        self.seen, self.size, self.ok = 0, 0, True
        self.sha = hashlib.sha1(usedforsecurity=False)

    def feed(self, data: bytes, running: str | None) -> None:
        if self.body is None:
            self.head += data
            if not self._parse():
                told = _LONG.match(self.head[:64])
                if len(self.head) > max(_HEAD, 64 + int(told[1]) if told else 0):  # no header ends so late: a damaged record, of which nothing is kept
                    self.head, self.body, self.ok = b"", 0, False
                return
            data, self.head = self.head[self.skip :], b""
        part = data[: max(0, self.body - self.seen)]
        self.seen += len(part)
        self.sha.update(part)
        self.size += len(part)
        if running is not None:
            self.ok &= self.sha.hexdigest() == running

    def _parse(self) -> bool:
        """True once the record's and, for responses, the HTTP message's header are there."""
        end = self.head.find(_END)
        if end < 0:
            return False
        if self.fields is None:
            lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length, self.skip = int(self.fields.get("content-length", 0)), end + 4
        if "http" in self.fields.get("content-type", "") and length:
            inner = self.head.find(_END, end + 4)
            if inner < 0:
                return False
            length -= inner + 4 - self.skip
            self.skip = inner + 4
        self.body = length
        return True

    def row(self) -> tuple:
        f = self.fields or {}
        plain = lambda x: re.sub(r"^<urn:record:|>$", "", x) if x else None
        kind = f.get("warc-type")
        told = f.get("warc-payload-digest", "")
        told = base64.b32decode(told.removeprefix("sha1:")).hex() if told.startswith("sha1:") else None
        revisit = kind == "revisit"
        digest, size = (told, int(f.get("x-payload-length", 0))) if revisit else (self.sha.hexdigest(), self.size)
        return plain(f.get("warc-record-id")), f.get("warc-target-uri"), kind, size, digest, plain(f.get("warc-refers-to")), bool(self.ok and (told is None or told == digest) and self.seen == (self.body or 0))


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, now, at = [], None, None
    for batch in batches:
        data = batch.column("data")
        for i, (a, r, last, sha) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("archive", "record", "last", "sha1")), strict=True)):
            if at != (a, r):
                now, at = _Record(), (a, r)
            now.feed(data[i].as_py(), sha)
            if last:
                rows.append(now.row())
                at = None
        if len(rows) >= 5000:
            yield _record_batch(rows)
            rows = []
    if rows:
        yield _record_batch(rows)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """One row a record, from chunk rows in any order.

    ``chunks_ok`` tells whether every running digest, the header's digest and the
    length agree with the payload that was read.  Records of one chunk are read
    where they lie; only those of several are dealt out by record and sorted.
    """
    one = (F.col("chunk") == 0) & F.col("last")
    many = chunks.filter(~one).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return chunks.filter(one).mapInArrow(_read, RECORDS).unionByName(many.mapInArrow(_read, RECORDS))


def export_files(chunks: DataFrame, folder: str, compress: bool = True) -> None:
    """Write an archive of ``chunks`` as ``folder/archive-N.warc[.gz]``, one gzip member a record.

    ``folder`` must be mounted on every executor; a file that is written again
    after a lost executor replaces the earlier one.
    """
    import os
    import uuid

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, at = None, None, (None, None)
        for batch in batches:
            for a, r, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "record", "data")), strict=True):
                if own is None or a != at[0]:
                    if own is not None:
                        compress and member.close()
                        out.close()
                        os.replace(*own)
                    own = (f"{folder}/.{uuid.uuid4().hex}", f"{folder}/archive-{a}.warc" + ".gz" * compress)
                    out, member = open(own[0], "wb"), None  # noqa: SIM115
                if compress and (member is None or (a, r) != at):
                    member and member.close()
                    member = gzip.GzipFile(fileobj=out, mode="wb", mtime=0)
                (member if compress else out).write(data)
                at = (a, r)
        if own is not None:
            compress and member.close()
            out.close()
            os.replace(*own)
        return iter(())

    chunks.repartition("archive").sortWithinPartitions("archive", "record", "chunk").mapInArrow(write, "none int").count()


def import_files(spark: SparkSession, paths: list[str], chunk_bytes: int = 1 << 18) -> DataFrame:
    """Chunk rows of WARC files (plain or gzip) that every executor can open, read as streams."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path in zip(*(batch.column(c).to_pylist() for c in ("archive", "path")), strict=True):
                with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
                    for record, pieces in enumerate(_file_records(f, chunk_bytes)):
                        before = None
                        for k, data in enumerate(pieces):
                            if before is not None:
                                yield _chunk_batch([(*before, False)])
                            before = (archive, record, k, data, None)
                        if before is not None:
                            yield _chunk_batch([(*before, True)])

    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] or [], "archive long, path string")
    return listed.repartition(max(1, len(paths)), "archive").mapInArrow(read, CHUNKS)


def _file_records(f, chunk_bytes: int) -> Iterator[Iterator[bytes]]:
    while line := f.readline():
        if not line.strip():
            continue
        head, length = line, 0
        while (line := f.readline()).strip():
            head += line
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":")[1])
        pieces = _cut_stream(f, head + line, length, chunk_bytes)
        yield pieces
        for _ in pieces:  # whatever the caller left
            pass


def _cut_stream(f, head: bytes, length: int, chunk_bytes: int) -> Iterator[bytes]:
    data, left = head, length + len(_END)
    while left > 0:
        more = f.read(min(left, max(1, chunk_bytes - len(data))))
        if not more:
            break
        left -= len(more)
        data += more
        if len(data) >= chunk_bytes and left:
            yield data
            data = b""
    yield data
