"""WARC: deterministic sharded archives of pages, and a reader for them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import prefix_sums, stored, text_of
from noticeflow.session import scratch_path

SHARD_BYTES = 64 << 20      # payload bytes of a shard, more if there were over SHARDS of them
SHARDS = 1 << 16
ROLL_BYTES = 16 << 20       # compressed bytes of a file, but for its last record
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, records long, bytes long, sha1 string"
_RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "payload binary")


def plan(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per (page_id, payload): digest, shard, and the page that is the response of a payload that occurs again.

    Pages in the order of page_id are cut into shards by a prefix sum of payload bytes, so a shard's
    content depends on the pages alone, not on how they were read.  Equal payloads meet in a maximum.
    """
    narrow = pages.select(*_identity()).groupBy("_id", "_sha1").agg(F.first("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_copies"))
    narrow = narrow.withColumn("_size", (F.col("_bytes") + 1) * F.col("_copies"))
    sized = prefix_sums(narrow, ["_id", "_sha1"], "_size", unique=True)
    keepers = sized.groupBy("_sha1").agg(F.max("_id").alias("_keeper"), F.sum("_copies").alias("_same"))
    # only payloads that occur again have to be looked up
    again = keepers.filter("_same > 1").drop("_same")
    shard = F.expr(f"cast(start div greatest({shard_bytes}, total div {SHARDS} + 1) as int)")
    return stored(sized.join(again, "_sha1", "left").select("_id", "_sha1", "_keeper", shard.alias("_shard")), "warc-plan")


def _identity():
    html = text_of("html")
    return (F.col("page_id").cast("long").alias("_id"), F.sha1(html.cast("binary")).alias("_sha1"),
            F.octet_length(html).cast("long").alias("_bytes"))


def _record(page: int | None, copy: int, keeper: int | None, url: str, size: int, sha1: str, payload: bytes | None) -> bytes:
    """One compressed record, its headers and digests made anew; without a payload it is a revisit."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    name = lambda i, n: f"<urn:page:{'null' if i is None else i}:{n}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {name(page, copy)}",
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(keeper, 0)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _packed(pages: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Every page as its compressed response record, with the shard that ``cuts`` (first page, digest and number of each) give it.

    What is shuffled is about a third of the html, and once.
    """
    known = pages.sparkSession.sparkContext.broadcast(cuts)   # SHARDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            rows, held = [], 0
            for page, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = html.encode()
                sha1 = hashlib.sha1(payload).hexdigest()
                record = _record(page, 0, page, url, len(payload), sha1, payload)
                shard = known.value[bisect_right(known.value, (*_place(page), sha1, SHARDS)) - 1][-1]
                rows.append((shard, page, sha1, None, url, len(payload), record))
                held += len(record)
                if held > 8 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")), text_of("html")).mapInArrow(
        run, "_shard int, _id long, _sha1 string, _keeper long, _url string, _bytes long, _record binary")


def _place(page: int | None) -> tuple[bool, int]:
    """Pages in order, null first."""
    return page is not None, page or 0


_PACKED = pa.schema([("_shard", pa.int32()), ("_id", pa.int64()), ("_sha1", pa.string()), ("_keeper", pa.int64()), ("_url", pa.string()),
                     ("_bytes", pa.int64()), ("_record", pa.binary())])


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


class _Roller:
    """Writes a shard's records; a file gets its name only when it is whole."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll_bytes, self.number = shard, attempt, roll_bytes, 0
        self.out = None

    def add(self, record: bytes) -> Iterator[tuple[str, int, int, str]]:
        if self.out is not None and self.size + len(record) > self.roll_bytes:
            yield self.commit()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.path}/{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.records, self.sha1 = self.store.open_output_stream(self.temporary), 0, 0, hashlib.sha1()
        self.out.write(record)
        self.sha1.update(record)
        self.size, self.records = self.size + len(record), self.records + 1

    def commit(self) -> tuple[str, int, int, str]:
        """Another attempt at this task writes the same bytes, so whichever name lands last is right."""
        self.out.close()
        final = f"{self.path}/{self.name}"
        try:
            self.store.move(self.temporary, final)
        except OSError:  # a store that does not replace: the file of an earlier attempt stays
            if self.store.get_file_info(final).size != self.size:
                raise
            self.store.delete_file(self.temporary)
        self.out, self.number = None, self.number + 1
        return self.name, self.records, self.size, self.sha1.hexdigest()


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> None:
    """Write every page as a record to ``folder``/part-SHARD-NUMBER.warc.gz, with ``folder``/manifest.

    Of equal payloads the largest page_id is the response (of repeated rows the first), the others
    revisit it; null html is an empty payload, a null page_id sorts first and is never preferred.  A task
    writes whole shards in page order under temporary names and renames each full file; the manifest,
    committed last by Spark, lists what belongs to the archive.  File names and bytes depend on the rows only.
    """
    fs_, path = fs.FileSystem.from_uri(folder)
    fs_.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        roller, last, copy, keepers, done = None, None, 0, {}, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard, page, sha1, keeper, url, size, record = row
                if record is None:   # stands before the records it speaks of
                    keepers = {(page, sha1): keeper}
                    continue
                keeper = keepers.get((page, sha1), page)
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        done.append(roller.commit())
                    roller, last = _Roller(folder, shard, attempt, roll_bytes), None
                copy = copy + 1 if last == (page, sha1) else 0
                last = (page, sha1)
                if page != keeper or copy:
                    record = _record(page, copy, keeper, url, size, sha1, None)
                done.extend(roller.add(record))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "sha1"), d, strict=True)) for d in done], _SCHEMA)
                done = []
        if roller is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "sha1"), roller.commit(), strict=True))], _SCHEMA)

    placed = plan(pages, shard_bytes)
    first = F.min(F.struct(F.col("_id").isNotNull().alias("known"), F.coalesce("_id", F.lit(0)).alias("id"), "_sha1"))
    cuts = placed.groupBy("_shard").agg(first.alias("first")).orderBy("_shard").collect()
    shards = [(c.first.known, c.first.id, c.first._sha1, c._shard) for c in cuts]
    told = placed.filter("_keeper IS NOT NULL").select(
        "_shard", "_id", "_sha1", "_keeper", F.lit(None).cast("string").alias("_url"), F.lit(None).cast("long").alias("_bytes"),
        F.lit(None).cast("binary").alias("_record"))
    tasks = shards[-1][-1] + 1 if shards else 1
    ordered = _packed(pages, shards).union(told).repartitionById(tasks, "_shard").sortWithinPartitions(
        "_shard", "_id", "_sha1", F.col("_record").isNotNull(), "_url")
    ordered.select("_shard", "_id", "_sha1", "_keeper", "_url", "_bytes", "_record").mapInArrow(run, _MANIFEST).write.mode(
        "overwrite").json(f"{folder}/manifest")


_SCHEMA = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def _records(content: bytes) -> Iterator[tuple]:
    """(page, url, bytes, digest, type, refers_to, payload) of each record; digests are checked."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    page_of = lambda urn: None if (i := urn.split(":")[2]) == "null" else int(i)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head['WARC-Record-ID']} does not end")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        found = base64.b32encode(hashlib.sha1(block).digest()).decode()
        if found != head["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"record {head['WARC-Record-ID']} differs from its digest")
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
        yield page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, refers, payload


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the files in the manifest; one file is read at a time and its digest is checked.

    Files that are not in the manifest (of failed attempts) are left out; a file that is missing, cut or
    changed fails the read.  ``payload`` is null for revisits, and for all records without ``payloads``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, sha1, file in zip(*[batch.column(c).to_pylist() for c in ("content", "sha1", "file")], strict=True):
                if hashlib.sha1(content).hexdigest() != sha1:
                    raise ValueError(f"{file} is not what the manifest names")
                rows, held = [], 0
                for *fields, payload in _records(content):
                    keep = payload if payloads and fields[4] == "response" else None
                    rows.append((*fields, keep))
                    held += len(keep or b"")
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").select("file", "sha1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    missing = manifest.join(files.select("file"), "file", "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"the manifest names files that are not there: {[m.file for m in missing]}")
    return files.join(manifest, "file").select("file", "sha1", "content").mapInArrow(run, _RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder beside the checkpoints and read them back, without the payloads."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder, payloads=False).drop("payload", "url")


# DuckDB has SHA-1 in hex only; base32 is spelt out over its 160 bits.
ARCHIVE_SQL = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s FROM d),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(8), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(s, 5 * g + 1, 5))::BIGINT >> (20 - 5 * (k + 1))) & 31)::INT + 1, 1))[1:4], '')), '') AS x
      FROM s)
SELECT page_id, n AS payload_bytes, x AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY s) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER (PARTITION BY s) THEN max(page_id) OVER (PARTITION BY s) END AS refers_to
FROM b"""
