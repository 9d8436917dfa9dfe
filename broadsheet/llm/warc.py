"""A deterministic sharded writer of WARC archives, and a reader.

Pages are dealt to shards by ranges of their id, cut by bytes, and sorted within; an id
with more bytes than a shard is split further by digest.  A task
writes its shard as ``.warc.gz`` files, one gzip member a record, and begins a
new file when the compressed size passes a limit.  All headers and digests are
made anew.  Files are written under names that carry the attempt; the names of
attempts that succeeded are kept in a checkpoint, a second job renames those
files, and a manifest (written and committed by Spark) lists what belongs to
the archive.  A task that is lost or run twice leaves at most an unlisted file.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
largest id is a ``response``, the others are ``revisit`` records that refer to
it.  Which pages are revisits travels to the shards as rows without payloads,
so payloads are shuffled once, by id range, and a large group of equal payloads
never meets in one task.

Defined results: a null payload is empty; a null url is written as
``urn:x-no-url``.  Null ids are sorted first and smaller than any other.  Rows
that repeat the id of a response are responses too.  An empty table gives an
archive without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, range_bounds, range_part

MIN_BYTES = 0
#: Compressed bytes at which a file is full.
ROLL_BYTES = 8 << 20
#: A shard has about so many ids, and payloads of at most about so many bytes, unless that makes too many shards:
#: several files' worth, which one task writes as a stream.
SHARD_ROWS, SHARD_BYTES, MOST_SHARDS = 16_384, 128 << 20, 65_536
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FILES = "shard int, number int, temporary string, name string, records long, bytes long, sha1 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(page_id: int | None, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}:{turn}'.encode()).digest()[:16], version=5)}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, turn: int = 0, date: str = DATE) -> bytes:
    """A response record or, with ``refers_to``, a revisit record."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_uuid(page_id, digest, turn)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:x-no-url"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uuid(refers_to, digest, 0)), ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _record(headers, block)


def info_record(name: str, date: str = DATE) -> bytes:
    block = b"software: broadsheet\r\nformat: WARC File Format 1.1\r\n"
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_uuid(None, name, 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _record(headers, block)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class _Roller:
    """Writes one shard's records to files of about ``roll_bytes`` compressed bytes."""

    def __init__(self, out_dir: str, shard: int, roll_bytes: int, attempt: str):
        self.store, self.root = fs.FileSystem.from_uri(out_dir)
        self.shard, self.roll_bytes, self.attempt = shard, roll_bytes, attempt
        self.done: list[dict] = []
        self.out = None

    def write(self, record: bytes) -> None:
        if self.out is None:
            number = len(self.done)
            name = f"part-{self.shard:05d}-{number:05d}.warc.gz"
            self.file = {"shard": self.shard, "number": number, "temporary": f"_{name}.{self.attempt}", "name": name, "records": 0, "bytes": 0}
            self.sha1 = hashlib.sha1()
            self.out = self.store.open_output_stream(f"{self.root}/{self.file['temporary']}")
            self._put(info_record(name))
        self._put(record)
        self.file["records"] += 1
        if self.file["bytes"] >= self.roll_bytes:
            self.close()

    def _put(self, record: bytes) -> None:
        data = gzip.compress(record, 6, mtime=0)
        self.out.write(data)
        self.sha1.update(data)
        self.file["bytes"] += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.file | {"sha1": self.sha1.hexdigest()})
            self.out = None


def _write_shards(batches: Iterator[pa.RecordBatch], out_dir: str, roll_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:12]}"
    roller: _Roller | None = None
    done: list[dict] = []
    revisits: dict[str, int] = {}  # of the page at hand, by digest
    page: object = ()
    turn = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "sha1", "refers_to")]
        for shard, page_id, url, payload, sha1, refers_to in zip(*columns):
            if roller is None or roller.shard != shard:
                if roller:
                    roller.close()
                    done += roller.done
                roller, page = _Roller(out_dir, shard, roll_bytes, attempt), ()
            if page != (page_id,):
                page, turn = (page_id,), 0
                revisits.clear()
            if payload is None:
                revisits[sha1] = refers_to
            else:
                roller.write(page_record(page_id, url, payload.encode(), revisits.get(sha1), turn, date))
                turn += 1
    if roller:
        roller.close()
        done += roller.done
    names = ["shard", "number", "temporary", "name", "records", "bytes", "sha1"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in done], t) for n, t in zip(names, types)], names=names)


def _commit(batches: Iterator[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(out_dir)
    for batch in batches:
        for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
            # a repeated attempt finds the file renamed already
            if store.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                store.move(f"{root}/{temporary}", f"{root}/{name}")
        yield batch


def _in_shards(rows: DataFrame, slim: DataFrame, shard_rows: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with their ``shard``, and the number of shards; ``slim`` has ``page_id`` and ``size``.

    Ranges of about ``shard_rows`` ids are cut where the bytes summed along the ids pass a
    multiple of ``shard_bytes``.  An id that alone has more bytes goes by the digests of
    its payloads to shards of its own, after the others.
    """
    ranges = range_bounds(slim, "page_id", shard_rows)
    of_id = checkpoint(slim.groupBy("page_id").agg(F.sum("size").alias("bytes")))
    total = of_id.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    each = max(shard_bytes, total // (MOST_SHARDS // 2) + 1)
    run = Window.partitionBy("range").orderBy(F.col("page_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    light = of_id.where(F.col("bytes") <= each).withColumn("range", range_part(F.col("page_id"), ranges))
    light = light.withColumn("step", F.floor(F.coalesce(F.sum("bytes").over(run), F.lit(0)) / each))
    firsts = light.groupBy("range", "step").agg(F.min("page_id").alias("id")).where("id IS NOT NULL").select("id").collect()
    bounds = sorted(r["id"] for r in firsts)[1:]
    # at most total / each ids
    heavy = [(r["page_id"], -(-r["bytes"] // each)) for r in of_id.where(F.col("bytes") > each).orderBy("page_id").collect()]
    own, shards = [], len(bounds) + 1
    for page_id, parts in heavy:
        own.append((page_id, shards, parts))
        shards += parts
    shard = range_part(F.col("page_id"), bounds)
    if not own:
        return rows.withColumn("shard", shard), shards
    own = F.broadcast(rows.sparkSession.createDataFrame(own, "heavy long, first int, parts int"))
    rows = rows.join(own, F.col("page_id").eqNullSafe(F.col("heavy")), "left")
    split = F.col("first") + F.pmod(F.xxhash64("sha1"), F.col("parts")).cast("int")
    return rows.withColumn("shard", F.coalesce(split, shard)).drop("heavy", "first", "parts"), shards


def write_warc(pages: DataFrame, out_dir: str, id_col="page_id", url_col="url", payload_col="html", min_bytes=MIN_BYTES, roll_bytes=ROLL_BYTES, shard_rows=SHARD_ROWS, shard_bytes=SHARD_BYTES, date=DATE) -> DataFrame:
    """Writes the archive to ``out_dir`` (a new folder that all executors share) and returns its manifest."""
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    slim = checkpoint(page.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")))
    alike = slim.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "refers_to")
    revisits = slim.join(alike, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()

    none = F.lit(None).cast("string")
    rows = page.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(revisits.select("page_id", none.alias("url"), none.alias("payload"), "sha1", "refers_to"))
    rows, shards = _in_shards(rows, slim, shard_rows, shard_bytes)
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", F.col("payload").isNotNull(), "sha1", "url")
    fs.FileSystem.from_uri(out_dir)[0].create_dir(fs.FileSystem.from_uri(out_dir)[1], recursive=True)
    files = checkpoint(rows.mapInArrow(lambda b: _write_shards(b, out_dir, roll_bytes, date), _FILES))
    committed = files.mapInArrow(lambda b: _commit(b, out_dir), _FILES).drop("temporary")
    committed.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return pages.sparkSession.read.parquet(f"{out_dir}/manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a ``.warc.gz`` file."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            chunk = view[at : at + 65_536]
            if not chunk:
                raise ValueError("the file ends within a record")
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = rest[: int(headers["content-length"])]
        if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a whole WARC record")
        yield headers, block


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda s: None if s is None else int(s)
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
            rows: list[tuple] = []
            for headers, block in records(content.as_buffer()):
                if headers["warc-type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(next(v for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")) if k.lower() == "content-length"))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                    raise ValueError(f"a payload in {name} is not what its header says")
                rows.append((number(headers.get("x-page-id")), length, digest, headers["warc-type"], number(headers.get("x-refers-to-page-id")), headers["warc-target-uri"], name))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "file"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def read_warc(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per response or revisit record of the files that the manifest lists.

    Payloads are checked against their digests; a revisit's length and digest
    are those of its own headers.
    """
    listed = spark.read.parquet(f"{out_dir}/manifest").select("name")
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(out_dir)
    files = files.withColumn("name", F.substring_index("path", "/", -1)).join(broadcast_if_small(listed), "name", "left_semi").select("name", "content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, file string"
    return files.mapInArrow(_read_files, schema)
