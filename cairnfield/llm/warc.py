"""WARC archives: a writer with revisit records, and a salvage reader.

Archives hold one gzip member per record (or plain records, which the reader also takes).
The reader checks each record: member checksum, version line, headers, block length and
block digest. After a failed check it searches for the next gzip member or version line,
goes on there, and reports the bytes in between as a quarantined gap. Headers may be of any length: they are read
to their blank line, and given up at the first line that is no header.

A task may run again or twice, and its rows may then come in another order, so every attempt names its archives
anew and the manifest, a table that Spark commits, lists those that count. The reader leaves the others out.

Defined cases: a null payload is empty; a null url is left out, and white space and control characters in one are written
percent-encoded; urls and payloads of any length that a column holds are written and read back whole (a record that unpacks to more than
``max_record``, 2 GiB and 64 MB, is a gap: no column could hold it); repeated rows give repeated records (all of the largest
page_id are responses); an empty table gives no archive and no rows; a null page_id is
written as ``null`` and read back as null; other columns are ignored, and ``mark_revisits`` replaces those called like its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_up_to, free_name, materialize, shared_dir, table

VERSION = b"WARC/1.0"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: A column's longest value, and room for headers.
MAX_RECORD = (2 << 30) + (64 << 20)

RECORDS = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap_bytes", pa.int64()), ("problem", pa.string())])


def _b32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _hex(digest: str) -> str | None:
    if digest.startswith("sha1:") and len(digest) == 37:
        try:
            return base64.b32decode(digest[5:]).hex()
        except ValueError:
            return None
    return None


def record_bytes(record_id: str, uri: str | None, payload: bytes, sha1_hex: str, refers_to_id: str | None) -> bytes:
    """One record, not yet compressed. A revisit keeps digest and length of the payload but not its bytes."""
    head = [b"WARC/1.0", b"WARC-Type: " + (b"revisit" if refers_to_id else b"response"), b"WARC-Record-ID: <" + record_id.encode() + b">"]
    if uri:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri).encode())
    if refers_to_id:
        head.append(b"WARC-Refers-To: <" + refers_to_id.encode() + b">")
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
    block = b"" if refers_to_id else payload
    head += [b"WARC-Payload-Digest: " + _b32(sha1_hex).encode(), b"WARC-Payload-Length: %d" % len(payload)]
    head += [b"WARC-Block-Digest: " + _b32(sha1_hex if not refers_to_id else hashlib.sha1(b"").hexdigest()).encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Source:
    """A window over a stream of bytes: grows on demand, drops what was used."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk, self.data, self.base, self.ended = stream, chunk, bytearray(), 0, False

    def fill(self, size: int) -> bool:
        while len(self.data) < size and not self.ended:
            more = self.stream.read(max(self.chunk, size - len(self.data)))
            self.ended = not more
            self.data += more
        return len(self.data) >= size

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n


def _parse(head: bytes) -> dict[str, str] | None:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _checked(head: dict[str, str] | None, block: bytes) -> str:
    if head is None:
        return "bad headers"
    want = _hex(head.get("warc-block-digest", ""))
    return "block digest differs" if want and hashlib.sha1(block).hexdigest() != want else ""


def _member(src: _Source, max_record: int) -> tuple[int, dict | None, bytes, str]:
    """Read the gzip member at the window's start: its length, headers, block and problem."""
    inflate, out, used = zlib.decompressobj(31), bytearray(), 0
    while not inflate.eof:
        if not src.fill(used + 1):
            return 0, None, b"", "member ends early"
        piece = bytes(src.data[used : used + src.chunk])
        try:
            out += inflate.decompress(piece)
        except zlib.error as e:
            return 0, None, b"", f"gzip: {e}"
        used += len(piece) - len(inflate.unused_data)
        if len(out) > max_record:
            return 0, None, b"", "record too long"
    cut = out.find(b"\r\n\r\n")
    head = _parse(bytes(out[:cut])) if cut >= 0 else None
    length = (head or {}).get("content-length", "")
    if not length.isdigit() or len(out) != cut + 4 + int(length) + 4 or out[-4:] != b"\r\n\r\n":
        return used, None, b"", "bad headers" if head is None else "block length differs"
    block = bytes(out[cut + 4 : -4])
    return used, head, block, _checked(head, block)


def _plain(src: _Source, max_record: int) -> tuple[int, dict | None, bytes, str]:
    at = 0
    while True:  # line by line to the blank one
        end = src.data.find(b"\r\n", at)
        if end < 0:
            if len(src.data) > max_record or not src.fill(len(src.data) + 1):
                return 0, None, b"", "bad headers"
            continue
        if end == at:
            break
        if at and b":" not in src.data[at:end]:
            return 0, None, b"", "bad headers"
        at = end + 2
    cut = at - 2
    head = _parse(bytes(src.data[:cut]))
    length = (head or {}).get("content-length", "")
    if not length.isdigit():
        return 0, None, b"", "bad headers"
    size = cut + 4 + int(length) + 4
    if int(length) > max_record or not src.fill(size) or src.data[size - 4 : size] != b"\r\n\r\n":
        return 0, None, b"", "block length differs"
    block = bytes(src.data[cut + 4 : size - 4])
    return size, head, block, _checked(head, block)


def _opened(path: str):
    """An Arrow file system and the path in it; s3a and s3n are Hadoop's names of s3."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def salvage(stream, max_record: int = MAX_RECORD) -> Iterator[tuple]:
    """Yield (offset, 'record', headers, block) and (offset, 'gap', bytes, problem) over an archive.

    Memory: one record and one read chunk.
    """
    src, gap_at, problem = _Source(stream), None, ""
    while src.fill(1):
        found = _START.match(src.data) if src.fill(12) or src.data else None
        size = 0
        if found:
            at = src.base
            size, head, block, wrong = (_member if src.data[0] == 0x1F else _plain)(src, max_record)
            if not wrong:
                if gap_at is not None:
                    yield gap_at, "gap", at - gap_at, problem
                    gap_at = None
                yield at, "record", head, block
                src.drop(size)
                continue
        else:
            wrong = "no record starts here"
        if gap_at is None:
            gap_at, problem = src.base, wrong
        src.drop(size or 1)
        while True:  # the next place where a record may start
            src.fill(12)
            after = _START.search(src.data)
            if after or src.ended:
                src.drop(after.start() if after else len(src.data))
                break
            src.drop(max(0, len(src.data) - 11))
            src.fill(len(src.data) + src.chunk)
    if gap_at is not None:
        yield gap_at, "gap", src.base - gap_at, problem


def mark_revisits(pages: DataFrame, payload: str = "html", key: str = "page_id", min_bytes: int = 1000) -> DataFrame:
    """Add payload_digest, payload_bytes and refers_to (null: a response).

    Groups of equal payloads are found from digests alone; only those with two rows or more
    are kept as a table, whose written size lets Spark choose between a broadcast and a join
    that it splits where skewed.
    """
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    first, count = free_name(pages, "first"), free_name(pages, "count")
    pages = pages.drop("payload_digest", "payload_bytes", "refers_to")
    digested = pages.withColumns({"payload_digest": F.sha1(data), "payload_bytes": F.octet_length(data).cast("long")})
    groups = digested.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(key).alias(first), F.count(F.lit(1)).alias(count))
    groups = materialize(groups.where(F.col(count) > 1).drop(count), "groups")
    big = F.col("payload_bytes") >= min_bytes
    return digested.join(groups, "payload_digest", "left").withColumn("refers_to", F.when(big & (F.col(key) < F.col(first)), F.col(first))).drop(first)


def write_archives(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str = "url", archive_bytes: int = 16 << 20) -> DataFrame:
    """Write one record per row below ``folder`` and return a manifest (archive, records, bytes).

    Each task writes archives of about ``archive_bytes``. A name holds the partition, a number and a mark of the attempt; only
    archives that the manifest lists are committed (see read_archives). The store must be one that Arrow writes to.
    """
    rows = pages.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload"), "payload_digest", F.col("refers_to").cast("string").alias("refers"))
    token = folder.rstrip("/").rsplit("/", 1)[-1]

    def write(batches):
        from pyspark import TaskContext

        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        part, n, out, made, size, count, attempt = TaskContext.get().partitionId(), 0, None, [], 0, 0, uuid.uuid4().hex

        def close():
            out.close()
            made.append((name, count, size))

        for batch in batches:
            for id_, uri, text, sha, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    name = f"{token}-{part:06d}-{n:04d}-{attempt}.warc.gz"
                    out, size, count, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0, n + 1
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                record = record_bytes(f"urn:page:{id_}", uri, (text or "").encode(), sha, refers and f"urn:page:{refers}")
                member = deflate.compress(record) + deflate.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x)) for x in made], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(rows.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, stream_bytes: int = 128 << 20, glob: str = "*.warc*", manifest: DataFrame | None = None) -> DataFrame:
    """The records and gaps of all archives below ``folder`` (see RECORDS), or of those that the manifest lists.

    Archives up to ``stream_bytes`` come through Spark's binaryFile source, from any store
    that Spark reads; larger ones are streamed by their path, so memory holds one record. Archives of attempts that were not
    committed are few; their names are found without reading contents, and taken out by a join.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if manifest is not None:
        name = F.substring_index("path", "/", -1)
        orphans = materialize(files.select("path", name.alias("archive")).join(manifest.select("archive"), "archive", "left_anti").select("path"), "orphans")
        if orphans.limit(1).count():
            files = files.join(broadcast_up_to(orphans, 100_000), "path", "left_anti")
    small = files.where(F.col("length") <= stream_bytes).select("path", "content")
    large = files.where(F.col("length") > stream_bytes).select("path", F.lit(None).cast("binary").alias("content"))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i]
                if content.is_valid:
                    stream = pa.BufferReader(content.as_buffer())
                else:
                    fs, at = _opened(path)
                    stream = fs.open_input_stream(at)
                rows, size = [], 0
                for offset, kind, a, b in salvage(stream):
                    row = {"archive": path, "offset": offset, "kind": kind}
                    if kind == "gap":
                        row |= {"gap_bytes": a, "problem": b}
                    else:
                        sha = hashlib.sha1(b).hexdigest()
                        revisit = a.get("warc-type") == "revisit"
                        length = a.get("warc-payload-length", "")
                        row |= {"record_type": a.get("warc-type"), "record_id": a.get("warc-record-id", "").strip("<>"), "target_uri": a.get("warc-target-uri"), "refers_to_id": a.get("warc-refers-to", "").strip("<>") or None, "payload_digest": (_hex(a.get("warc-payload-digest", "")) if revisit else sha), "payload_bytes": (int(length) if length.isdigit() else None) if revisit else len(b), "payload": b if with_payload and not revisit else None}
                        size += len(b) if with_payload else 0
                    rows.append(row)
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    ddl = "archive string, offset long, kind string, record_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary, gap_bytes long, problem string"
    return small.unionByName(large).mapInArrow(read, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_dir(spark) + "/warc"
    manifest = write_archives(mark_revisits(pages), folder)
    read = read_archives(spark, folder, with_payload=False, manifest=manifest).where("kind = 'record'")
    return read.select(F.expr("try_cast(regexp_extract(record_id, '^urn:page:(-?[0-9]+)$', 1) AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(regexp_extract(refers_to_id, '^urn:page:(-?[0-9]+)$', 1) AS BIGINT)").alias("refers_to"), "target_uri")
