"""WARC archives as a table of chunks: written from one, read into one, with running digests."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, sieved, stored, table, tasks

#: Bytes of a chunk, of an archive before the next one begins, and of a record's head at most.
CHUNK, ARCHIVE, HEAD = 1 << 16, 1 << 28, 1 << 20
#: Payloads of fewer bytes are written again rather than referred to.
LEAST = 1000
#: Fixed values of the format.
VERSION, LINE, ENDED, PROFILE = "WARC/1.1", "\r\n", b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# --- which record holds a payload ----------------------------------------------------------------


def records_of(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, payload) as records: page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to.

    Of rows with equal payloads of `least` bytes or more those with the largest page_id are responses; the others
    revisit it and hold no payload. A null id is smaller than any other. Copies are counted in salted parts, each of
    which learns the largest id, so the rows of one payload are met in as many tasks as they were counted in.
    Payloads are not shuffled, but for rows that a bounded sieve takes for revisits: those are looked up exactly."""
    salt = F.pmod(F.xxhash64("page_id"), F.lit(max(64, tasks(pages.sparkSession)))).cast("int")
    whole = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    key, same = ["payload_digest", "payload_bytes"], F.xxhash64("page_id", "payload_digest").alias("rid")
    slim = whole.filter(F.col("payload_bytes") >= least).select("page_id", "url", *key, salt.alias("salt"), same)
    parts = slim.groupBy(*key, "salt").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    groups = parts.groupBy(*key).agg(F.sum("n").alias("n"), F.max("top").alias("refers_to")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    told = parts.select(*key, "salt").join(groups.hint("merge"), key)
    revisits = stored(slim.join(told.hint("merge"), [*key, "salt"]).filter("page_id IS NULL OR page_id < refers_to").drop("salt"))

    looked = sieved(whole.withColumn("rid", same), "rid", revisits)
    gone = revisits.select(F.col("rid").alias("_rid"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).distinct()
    is_gone = (F.col("rid") == F.col("_rid")) & F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    kept = looked.filter("NOT maybe").unionByName(looked.filter("maybe").join(gone.hint("merge"), is_gone, "left_anti")).drop("rid", "maybe")
    kept = kept.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    return kept.unionByName(revisits.drop("rid").withColumn("payload", F.lit(b"")).withColumn("record_type", F.lit("revisit")).select(kept.columns))


# --- writing -------------------------------------------------------------------------------------


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE)) for name, value in fields])


def _record_id(page: Column, digest: Column) -> Column:
    x = F.md5(F.concat_ws(":", page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(x, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def heads(records: DataFrame) -> DataFrame:
    """records with head: the WARC header and the HTTP header of each. A revisit keeps the HTTP header of its
    response, which tells the payload's length, and nothing after it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(LINE * 2))
    page, digest, to = F.col("page_id"), F.col("payload_digest"), F.col("refers_to")
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _record_id(page, digest)),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("WARC-Profile", F.when(to.isNotNull(), F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(to.isNotNull(), _record_id(to, digest))),
        ("Page-ID", page),
        ("Refers-To-Page-ID", to),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.octet_length("payload")),
    ]
    return records.withColumn("head", F.concat(F.lit(VERSION + LINE), _lines(*fields), F.lit(LINE), http))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share (file:, hdfs:, s3: and others that Arrow opens)."""
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Writes records (head, payload) into .warc.gz files of the folder, a gzip member each, and returns the table of
    the archives: archive, records, bytes.

    Spark cuts payloads into rows of a chunk, in order, and the task streams these into its file, so Python never
    holds a whole payload. Files are named by the attempt of the task; only those in the returned table, which is
    stored when all tasks have ended, count. What lost or repeated tasks leave is in no table."""
    last = F.floor((F.greatest(F.octet_length("payload"), F.lit(1)) - 1) / chunk).cast("int")
    rows = records.select("head", "payload", last.alias("last")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(F.when(F.col("chunk") == 0, F.col("head")).alias("head"), F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"), (F.col("chunk") == F.col("last")).alias("last"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (store, top) = TaskContext.get(), filesystem(folder)
        out, done, member = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["head"] is not None:
                    if out is None or out.tell() >= archive:
                        if out is not None:
                            done[-1][2] = out.tell()
                            out.close()
                        else:
                            store.create_dir(top, recursive=True)
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                        done.append([f"{folder}/{name}", 0, 0])
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(member.compress(row["head"].encode()))
                    done[-1][1] += 1
                out.write(member.compress(row["data"]))
                if row["last"]:
                    out.write(member.compress(ENDED) + member.flush())
        if out is not None:
            done[-1][2] = out.tell()
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(rows.mapInArrow(write, "archive string, records long, bytes long"))


# --- reading -------------------------------------------------------------------------------------


def pieces(stream, size: int) -> Iterator[bytes]:
    """The content of a file, plain or of gzip members, in pieces of `size` bytes at most."""
    block = stream.read(size)
    if block[:2] != b"\x1f\x8b":
        while block:
            yield block
            block = stream.read(size)
        return
    member = zlib.decompressobj(31)
    while block:
        if member.eof:
            member = zlib.decompressobj(31)
        if piece := member.decompress(block, size):
            yield piece
        block = (member.unused_data if member.eof else member.unconsumed_tail) or stream.read(size)
    if not member.eof:
        raise EOFError("the archive ends inside a gzip member")


class Tape:
    """Pieces as one run of bytes of which a bounded part is held."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.held, self.at = source, b"", 0

    def more(self) -> bool:
        piece = next(self.source, None)
        self.held, self.at = self.held[self.at :] + (piece or b""), 0
        return piece is not None

    def head(self, limit: int) -> bytes | None:
        """Bytes up to and with the next blank line, `limit` at most; None at the end."""
        while (end := self.held.find(ENDED, self.at)) < 0 and len(self.held) - self.at < limit:
            if not self.more():
                if len(self.held) > self.at:
                    raise EOFError("the archive ends inside a record's head")
                return None
        end = min(end + 4, self.at + limit) if end >= 0 else self.at + limit
        out, self.at = self.held[self.at : end], end
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        while len(self.held) - self.at < n:
            if not self.more():
                raise EOFError("the archive ends inside a record")
        out = self.held[self.at : self.at + n]
        self.at += n
        return out


def chunks_of(tape: Tape, chunk: int) -> Iterator[dict]:
    """The records of a tape as rows of a chunk each. The rows carry how many bytes of the payload there are so far
    and the SHA-1 of these; the first has the heads."""
    record = 0
    while (head := tape.head(HEAD)) is not None:
        if not head.startswith(b"WARC/") or not (length := re.search(rb"(?im)^content-length:\s*(\d+)", head)):
            raise ValueError(f"record {record} has no WARC head")
        left = int(length[1])
        http = tape.head(min(left, HEAD)) if left and re.search(rb"(?im)^content-type:\s*application/http", head) else b""
        left -= len(http)
        digest, size, number = hashlib.sha1(), 0, 0
        while True:
            data = tape.take(min(left, chunk))
            left, size = left - len(data), size + len(data)
            digest.update(data)
            texts = {"head": head.decode("utf-8", "replace"), "http": http.decode("utf-8", "replace")} if not number else {"head": None, "http": None}
            yield {"record": record, "chunk": number, **texts, "data": data, "bytes_so_far": size, "sha1_so_far": digest.hexdigest(), "last": not left}
            number += 1
            if not left:
                break
        if tape.take(4) != ENDED:
            raise ValueError(f"record {record} does not end where its length says")
        record += 1


CHUNKS = "archive string, record long, chunk int, head string, http string, data binary, bytes_so_far long, sha1_so_far string, last boolean"


def read_archives(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the files in archives (archive): archive, record (number in it), chunk, head and
    http (the headers, in a record's first chunk), data, bytes_so_far, sha1_so_far, last.

    A task reads its files one by one in a stream, so its memory holds a few chunks, however long records are. An
    empty payload is one chunk without data. Plain files and gzip members are told apart by themselves. A file that
    ends inside a record, or a record without a head, fails the job. No archives give no rows."""
    kind = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("chunk", pa.int32()), ("head", pa.string()), ("http", pa.string()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = filesystem(name)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in chunks_of(Tape(pieces(stream, chunk)), chunk):
                        rows.append({"archive": name, **row})
                        held += len(row["data"]) + 1000
                        if held >= 64 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return archives.select("archive").repartition(tasks(archives.sparkSession)).mapInArrow(read, CHUNKS)


def field(head: str, name: str) -> Column:
    """A header's value; null where it is not there."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def records(chunks: DataFrame) -> DataFrame:
    """The chunk table by record: archive, record, head, http, n_chunks, payload_bytes, payload_digest (of the payload
    read; of a revisit as its headers have them), record_type, intact. A record is intact if none of its chunks is
    missing and, for a response, bytes and digest are those of its headers."""
    by = chunks.groupBy("archive", "record").agg(F.max("head").alias("head"), F.max("http").alias("http"), F.count("*").alias("n_chunks"), F.max(F.when(F.col("last"), F.col("chunk") + 1)).alias("expected"), F.max("bytes_so_far").alias("read_bytes"), F.max_by("sha1_so_far", "chunk").alias("read_digest"))
    said, length = F.regexp_replace(field("head", "WARC-Payload-Digest"), "^sha1:", ""), field("http", "Content-Length").cast("long")
    kind = field("head", "WARC-Type")
    revisit = kind == "revisit"
    whole = F.coalesce(F.col("expected") == F.col("n_chunks"), F.lit(False)) & F.when(revisit, F.col("read_bytes") == 0).otherwise((F.coalesce(length, F.col("read_bytes")) == F.col("read_bytes")) & (F.coalesce(said, F.col("read_digest")) == F.col("read_digest")))
    return by.select("archive", "record", "head", "http", "n_chunks", F.when(revisit, length).otherwise(F.col("read_bytes")).alias("payload_bytes"), F.when(revisit, said).otherwise(F.col("read_digest")).alias("payload_digest"), kind.alias("record_type"), whole.alias("intact"))


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Writes a record for every row of pages and gives the table of the archives.

    Only the three named columns are read. A null html is an empty payload; a null url leaves the target out, white
    space in it becomes %20; a null id has no Page-ID and is smaller than others. Repeated rows are a record each;
    those with the largest id of their payload are all responses. An empty table writes no archive."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    return write_archives(heads(records_of(source, least)), folder, chunk, archive)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    read = records(read_archives(archive_pages(pages)))
    kind = pages.schema["page_id"].dataType
    return read.select(field("head", "Page-ID").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", field("head", "Refers-To-Page-ID").cast(kind).alias("refers_to"), "intact", "n_chunks")


def oracle() -> str:
    """DuckDB SQL of op12_warc."""
    return f"""WITH p AS (SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= {LEAST} AND page_id < top THEN top END AS refers_to, true AS intact, CASE WHEN payload_bytes < 1 OR payload_bytes >= {LEAST} AND page_id < top THEN 1 ELSE (payload_bytes + {CHUNK - 1}) // {CHUNK} END AS n_chunks FROM m"""
