"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

write_archives() makes files of pages, which Spark's binaryFile source reads as rows (path, content); read_archives() walks
their frames and checks every header and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path
from .text import pieces

#: Magic numbers of the dictionary's skippable frame, of the first of sixteen kinds of skippable frames and of a Zstandard frame (fixed by the formats).
SKIPPABLE, ANY_SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: An empty skippable frame, which all readers pass over: Spark's text writer ends each file with it in place of a line break.
END = struct.pack("<II", ANY_SKIPPABLE, 0).decode("ascii")
#: Payloads below this many bytes are always stored in full.
LEAST = 1000
#: Bytes of the records of one archive from which the next begins; sample and size of an archive's dictionary; rows and bytes that a
#: task gives out at once when it reads.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 64 << 20, 1 << 20, 32 << 10
OUT_BYTES, OUT_ROWS = 4 << 20, 5000
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page: dict, alone: str) -> bytes:
    """The record of one page; `alone` makes the id of a page without one. A revisit's block holds the HTTP header alone, with the length of the full payload."""
    payload, revisit = page["html"] or "", page["refers_to"] is not None
    payload = payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = "".join(c for c in page["url"] or "urn:none" if c >= " ") or "urn:none"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page['page_id']}>" if page["page_id"] is not None else f"<urn:nopage:{alone}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{base32(hashlib.sha1(payload).hexdigest())}",
        "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{page['refers_to']}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive:
    """An archive that grows record by record; its dictionary is learned from the first ones."""

    def __init__(self, first: list[bytes]):
        import zstandard as zstd

        sample, size = [], 0
        for r in first:
            if size >= SAMPLE_BYTES:
                break
            sample.append(r[: 64 << 10])
            size += len(sample[-1])
        try:
            words = zstd.train_dictionary(DICT_BYTES, sample).as_bytes() if len(sample) >= 16 and size >= 8 * DICT_BYTES else b"".join(sample)[:DICT_BYTES]
        except zstd.ZstdError:  # samples too much alike to learn from: their beginning is a dictionary too
            words = b"".join(sample)[:DICT_BYTES]
        self.make = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
        self.frames, self.size = [struct.pack("<II", SKIPPABLE, len(words)), words], 0

    def add(self, record: bytes) -> None:
        self.frames.append(self.make.compress(record))
        self.size += len(record)

    def content(self) -> bytes:
        return b"".join(self.frames)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends: its header, then blocks by their lengths, then the checksum."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("a frame has a block of a reserved kind")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            at += 4 * checksum
            if at > len(data):
                raise ValueError("a frame is cut off")
            return at


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; ValueError where a header, a length or a digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as Content-Length says")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block's digest is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not gap or len(lengths) != 1 or not lengths[0].isdigit():
        raise ValueError("the HTTP header is wrong")
    if fields["warc-type"] == "response":
        if len(payload) != int(lengths[0]):
            raise ValueError("the payload is not as long as its HTTP header says")
        if fields.get("warc-payload-digest") != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError("the payload's digest is wrong")
    elif fields["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit has a payload or refers to nothing")
    else:
        raise ValueError(f"unknown type {fields['warc-type']}")
    return {"fields": fields, "payload_bytes": int(lengths[0]), "payload": payload}


def records(data: bytes) -> Iterator[dict]:
    """The records of an archive. A dictionary that is itself a Zstandard frame is decompressed first."""
    import zstandard as zstd

    view, at, read = memoryview(data), 0, zstd.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if len(data) >= at + 8 else 0
        if magic & ~0xF == ANY_SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if end > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == SKIPPABLE:  # also that of another archive behind the first
                words = bytes(view[at + 8 : end])
                if words[:4] == struct.pack("<I", FRAME):
                    words = zstd.ZstdDecompressor().decompress(words)
                read = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words)) if words else zstd.ZstdDecompressor()
            at = end
            continue
        end = frame_end(view, at)
        frame = view[at:end]
        size = zstd.frame_content_size(frame)
        raw = read.decompress(frame) if size >= 0 else b"".join(read.read_to_iter(bytes(frame)))
        if 0 <= size != len(raw):
            raise ValueError("a frame's content is not as long as its header says")
        yield parse(raw)
        at = end


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and refers_to: for a payload of at least `least` bytes that a larger page_id has too, the largest one.

    Payloads are compared by SHA-1 and length. Only the digests are grouped; the few that repeat join back, and where one
    payload has a great share of the rows, adaptive execution splits that side of the join.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    again = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(again, ["digest", "size"], "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Files *.warc.zst of pages (page_id, url, html, refers_to) under `path`, read back as rows (path, content).

    Each row of a task's output is a file of its own, written by Spark's committer, so a lost task leaves no half archive. The driver
    renames the files, one for ARCHIVE_BYTES of records. Pages that share a page_id share a record id.
    """
    from pyspark import TaskContext

    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, now = TaskContext.get().partitionId(), 0, None
        out = lambda a: pa.RecordBatch.from_arrays([pa.array([a.content()], pa.binary())], ["content"])
        for batch in pieces(batches, "html"):
            records = [record(page, f"{task}-{n + k}") for k, page in enumerate(batch.to_pylist())]
            n += len(records)
            for k, r in enumerate(records):
                now = now or Archive(records[k:])
                now.add(r)
                if now.size >= ARCHIVE_BYTES:
                    yield out(now)
                    now = None
        if now:
            yield out(now)

    # bytes pass through the text writer as they are
    pages.mapInArrow(run, "content binary").select(F.col("content").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(Path(f"{path}/part-*.txt")):
        old = status.getPath()
        if not fs.rename(old, Path(old.getParent(), old.getName().removesuffix(".txt") + ".warc.zst")):
            raise OSError(f"{old} was not renamed")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, content), each checked; a damaged archive raises an error that names it.

    payload_digest is as the header says in lower-case hex, payload_bytes the full payload's length also for a revisit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if with_payload else {})

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

        def number(name: str | None) -> int | None:
            return int(name[10:-1]) if name and name.startswith("<urn:page:") else None

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                try:
                    for r in records(data.as_buffer().to_pybytes()):
                        f = r["fields"]
                        rows.append((path, number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], number(f.get("warc-refers-to")), r["payload_bytes"], base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex(), *([r["payload"]] if with_payload else [])))
                        size += len(r["payload"]) * with_payload
                        if size > OUT_BYTES or len(rows) >= OUT_ROWS:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield out(rows)

    schema = "path string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return archives.select("path", "content").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null html is an empty payload, a null url `urn:none`; a null page_id is never referred to and is a response.

    Rows that are repeated with their page_id and payload are all responses, or all revisits of a larger page_id. No pages
    give no archive and no rows; columns of pages other than page_id, url and html are left out.
    """
    archives = write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), new_path(spark, "warc"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
     f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to FROM f
"""
