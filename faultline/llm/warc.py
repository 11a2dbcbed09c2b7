"""Dictionary-compressed WARC archives.

Each task writes files of bounded size: a Zstandard dictionary built from the file's own first records leads the file
in a skippable frame, and every record is a frame of its own, so a record can be read knowing only its place and the
dictionary. Equal payloads are stored once, as a response; the others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, in_batches

REVISIT_BYTES = 1000
#: Bytes of records in one file, records' bytes that a dictionary is built from, and of the dictionary.
FILE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 4 << 20, 64 << 10
SKIPPABLE = 0x184D2A5D
#: Bytes that the reader hands on first of what may hold several records.
PIECE_BYTES = 4096
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, digest: str, revisit: bool) -> bytes:
    """A WARC 1.1 record. A revisit has headers only; the length and digest of its payload stand among them."""
    number = "" if page_id is None else str(page_id)
    target = urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{number}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += [f"Content-Type: {'message/http' if revisit else 'application/http;msgtype=response'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the start of the samples if they are too few to train on; empty without samples."""
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: min(size, total // 8)]


def pack(records: list[bytes], dictionary: bytes) -> list[bytes]:
    """The records, each a frame of its own."""
    import zstandard

    made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return [made.compress(r) for r in records]


def unpack(archive: bytes):
    """The records of an archive, one by one."""
    import zstandard

    if not archive:
        return
    magic, size = struct.unpack("<II", archive[:8])
    if magic != SKIPPABLE:
        raise ValueError("the file doesn't start with its dictionary")
    dictionary, at = archive[8 : 8 + size], 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(archive):
        # fed in growing pieces: what is left of a piece is copied, never the rest of the file
        frame, data, piece = reader.decompressobj(), [], PIECE_BYTES
        while not frame.eof and at < len(archive):
            data.append(frame.decompress(archive[at : at + piece]))
            at, piece = min(len(archive), at + piece), 2 * piece
        if not frame.eof:
            raise ValueError("the file ends within a record")
        at -= len(frame.unused_data)
        yield b"".join(data)


def _write(folder: str):
    """Writes files under names of the attempt. Only the rows of attempts that Spark accepts name files to be read."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            sample, n = [], 0
            for r in held:
                if n >= SAMPLE_BYTES:
                    break
                sample.append(r)
                n += len(r)
            dictionary = build_dictionary(sample)
            name = f"part-{part:06d}-{attempt}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                for frame in pack(held, dictionary):
                    out.write(frame)
            done = (name, len(held))
            held, size, number = [], 0, number + 1
            return done

        files = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "digest", "revisit")]
            for row in zip(*columns, strict=True):
                made = record(*row)
                held.append(made)
                size += len(made)
                if size >= FILE_BYTES:
                    files.append(flush())
        if held:
            files.append(flush())
        if files:
            yield pa.record_batch([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], names=["file", "records"])

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, revisit, refers_to of each page.

    Payloads of REVISIT_BYTES or more that are equal (by SHA-256) have one response, the page with the largest id;
    null ids count as the smallest. Rows that share the largest id with equal payloads are all responses. Only the
    digests and the largest ids are grouped, summed up before the shuffle; pages find their group by joining it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.when(F.length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)))
    largest = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("key", "largest")
    # pages without a key are dealt out by their own bits, not all to one task
    rows = rows.withColumn("dealt", F.coalesce("key", F.concat_ws(":", "digest", F.xxhash64("page_id", "url").cast("string"))))
    joined = rows.join(largest.withColumnRenamed("key", "dealt"), "dealt", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages to *.warc.zst under the folder (a URI that all executors share); one row per file: file, records.

    The result is kept as a table beside the archives: it lists the files that count. Those of lost or repeated attempts
    may lie beside them.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return Scratch(pages.sparkSession, "warc-files").keep(plan_records(pages).transform(in_batches).mapInArrow(_write(folder), "file string, records bigint"), "files")


def _read(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for data in unpack(content.as_py()):
                f = parse(data)
                kind = f["WARC-Type"]
                digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and (hashlib.sha1(f["payload"]).hexdigest() != digest or len(f["payload"]) != int(f["WARC-Payload-Length"])):
                    raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
                number = {k: f[k][len("<urn:page:") : -1] if k in f else "" for k in ("WARC-Record-ID", "WARC-Refers-To")}
                rows.append([int(number["WARC-Record-ID"]) if number["WARC-Record-ID"] else None, urllib.parse.unquote(f["WARC-Target-URI"]), f["payload"] if kind == "response" else None, int(f["WARC-Payload-Length"]), digest, kind, int(number["WARC-Refers-To"]) if number["WARC-Refers-To"] else None])
                if sum(len(r[2] or b"") for r in rows[-1:]) + len(rows) > 4096:
                    yield _records(rows)
                    rows = []
            yield _records(rows)


_TYPES = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _records(rows):
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_TYPES)], names=[n for n, _ in _TYPES])


def read_archives(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each record.

    written: the files that count, by name, as write_archives returns them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(written.select("file"), "file", "left_semi")
    return files.select("content").transform(in_batches).mapInArrow(_read, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op9(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back, and returns one row per page."""
    spark = pages.sparkSession
    folder = f"{Scratch(spark, 'warc').path}-{uuid.uuid4().hex[:8]}"
    written = write_archives(pages, folder)
    if written.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_archives(spark, folder, written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html AS h, max(page_id) AS largest FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p LEFT JOIN g ON p.html = g.h
"""
