"""WARC archives: a deduplicating writer and a splittable reader.

Writer: payloads are compared by SHA-256. Of equal payloads of at least
``min_revisit`` bytes the record with the smallest page id is the response and
the others are revisits that name it and carry its digest and size. Every task
writes gzip archives, one member a record, into the shared folder, and only the
files of committed attempts reach the manifest.

Reader: tasks take byte ranges of archives. A task looks for the gzip magic in
its range, tests each candidate by decoding the start of the member, and owns
the records that start inside its range, reading past the end where needed.

Defined cases: a null html is an empty payload; a null id stays null and is never
what a revisit refers to; repeated rows of the smallest id are all responses; a
null url leaves its header out; an empty table gives an empty manifest and no
records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize, scratch_path
from brindle.llm.filters import key_filter, split_rows

MAGIC = b"\x1f\x8b\x08"
_HEADER_END = b"\r\n\r\n"
#: Payloads that together fit a task's memory easily are held at once; files roll over at this size.
FILE_BYTES = 256_000_000


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def mark_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each page; a revisit has no payload.

    Payloads of digests that occur once are never shuffled, nor are those of revisits: ids and digests decide first."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    digests = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
    firsts = digests.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n")
    firsts = materialize(firsts.withColumn("key", F.xxhash64("payload_digest")), "firsts")
    once, more = split_rows(rows, F.xxhash64("payload_digest"), key_filter(firsts, "key"))
    # Spark may split the rows of one digest, since this side of the join is large and the other has a row a digest.
    named = more.drop("payload").join(firsts.drop("key"), "payload_digest", "left")
    named = materialize(named.withColumn("first", F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))), "named")
    lead = named.where("first").select("payload_digest", "page_id").distinct().withColumn("key", F.xxhash64("payload_digest", "page_id"))
    lead = materialize(lead, "lead")
    held = split_rows(more, F.xxhash64("payload_digest", "page_id"), key_filter(lead, "key"))[1]
    same = (held["payload_digest"] == lead["payload_digest"]) & held["page_id"].eqNullSafe(lead["page_id"])
    responses = once.union(held.join(lead, same, "left_semi"))
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    revisits = named.where("not first").withColumn("payload", F.lit(None).cast("binary"))
    return responses.select(*names, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select(*names, F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"))
    )


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; ``size`` is that of the payload, which a revisit does not hold."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _HEADER_END + body + _HEADER_END) + packer.flush()


def decode_record(data: bytes) -> dict:
    """Headers and payload of an unpacked record; ``ValueError`` if its digest is wrong."""
    head, _, rest = data.partition(_HEADER_END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(_HEADER_END)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x) if (x := re.sub(r"<urn:page:|>", "", x)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        stream, path, size, done = None, "", 0, []
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for row in range(len(batch)):
                record = encode_record(*[c[row].as_py() for c in columns], date)
                if stream is None:
                    path, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(path, compression=None)
                stream.write(record)
                size += len(record)
                if size >= file_bytes:
                    stream.close()
                    done.append((path, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rpartition('/')[2]}" for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return run


def write_archives(pages: DataFrame, date: str = "2026-01-01T00:00:00Z", min_revisit: int = 100, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page into archives in the shared folder; the manifest (path, bytes) of the files."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    marked = mark_revisits(pages, min_revisit)
    return materialize(marked.mapInArrow(_write(folder, date, file_bytes), "path string, bytes long"), "manifest")


def split_records(stream, start: int, end: int, size: int, block: int = 1 << 16) -> Iterator[bytes]:
    """The unpacked records whose member starts in [start, end) of an open file of ``size`` bytes."""

    def at(position: int, n: int) -> bytes:
        stream.seek(position)
        return stream.read(min(n, size - position))

    def member(position: int) -> tuple[bytes, int] | None:
        """What a member holds and where it ends; None if no record starts here."""
        unpacker, out, read, n = zlib.decompressobj(31), [], position, 1024
        while not unpacker.eof:
            data = at(read, n) if read < size else b""
            if not data:
                return None
            try:
                out.append(unpacker.decompress(data))
            except zlib.error:
                return None
            if read == position and not out[0].startswith(b"WARC/"):
                return None
            read, n = read + len(data), block
        return b"".join(out), read - len(unpacker.unused_data)

    position = start
    while position < end:
        window = at(position, min(block, end - position) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0 or position + found >= end:
            position += max(1, len(window) - len(MAGIC) + 1)
            continue
        got = member(position + found)
        if got is None:
            position += found + 1
            continue
        yield got[0]
        position = got[1]


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for split in batch.to_pylist():
                fs, path = _open(split["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as stream:
                    for data in split_records(stream, split["start"], split["end"], split["bytes"]):
                        row = decode_record(data)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data)
                        if held > 16_000_000 or len(rows) >= 4096:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    return run


def read_archives(manifest: DataFrame, split_bytes: int = 4_000_000, with_payload: bool = True) -> DataFrame:
    """Records of the archives, by tasks that each take byte ranges; a revisit has no payload of its own."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    # A number of its own, since adaptive execution would merge such small rows into one partition.
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    parts = min(-(-total // split_bytes) or 1, 100_000)
    return splits.repartition(parts, "path", "start").mapInArrow(_read(with_payload), _RECORD)
