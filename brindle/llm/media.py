"""Media columns: lossless 8-bit PNG in a binary column, and a cosine-transform hash of the samples.

``encode_media`` stores each payload as a grey PNG 64 samples wide, each row with the
filter that leaves the fewest distinct values; ``read_media`` walks the stored bytes'
chunks, tests each checksum, inflates, undoes the row filters with numpy and computes
a 64-bit hash of the low-frequency cosine terms, a stretch of rows at a time.

Defined cases: a null text counts as empty; an empty payload is one row of 64
zeros; equal texts give equal values; a broken image raises ``ValueError`` naming
what was wrong; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: The format's fixed first bytes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILTER_NONE, FILTER_SUB, FILTER_UP, FILTER_AVERAGE, FILTER_PAETH = range(5)
TERMS = 8


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """Zeros up to a positive multiple of ``width``."""
    return payload + bytes((-len(payload)) % width or (0 if payload else width))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + up - corner, in that order if equal."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray) -> np.ndarray:
    """The rows with their filters' numbers in front: of the five filters each row takes the one after which it has the
    fewest distinct values, the first of equal ones."""
    height, width = rows.shape
    x = np.zeros((height + 1, width + 1), np.int16)
    x[1:, 1:] = rows
    now, left, up, corner = x[1:, 1:], x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    each = np.stack([now, now - left, now - up, now - (left + up) // 2, now - _paeth(left, up, corner)]).astype(np.uint8)
    values = np.sort(each, axis=2)
    kinds = np.argmin((values[:, :, 1:] != values[:, :, :-1]).sum(axis=2), axis=0)
    return np.hstack([kinds[:, None].astype(np.uint8), each[kinds, np.arange(height)]])


#: Rows that are filtered, and terms that are added up, at once.
STRETCH = 4096


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey 8-bit PNG whose samples are the padded payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    packer, body = zlib.compressobj(level), []
    for at in range(0, len(rows), STRETCH):
        before = max(at - 1, 0)  # a row's filter looks at the row above
        body.append(packer.compress(filtered(rows[before : at + STRETCH])[at - before :].tobytes()))
    body.append(packer.flush())
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(body)) + _chunk(b"IEND", b"")


def _sweep(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of any filters, along anti-diagonals: their samples depend only on the two diagonals before."""
    height, width = rows.shape
    x = np.zeros((height + 1, width + 1), np.int16)
    x[0, 1:] = above
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(d, height - 1) + 1)
        c = d - r
        left, up, corner, kind = x[r + 1, c], x[r, c + 1], x[r, c], kinds[r]
        guess = np.select([kind == FILTER_SUB, kind == FILTER_UP, kind == FILTER_AVERAGE, kind == FILTER_PAETH], [left, up, (left + up) // 2, _paeth(left, up, corner)], 0)
        x[r + 1, c + 1] = (rows[r, c] + guess) & 255
    return x[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of a grey 8-bit image from its filtered rows."""
    if len(kinds) and kinds.max() > FILTER_PAETH:
        raise ValueError(f"unknown row filter {kinds.max()}")
    out = rows.copy()
    sub = kinds == FILTER_SUB
    if sub.any():
        out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    # What is left needs the row above: runs of such rows, those of the Up filter alone as sums by column.
    needs = kinds > FILTER_SUB
    edges = np.flatnonzero(np.diff(np.r_[False, needs, False].astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if (kinds[a:b] == FILTER_UP).all():
            out[a:b] = np.cumsum(np.vstack([above, rows[a:b]]), axis=0, dtype=np.uint8)[1:]
        else:
            out[a:b] = _sweep(kinds[a:b], rows[a:b], above)
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG, with every chunk's checksum tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"checksum of chunk {kind!r} at {at} fails")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if head is None or not ended:
        raise ValueError("image is cut short")
    width, height, depth, colour, _, _, interlace = head
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only grey 8-bit images without interlace are read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("image data has the wrong size")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


@functools.lru_cache(256)
def _cosines(n: int, start: int, end: int) -> np.ndarray:
    """The TERMS cosine terms after the constant one, over the samples from start to end of n."""
    return np.cos(np.pi / n * (np.arange(start, end) + 0.5)[None, :] * np.arange(1, TERMS + 1)[:, None]) / n


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine terms exceed their median."""
    height, width = samples.shape
    terms, step = np.zeros((TERMS, width)), STRETCH // 8
    for at in range(0, height, step):
        end = min(at + step, height)
        cosines = _cosines if height <= step else _cosines.__wrapped__  # tall pictures keep nothing
        terms += cosines(height, at, end) @ samples[at:end].astype(np.float64)
    terms = np.round(terms @ _cosines(width, 0, width).T, 9).ravel()
    return np.packbits(terms > np.median(terms)).tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # a few megabytes at a time, so that very long texts do not pile up
        texts, start = batch.column(1), 0
        while start < len(batch):
            images, sizes, held, stop = [], [], 0, start
            while stop < len(batch) and held < 16_000_000:
                payload = (texts[stop].as_py() or "").encode()
                images.append(encode_png(pad(payload)))
                sizes.append(len(payload))
                held, stop = held + len(payload), stop + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, stop - start), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )
            start = stop


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (PNG bytes) for each document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(2):
            data = media.as_py()
            samples = decode_png(data)
            payload = samples.tobytes()
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples),
            ))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns], [x.split()[0] for x in _FEATURES.split(", ")]
        )


def read_media(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash (``phash``, 8 bytes) of each stored image, from its bytes alone."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _FEATURES)
