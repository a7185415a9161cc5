"""Media columns: PNG images in binary columns.

Writing: an 8-bit greyscale image becomes signature, IHDR, IDAT (one zlib stream) and IEND, each chunk with
its CRC-32; each row takes the scanline filter, of the five, whose differences have the least absolute sum.  Reading:
chunks are walked and their checksums tested, the zlib stream is inflated up to the size that the header tells, and
the filters are undone with numpy along the anti-diagonals of many images at once: a sample depends on its left, upper
and upper left neighbours, which lie on the two diagonals before.  The feature is a perceptual hash: the image is reduced to 32 x 32
means, and the signs of its 8 x 8 low-frequency cosine coefficients against their median make 64 bits.

Defined cases: null and empty texts give one row of 64 zero samples; any length works, as rows are added; a
stored image that is null or damaged gives a null payload and its fault in ``error`` rather than a failed job.
Equal texts give equal bytes and features.  Only the named id and value columns are read, so other columns may
have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8


class MediaError(ValueError):
    """A stored image that is not a sound 8-bit greyscale PNG."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _guesses(rows: np.ndarray) -> np.ndarray:
    """What each filter type, 0 to 4, expects at each sample."""
    left = np.pad(rows, ((0, 0), (1, 0)))[:, :-1].astype(np.int16)
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1].astype(np.int16)
    corner = np.pad(rows, ((1, 0), (1, 0)))[:-1, :-1].astype(np.int16)
    return np.stack([np.zeros_like(left), left, up, (left + up) >> 1, _paeth(left, up, corner)])


def png_encode(samples: bytes, width: int = WIDTH, filters: bytes | None = None, level: int = 1) -> bytes:
    """``samples`` (a positive multiple of ``width``) as a PNG; ``filters`` holds one filter type (0-4) a row, else the best ones are taken."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    left = (rows - _guesses(rows)).astype(np.uint8)
    kind = np.abs(left.view(np.int8).astype(np.int16)).sum(2).argmin(0) if filters is None else np.frombuffer(filters, np.uint8)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = left[kind, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Undo the scanline filters of images of one width, each an array of rows that begin with their filter type."""
    many, high, wide = len(images), max(map(len, images)), images[0].shape[1] - 1
    padded = np.zeros((many, high + 2 * wide, wide + 1), np.uint8)  # no samples before the first row and after the last
    for g, image in enumerate(images):
        padded[g, wide : wide + len(image)] = image
    x = np.arange(wide)
    out = np.empty((many, high + 2 * wide, wide), np.uint8)
    before, last = np.zeros((2, many, wide + 1), np.int16)  # two diagonals, with a sample 0 left of each
    for t in range(wide, high + 2 * wide - 1):
        y = t - x
        kind, left, up, corner = padded[:, y, 0], last[:, :-1], last[:, 1:], before[:, :-1]
        value = np.choose(kind, (0, left, up, (left + up) >> 1, _paeth(left, up, corner)))
        value += padded[:, y, x + 1]
        value &= 255
        out[:, y, x] = value
        before, last = last, np.pad(value, ((0, 0), (1, 0)))
    return [out[g, wide : wide + len(image)] for g, image in enumerate(images)]


def _lines(stored: bytes | None) -> np.ndarray:
    """The filtered rows of a stored image; raises :class:`MediaError` where it isn't sound."""
    if not stored or stored[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(stored) and not ended:
        (size,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data, sums = stored[at + 8 : at + 8 + size], stored[at + 8 + size : at + 12 + size]
        if len(sums) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", sums)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise MediaError("IHDR isn't the first chunk, or not the only one")
        if kind == b"IHDR":
            if size != 13:
                raise MediaError("IHDR of a wrong size")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise MediaError("truncated")
    width, height, *form = head
    if form != [8, 0, 0, 0, 0]:
        raise MediaError("not 8-bit greyscale, or unknown methods")
    if not width or not height:
        raise MediaError("no samples")
    packed, wanted = b"".join(body), height * (width + 1)
    if wanted > 1100 * len(packed):  # zlib shrinks data to a thousandth at best
        raise MediaError("wrong number of samples")
    try:
        inflate = zlib.decompressobj()
        lines = inflate.decompress(packed, wanted + 1)
        more = inflate.decompress(inflate.unconsumed_tail, 1) if len(lines) == wanted else b"-"
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if more or not inflate.eof:
        raise MediaError("wrong number of samples")
    rows = np.frombuffer(lines, np.uint8).reshape(height, width + 1)
    if rows[:, 0].max() > 4:
        raise MediaError(f"unknown filter {rows[:, 0].max()}")
    return rows


#: Samples that are unfiltered at once, about.
AREA = 1 << 18


def decoded(images: list[bytes | None]) -> list[np.ndarray | MediaError]:
    """The samples of each stored image as rows x width, or its fault."""
    out: list = []
    for stored in images:
        try:
            out.append(_lines(stored))
        except MediaError as e:
            out.append(e)
    sound = sorted((i for i, x in enumerate(out) if not isinstance(x, MediaError)), key=lambda i: (out[i].shape[1], len(out[i])))
    at = 0
    while at < len(sound):  # images of one width and of like heights
        wide, end = out[sound[at]].shape[1], at + 1
        while end < len(sound) and out[sound[end]].shape[1] == wide and (end + 1 - at) * (len(out[sound[end]]) + wide) * wide <= AREA:
            end += 1
        for i, image in zip(sound[at:end], unfilter([out[i] for i in sound[at:end]])):
            out[i] = image
        at = end
    return out


def png_decode(stored: bytes | None) -> np.ndarray:
    """The samples as rows x width; raises :class:`MediaError` where the image isn't sound."""
    (got,) = decoded([stored])
    if isinstance(got, MediaError):
        raise got
    return got


def _cosines() -> np.ndarray:
    k = np.arange(LOW)[:, None]
    return np.cos(np.pi * (2 * np.arange(SIDE) + 1) * k / (2 * SIDE))


COSINES = _cosines()


def _means(values: np.ndarray, axis: int) -> np.ndarray:
    """``SIDE`` means along an axis; shorter axes repeat their samples."""
    n = values.shape[axis]
    if n < SIDE:
        return np.take(values, np.arange(SIDE) * n // SIDE, axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    shape = [1, 1]
    shape[axis] = SIDE
    return np.add.reduceat(values, edges[:-1], axis, dtype=np.float64) / np.diff(edges).reshape(shape)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hexadecimal: low-frequency coefficients above their median; the constant one is left out of the median."""
    low = (COSINES @ _means(_means(samples.astype(np.float64), 0), 1) @ COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of the width, and the number of bytes before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [payload(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([png_encode(b) for b, _ in made], pa.binary())],
            ["id", "n_bytes", "media"],
        )


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``media``: every whole text stored as a PNG in a binary column."""
    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_batches, _encoded, f"id {id_type}, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "media", "payload", "feature", "error"]
    for batch in batches:
        got = decoded(batch.column(2).to_pylist())
        rows = [(None, None, str(x)) if isinstance(x, MediaError) else (x.tobytes(), cosine_hash(x), None) for x in got]
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)


def from_media(df: DataFrame) -> DataFrame:
    """Adds ``payload`` (the samples read back), ``feature`` and ``error`` to the rows of :func:`to_media`."""
    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", "n_bytes", "media").transform(in_batches, _decoded, f"id {id_type}, n_bytes long, media binary, payload binary, feature string, error string")


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of the query, from the stored images and what was read back from them."""
    tail = F.expr(f"substring(payload, -{WIDTH}, {WIDTH})")
    return df.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
