"""Media columns: images in PNG, written and read with zlib and numpy, and cosine-transform hashes (operator 4).

Reading checks the signature and every chunk's CRC, inflates the image data and undoes all five filters."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, unlike

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, for 8-bit samples.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Bytes of a row of 64 pixels of three samples.
ROW = 192
#: A hash's frequencies in each direction, from an image shrunk to SIDE x SIDE.
LOW, SIDE = 8, 32


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: bytes, width: int = ROW // 3, channels: int = 3, level: int = 1) -> bytes:
    """An image of whole rows of 8-bit samples, without loss. Of the filters None, Sub and Up, the one under which the first rows deflate best."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width * channels)
    sub, up = rows.copy(), rows.copy()
    sub[:, channels:] -= rows[:, :-channels]
    up[1:] -= rows[:-1]
    cost = [len(zlib.compress(x[:24].tobytes(), 1)) for x in (rows, sub, up)]
    best = int(np.argmin(cost))
    body = np.empty((len(rows), 1 + rows.shape[1]), np.uint8)
    body[:, 0] = best
    body[:, 1:] = (rows, sub, up)[best]
    kind = {v: k for k, v in CHANNELS.items()}[channels]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body, level)) + _chunk(b"IEND", b"")


def _diagonals(kind: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Any filters undone, diagonal by diagonal: a pixel is told by those on its left, above it and between these, all of which earlier diagonals have."""
    high, wide = len(rows), rows.shape[1] // n
    given, done = rows.reshape(high, wide, n), np.zeros((high + 1, wide + 1, n), np.int16)
    for d in range(high + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - y
        left, above, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        p, q, r = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))
        told = np.choose(kind[y][:, None], [np.zeros_like(left), left, above, (left + above) >> 1, nearest])
        done[y + 1, x + 1] = (given[y, x] + told) & 255
    return done[1:, 1:].astype(np.uint8).reshape(high, -1)


def unfilter(body: np.ndarray, channels: int) -> np.ndarray:
    """body: rows, each a filter type and filtered bytes. Without Average and Paeth, runs of rows with one filter are taken together."""
    kind, rows = body[:, 0], body[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown filter")
    if (kind > 2).any():
        return _diagonals(kind, rows, channels)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)])) if len(kind) else np.zeros(1, int)
    for a, b in zip(edges, edges[1:]):
        if kind[a] == 1:
            rows[a:b] = np.cumsum(rows[a:b].reshape(b - a, -1, channels), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind[a] == 2:
            if a:
                rows[a] += rows[a - 1]
            rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
    return rows


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """Rows of samples, and samples per pixel. Raises ValueError for a damaged file or a form that isn't written here."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"chunk {kind!r} is needed but unknown")
    if head is None or not ended:
        raise ValueError("the header or the end is missing")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("only 8-bit samples without a palette or interlacing")
    channels = CHANNELS[colour]
    size, z = height * (1 + width * channels), zlib.decompressobj()
    try:
        body = z.decompress(b"".join(packed), size + 1)  # no more than the header says, whatever the data would inflate to
        whole = len(body) == size and (z.eof or not z.decompress(z.unconsumed_tail, 1) and z.eof)
    except zlib.error as e:
        raise ValueError(f"the image data is damaged: {e}") from e
    if not whole:
        raise ValueError("the image data has another size")
    return unfilter(np.frombuffer(body, np.uint8).reshape(height, -1), channels), channels


def _basis(n: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(LOW + 1)[:, None])


_BASIS = _basis(SIDE)


def cosine_hash(rows: np.ndarray, channels: int) -> bytes:
    """Eight bytes: which of the 64 lowest cosine frequencies but the constant ones are above their median, in the mean of the channels shrunk to SIDE x SIDE."""
    grey = rows.reshape(len(rows), -1, channels).mean(2, dtype=np.float32) if channels > 1 else rows.astype(np.float32)
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        size = np.maximum(np.diff(np.append(edges, n)), 1)
        grey = np.add.reduceat(grey, edges, axis=axis) / (size[:, None] if axis == 0 else size)
    low = (_BASIS @ grey @ _BASIS.T)[1:, 1:]
    return np.packbits(low > np.median(low)).tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def media(docs: DataFrame, key: str = "doc_id", text: str = "text", hashes: bool = True) -> DataFrame:
    """(key, n_bytes, png, hash): every text's bytes, padded with spaces to whole rows, as a PNG in a binary column.

    hash is the eight bytes of `cosine_hash`, or null where hashes aren't asked for, as `digests` takes them anew from
    what it reads. A null text is stored like an empty one; repeated rows come out each."""

    unlike(key, "n_bytes", "png", "hash")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            size, png, found = [], [], []
            for t in part.column(1).to_pylist():
                n, payload = padded(t)
                size.append(n)
                png.append(write_png(payload))
                found.append(cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, ROW), 3) if hashes else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(png, pa.binary()), pa.array(found, pa.binary())], [key, "n_bytes", "png", "hash"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, n_bytes long, png binary, hash binary")


def digests(stored: DataFrame, key: str = "doc_id", png: str = "png") -> DataFrame:
    """Reads every image back: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (hex of the hash of what was read), intact.

    A null or damaged image has nulls for what is read from it, and intact is false."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, png):
            out = []
            for data in part.column(2).to_pylist():
                try:
                    rows, channels = read_png(data or b"")
                except ValueError:
                    out.append((None, None, None, len(data) if data is not None else None, hashlib.sha256(data).hexdigest() if data is not None else None, None, False))
                    continue
                payload = rows.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(rows, channels).hex(), True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "intact"]
    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", png).mapInArrow(work, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, intact boolean")
