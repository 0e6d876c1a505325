"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing, NPY tiles and difference hashes.

Decoders take P1-P6 Netpbm (8-bit) and uncompressed BMP of 8, 24 or 32 bits and give (height, width)
or (height, width, 3) uint8 arrays.  Resizing averages exact areas by means of an integral image, which
is made strip by strip, so that it takes no more memory for a tall picture.

Edge cases, all defined: a null text is an empty payload, i.e. one tile of padding; long texts give
more tiles (a task holds about six times its longest text); equal texts give equal values; an empty table gives an
empty result; malformed media raise ``ValueError``; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, stored

SIDE = 24
TILE = SIDE * SIDE
#: The palette of an 8-bit grey BMP: blue, green, red and a spare byte of each level.
GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A (height, width) uint8 array as binary Netpbm (P5)."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A (height, width) uint8 array as an 8-bit BMP with a grey palette."""
    h, w = pixels.shape
    pad = -w % 4
    rows = np.pad(pixels[::-1], ((0, 0), (0, pad)))
    palette = GREYS.tobytes()
    start = 14 + 40 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette + rows.tobytes()


def _netpbm_head(data: bytes, n: int) -> tuple[list[int], int]:
    values, at = [], 2
    while len(values) < n:
        while at < len(data) and (data[at] in b" \t\r\n" or data[at] == 35):
            at = data.index(b"\n", at) + 1 if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end] in b"0123456789":
            end += 1
        if end == at:
            raise ValueError("Netpbm header is cut short")
        values.append(int(data[at:end]))
        at = end
    return values, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with samples of at most 8 bits."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bits = kind in (b"P1", b"P4")
    head, at = _netpbm_head(data, 2 if bits else 3)
    w, h = head[:2]
    top = 1 if bits else head[2]
    if not 0 < top < 256:
        raise ValueError("only 8-bit Netpbm samples are decoded")
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(x.split(b"#")[0] for x in data[at:].split(b"\n"))
        flat = np.array(list(body.translate(None, b" \t\r\n")) if bits else body.split(), dtype=np.int64)
        flat = flat - 48 if bits else flat
    elif bits:
        stride = (w + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8, w * h * planes, at + 1)
    if flat.size < w * h * planes:
        raise ValueError("Netpbm samples are cut short")
    flat = flat[: w * h * planes]
    if bits:
        flat = (1 - flat) * 255
    elif top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    shape = (h, w, 3) if planes == 3 else (h, w)
    return flat.astype(np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP; a grey palette gives a 2-D array, anything else red, green, blue."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is decoded")
    rows, step = abs(h), (w * depth // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, step * rows, start).reshape(rows, step)
    raw = raw[::-1] if h > 0 else raw
    if depth == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        pixels = raw[:, :w]
        grey = bool((palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all())
        return palette[:, 0][pixels] if grey else palette[pixels]
    return raw[:, : w * depth // 8].reshape(rows, w, depth // 8)[:, :, 2::-1].copy()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n equal cells of an axis begin and end: whole positions and the parts of the next sample."""
    edges = np.arange(n + 1) * size / n
    low = np.minimum(np.floor(edges).astype(int), size)
    return low, edges - low


def area_resize(pixels: np.ndarray, height: int, width: int, strip: int = 4096) -> np.ndarray:
    """Means over the exact area of each target cell (float64), by an integral image with linear edges.

    Only the rows of the integral image at cell edges are kept; they are found ``strip`` rows at a time.
    """
    size = pixels.shape[0]
    low, part = _edges(size, height)
    part = part.reshape(-1, *[1] * (pixels.ndim - 1))
    at = np.zeros((height + 1, *pixels.shape[1:]))
    total = np.zeros(pixels.shape[1:])
    for start in range(0, size, strip):
        rows = pixels[start : start + strip].astype(np.float64)
        here = (low >= start) & (low < start + len(rows))
        sums = np.concatenate([np.zeros_like(rows[:1]), np.cumsum(rows, 0)])
        at[here] = total + sums[low[here] - start] + part[here] * rows[low[here] - start]
        total = total + sums[-1]
    at[low == size] = total
    values = np.moveaxis(np.diff(at, axis=0) * (height / size), 1, 0)
    size = len(values)
    low, part = _edges(size, width)
    sums = np.concatenate([np.zeros_like(values[:1]), np.cumsum(values, 0)])
    at = sums[low] + part.reshape(-1, *[1] * (values.ndim - 1)) * values[np.minimum(low, size - 1)]
    return np.moveaxis(np.diff(at, axis=0) * (width / size), 0, 1)


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """Hexadecimal difference hash: is each cell of a side x (side + 1) reduction darker than its right neighbour?"""
    grey = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, side, side + 1), 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(height, width) cut into (n, side, side) tiles in raster order; both must be multiples of side."""
    h, w = pixels.shape
    return pixels.reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side, side)


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def text_payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes padded with 255 to a positive multiple of 576, and their number before padding."""
    raw = (text or "").encode("utf-8", "replace")
    whole = max(1, -(-len(raw) // TILE)) * TILE
    return raw + b"\xff" * (whole - len(raw)), len(raw)


#: What is read back from stored media.
READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def make_media(text: str | None) -> tuple[int, bytes, bytes]:
    """Bytes of the text, NPY tiles of its decoded grey image and the NPY tile that the whole image is resized to.

    The image comes as BMP where its tiles are odd in number, else as Netpbm.
    """
    payload, n = text_payload(text)
    grey = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    picture = decode_image((encode_bmp if len(grey) // SIDE % 2 else encode_pgm)(grey))
    del payload, grey
    small = np.rint(area_resize(picture, SIDE, SIDE)).astype(np.uint8)
    return n, npy_bytes(to_tiles(picture)), npy_bytes(small)


def media_values(media: bytes, small: bytes) -> tuple:
    """The columns of ``READ`` from stored tiles and the stored resized tile."""
    tiles = npy_array(media)
    back = memoryview(np.ascontiguousarray(tiles)).cast("B")
    return (
        len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(),
        f"{tiles.shape[0]}x{SIDE}x{SIDE}:{difference_hash(tiles.reshape(-1, SIDE))}:{difference_hash(npy_array(small))}",
    )


def write_media(docs: DataFrame) -> DataFrame:
    """Texts as media: doc_id, n_bytes, ``media``, a grey image one tile wide as NPY tiles, and ``small``, all of it in one tile."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            made = [make_media(text.as_py()) for text in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "n_bytes": [n for n, _, _ in made], "media": [m for _, m, _ in made], "small": [m for _, _, m in made]}

        return kernel

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, n_bytes bigint, media binary, small binary", make, rows=128)


def read_media(table: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """What is read back from a table of ``write_media``, with the ``media`` themselves unless ``keep_bytes`` is false."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            values = zip(*(media_values(a.as_py(), b.as_py()) for a, b in zip(batch.column("media"), batch.column("small"))))
            names = [x.split()[0] for x in READ.split(", ")]
            return {**{k: batch.column(k) for k in ("doc_id", "n_bytes", "media")}, **dict(zip(names, map(list, values)))}

        return kernel

    return map_batches(table, f"doc_id bigint, n_bytes bigint, {READ}" + (", media binary" if keep_bytes else ""), make, rows=128)


def store_media(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """Texts as stored media: a grey image one tile wide is decoded, written as NPY tiles to the shared folder and read back.

    Gives doc_id, n_bytes, the stored ``media`` (unless ``keep_bytes`` is false) and what is read back
    from it: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and ``feature``
    (``tiles x 24 x 24:`` and the difference hashes of the whole image and of the tile it is resized to).
    """
    return read_media(stored(write_media(docs), "media"), keep_bytes)
