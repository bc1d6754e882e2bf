"""Media columns for GIF: files decoded to timed frames with colour histograms.

``decode`` reads the blocks of a GIF file, unpacks the LZW code stream of each
image, undoes interlacing, and draws it on the canvas through its palette, with
transparency and the disposal of the frame before. ``frames`` makes rows of them:
delay and time, and a histogram of 64 colours (two bits a channel). ``encode`` is
the inverse for palette indices, so that any bytes can be stored without loss.

In an LZW stream the string of a table entry is the string of the code before it
and one more byte, and so a part of what has already been put out: an entry is
only its place and length, and a code is one copy of bytes.

Null payloads are empty and have no frames. A damaged file (cut off anywhere before
its trailer, a code
stream with more or fewer samples than pixels, a code size that 8-bit samples
can't have, a canvas or image of more than ``most_pixels``) raises ``BadGif``;
``frames`` then yields one row that says so in ``frame.error``, or fails when
``strict`` is set. Null and empty texts are stored as one line of zeros; very long
ones as many frames. Rows that repeat are stored one by one, alike; an empty table
gives no rows; other columns stay as they are, but for one named frame, which
``frames`` replaces.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import list_of, row_type


class BadGif(ValueError):
    pass


# --- LZW ---------------------------------------------------------------------

_CLEAR, _END, _FIRST = 256, 257, 258


def lzw_encode(data: bytes) -> bytes:
    """Code stream of 8-bit samples: codes of 9 to 12 bits, least significant bit first."""
    codes, widths = [_CLEAR], [9]
    table: dict[int, int] = {}
    get, put, put_width = table.get, codes.append, widths.append
    width, limit, code = 9, 512, _FIRST
    it = iter(data)
    prefix = next(it, -1)
    for b in it:
        key = prefix << 8 | b
        found = get(key)
        if found is not None:
            prefix = found
            continue
        put(prefix)
        put_width(width)
        table[key] = code
        if code == limit:
            width += 1
            limit *= 2
        code += 1
        if code == 4096:
            put(_CLEAR)
            put_width(width)
            table.clear()
            width, limit, code = 9, 512, _FIRST
        prefix = b
    if prefix >= 0:
        put(prefix)
        put_width(width)
        if code == limit:
            width = min(12, width + 1)
    put(_END)
    put_width(width)
    return _pack(np.array(codes, dtype=np.uint32), np.array(widths, dtype=np.int64))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    at = np.cumsum(widths) - widths
    out = np.zeros((int(at[-1] + widths[-1]) + 7) // 8 + 3, dtype=np.uint8)
    value = codes << (at & 7).astype(np.uint32)
    byte = at >> 3
    for k in range(3):
        # the pieces of codes never overlap, so adding is joining
        out += np.bincount(byte + k, weights=(value >> np.uint32(8 * k)) & np.uint32(255), minlength=len(out)).astype(np.uint8)
    return out[:-3].tobytes()


def lzw_decode(stream: bytes, code_size: int, expected: int) -> bytes:
    """Samples of a code stream of any minimum code size from 1 to 8; no more than expected."""
    if not 1 <= code_size <= 8:
        raise BadGif(f"code size {code_size}")
    clear = 1 << code_size
    end, first = clear + 1, clear + 2
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    triples = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    bits = len(stream) * 8
    out = bytearray()
    at = 0
    while at + code_size + 1 <= bits:
        # widths depend only on the number of codes since the last clear, so a run of codes is unpacked at once
        width, upto = _widths(code_size, (bits - at) // (code_size + 1) + 1)
        n = int(np.searchsorted(upto, bits - at, side="right"))
        for most in (min(n, 8192), n):  # the table is cleared, as a rule, within some 4000 codes
            w = width[:most]
            starts = at + upto[:most] - w
            codes = triples[starts >> 3] >> (starts & 7).astype(np.uint32) & (np.uint32(1) << w.astype(np.uint32)) - np.uint32(1)
            if np.any((codes == clear) | (codes == end)):
                break
        used = _run(codes.tolist(), out, clear, end, first, expected)
        if not used:
            break
        at += int(upto[used - 1])
    return bytes(out)


def _run(codes: list[int], out: bytearray, clear: int, end: int, first: int, expected: int) -> int:
    """Puts out codes up to and with the next clear; the number of codes used, 0 at the end."""
    place: list[int] = []
    length: list[int] = []
    add_place, add_length = place.append, length.append
    used = 0
    last_at = last_len = 0
    size = len(out)
    for code in codes:
        used += 1
        if code < clear:
            if last_len and len(place) < 4096 - first:
                add_place(last_at)
                add_length(last_len + 1)
            out.append(code)
            last_at, last_len = size, 1
            size += 1
        elif code >= first:
            k = code - first
            if last_len and len(place) < 4096 - first:
                add_place(last_at)
                add_length(last_len + 1)
            if k >= len(place):
                raise BadGif("code beyond the table")
            a, n = place[k], length[k]
            if a + n > size:  # the entry being made: its last byte is its first
                out += out[a:size]
                out.append(out[a])
            else:
                out += out[a : a + n]
            last_at, last_len = size, n
            size += n
        elif code == clear:
            return used
        else:
            return 0
        if size > expected:
            raise BadGif("more samples than pixels")
    return 0


_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _widths(code_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of at least n codes after a clear, and their running sums; the first code adds no entry."""
    if code_size not in _WIDTHS or len(_WIDTHS[code_size][0]) < n:
        entries = np.minimum((1 << code_size) + 2 + np.maximum(np.arange(max(n, 1 << 14)) - 1, 0), 4095)
        w = np.maximum(code_size + 1, np.ceil(np.log2(entries + 1)).astype(np.int64))
        _WIDTHS[code_size] = (w, np.cumsum(w))
    return _WIDTHS[code_size]


# --- files -------------------------------------------------------------------

WIDTH = 64
ROWS = 512
#: The largest canvas, and the largest image, that is read unless another bound, or none, is asked for: a damaged header can name 2^32 pixels.
MOST_PIXELS = 1 << 26
GRAY = bytes(v for i in range(256) for v in (i, i, i))


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = 4) -> bytes:
    """A GIF of 8-bit samples, len(samples) a multiple of width, in frames of at most rows lines each; the palette is gray."""
    height = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), GRAY]
    for i in range(0, height, rows):
        part = samples[i * width : (i + rows) * width]
        stream = lzw_encode(part)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        out.append(b"\x08")
        out += [bytes([len(b)]) + b for b in (stream[k : k + 255] for k in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b";"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int  # -1: none
    palette: np.ndarray  # (n, 3)
    indices: np.ndarray  # (height, width)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("cut off")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise BadGif("cut off")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def read(data: bytes, most_pixels: int | None = MOST_PIXELS) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames as stored; a file without its last byte, the trailer, is cut off. most_pixels: of a canvas or an image, None for any."""
    most = most_pixels if most_pixels is not None else 1 << 32
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most:
        raise BadGif(f"a canvas of {width} x {height}")
    at, common = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    found, delay, disposal, transparent = [], 0, 0, -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return width, height, found
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = control >> 2 & 7, index if control & 1 else -1
            elif label == 0x01:  # plain text is drawn too, so the control before it is its own
                delay, disposal, transparent = 0, 0, -1
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise BadGif(f"block {kind:#x} at {at}")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if own & 0x80:
            palette, at = _palette(data, at, own)
        if at >= len(data):
            raise BadGif("cut off")
        code_size = data[at]
        stream, at = _blocks(data, at + 1)
        if w * h > most:
            raise BadGif(f"an image of {w} x {h}")
        samples = lzw_decode(stream, code_size, w * h)
        if len(samples) < w * h:
            raise BadGif("fewer samples than pixels")
        pixels = np.frombuffer(samples, np.uint8).reshape(h, w)
        if own & 0x40:  # interlaced: rows from 0 by 8, 4 by 8, 2 by 4, 1 by 2
            order = [r for a, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, step)]
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        found.append(Frame(left, top, w, h, delay, disposal, transparent, palette, pixels))
        delay, disposal, transparent = 0, 0, -1
    raise BadGif("cut off")


def composed(width: int, height: int, stored: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """(delay in ms, canvas of (height, width, 4) RGBA) after each frame."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in stored:
        kept = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        index = f.indices[:h, :w]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        target = canvas[f.top : f.top + h, f.left : f.left + w]
        seen = index != f.transparent
        target[seen] = colours[index[seen]]
        yield f.delay_cs * 10, canvas.copy()
        if f.disposal == 2:
            canvas[f.top : f.top + h, f.left : f.left + w] = 0
        elif kept is not None:
            canvas = kept


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of 64 colours, two bits a channel; transparent pixels do not count."""
    p = rgba[rgba[..., 3] > 0] >> 6
    return np.bincount(p[:, 0].astype(int) * 16 + p[:, 1] * 4 + p[:, 2], minlength=64)


FRAME = row_type(frame="int", start_ms="long", delay_ms="long", width="int", height="int", disposal="int", histogram=list_of("long"), rgb="binary", error="string")


#: Bytes of pixels and histograms after which a task hands on the frames that it has.
HANDED = 1 << 24


def frames(files: DataFrame, content: str = "content", pixels: bool = False, strict: bool = False, most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """files with one row a frame, struct column frame: timing, size and colour histogram, and the pixels if asked for; a damaged file has one row with nothing but frame.error, a null one none.

    Frames are handed on as they are composed, so a task holds some of a file's, not all; other columns go along as they are."""
    files = files.select(*[F.col(f"`{c}`") for c in files.columns if c.lower() != "frame"])
    kind, at = to_arrow_type(FRAME), files.columns.index(content)

    def of(batch: pa.RecordBatch, row: int, made: list[dict]) -> pa.RecordBatch:
        same = batch.take(pa.array([row] * len(made), pa.int32()))
        return pa.RecordBatch.from_arrays([*same.columns, pa.array(made, kind)], names=[*batch.schema.names, "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cell in enumerate(batch.column(at)):
                data, made, held, clock = cell.as_py(), [], 0, 0
                if data is None:
                    continue
                try:
                    width, height, parts = read(bytes(data), most_pixels)
                    for i, (delay, rgba) in enumerate(composed(width, height, parts)):
                        rgb = rgba[..., :3].tobytes() if pixels else None
                        made.append({"frame": i, "start_ms": clock, "delay_ms": delay, "width": width, "height": height, "disposal": parts[i].disposal, "histogram": histogram(rgba).tolist(), "rgb": rgb, "error": None})
                        clock, held = clock + delay, held + 1024 + len(rgb or b"")
                        if held >= HANDED:
                            yield of(batch, row, made)
                            made, held = [], 0
                except BadGif as e:
                    if strict:
                        raise
                    made = [dict.fromkeys(FRAME.names) | {"error": str(e)}]
                if made:
                    yield of(batch, row, made)

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("frame", FRAME)]))


# --- the query ---------------------------------------------------------------

_MEDIA = row_type(n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string")


def stored(text: str | None) -> tuple:
    """The row of a text: its bytes as a GIF, read back."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
    media = encode(payload)
    width, height, parts = read(media)
    # the frames as they are shown; the palette is gray, so that a channel of a colour is the sample
    shown, gray = [], np.zeros(64, dtype=np.int64)
    for f, (_, canvas) in zip(parts, composed(width, height, parts), strict=True):
        own = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        shown.append(own[..., 0].tobytes())
        gray += histogram(own)
    back = b"".join(shown)
    feature = f"{width}x{height};frames={len(parts)};ms={sum(f.delay_cs for f in parts) * 10};hist=" + ",".join(f"{k}:{n}" for k, n in enumerate(gray.tolist()) if n)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_columns(docs: DataFrame) -> DataFrame:
    """Per document the digests of its text stored as a GIF and read back."""

    @F.pandas_udf(_MEDIA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([stored(t) for t in s], columns=_MEDIA.names)

    return docs.select("doc_id", run(F.col("text")).alias("m")).select("doc_id", "m.*")
