"""GIF media columns: LZW streams, palettes, disposal, transparency, timed frames, histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 576  # samples in a row of a stored payload
FRAME_ROWS = 64  # rows in a frame: the canvas stays small however long a text is
DELAY_CS = 4
BINS = 8  # of a colour channel
MOST_PIXELS = 1 << 26  # of a canvas or a frame that is decoded; larger ones count as broken
MOST_CODES = 3838  # of a segment, its closing clear code included; the table never overflows
_GREY = bytes(v for g in range(256) for v in (g, g, g))
_WIDTHS: dict[int, np.ndarray] = {}


#: What decode_gif raises on bytes that are no whole GIF.
FAULTS = (ValueError, IndexError, struct.error)


class Frame(NamedTuple):
    index: int
    delay_cs: int
    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray  # palette indices of the frame's own rectangle
    canvas: np.ndarray  # RGBA of the whole picture while the frame shows


def _widths(code_size: int) -> np.ndarray:
    """Bits of the m-th code after a clear code, m from 1."""
    if code_size not in _WIDTHS:
        clear = 1 << code_size
        _WIDTHS[code_size] = np.array([min(12, max(code_size + 1, (clear + m).bit_length())) for m in range(1, 4200)])
    return _WIDTHS[code_size]


def lzw_encode(samples: bytes) -> bytes:
    """Eight-bit samples as a GIF code stream, cleared before the table overflows."""
    codes, counts, start, free = [256], [1], 1, 258
    add, longer = codes.append, {}
    find, code = longer.get, samples[0]
    for c in memoryview(samples)[1:]:
        key = code << 8 | c
        known = find(key)
        if known is not None:
            code = known
            continue
        add(code)
        longer[key] = free
        free += 1
        if free == 256 + MOST_CODES:
            add(256)
            counts.append(len(codes) - start)
            start, free = len(codes), 258
            longer.clear()
        code = c
    add(code)
    add(257)
    counts.append(len(codes) - start)
    widths = _widths(8)
    width = np.concatenate([widths[:n] for n in counts])
    offset = np.cumsum(width) - width
    value = np.array(codes, np.uint32) << (offset & 7).astype(np.uint32)
    size = int(offset[-1] + width[-1] + 7) // 8
    packed = sum(np.bincount((offset >> 3) + k, value >> 8 * k & 255, size + 2) for k in range(3))
    return packed[:size].astype(np.uint8).tobytes()


def _segment(codes: list[int], clear: int) -> bytes:
    """Samples of the codes between two clear codes."""
    entries = [bytes((i,)) for i in range(clear)] + [b"", b""]
    add, before, out = entries.append, entries[codes[0]], []
    keep = out.append
    keep(before)
    grown = codes[1 : 4096 - clear - 1]  # each of these codes adds an entry
    for free, code in enumerate(grown, clear + 2):
        if code < free:
            now = entries[code]
            add(before + now[:1])
        elif code == free:
            now = before + before[:1]
            add(now)
        else:
            raise ValueError("bad code in a GIF stream")
        keep(now)
        before = now
    out += [entries[code] for code in codes[1 + len(grown) :]]
    return b"".join(out)


def lzw_decode(stream: bytes, code_size: int, wanted: int) -> bytes:
    """The samples of a GIF code stream; a full table is kept until a clear code comes."""
    clear, stop = 1 << code_size, (1 << code_size) + 1
    widths = _widths(code_size)
    buffer = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total = len(stream) * 8
    out, pending, at, m = [], [], 0, 0
    while True:
        width = widths[m : min(m + 4096, m + wanted + 2)] if m < 64 else np.full(4096, 12)
        offset = at + np.cumsum(width) - width
        offset = offset[offset + width <= total]
        if not len(offset):
            break
        width = width[: len(offset)]
        byte = offset >> 3
        codes = ((buffer[byte] | buffer[byte + 1] << 8 | buffer[byte + 2] << 16) >> (offset & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(special[0]) if len(special) else len(codes)
        pending += codes[:n].tolist()
        if not len(special):
            at, m = int(offset[-1] + width[-1]), m + n
            continue
        if pending:
            out.append(_segment(pending, clear))
            pending = []
        if codes[n] == stop:
            break
        at, m = int(offset[n] + width[n]), 0
    if pending:
        out.append(_segment(pending, clear))
    return b"".join(out)[:wanted]


def encode_gif(samples: bytes) -> bytes:
    """Samples (a positive multiple of ROW) as an animated GIF with an identity grey palette."""
    rows = len(samples) // ROW
    parts = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        height = min(FRAME_ROWS, rows - top)
        stream = lzw_encode(samples[top * ROW : (top + height) * ROW])
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, height, 0) + b"\x08")
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            parts.append(bytes((len(block),)) + block)
        parts.append(b"\0")
    return b"".join(parts) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF, one at a time, composed under its disposal and transparency rules.

    Disposal 2 clears a frame's rectangle to transparent, 3 restores what was there before it;
    a transparent index leaves the canvas as it is. Interlaced rows are put in order. Bytes
    that are no whole GIF raise one of FAULTS where they go wrong, after the frames before it.
    """
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MOST_PIXELS:
        raise ValueError("canvas too large")
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        shared, at = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear, index = 0, 0, -1, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, clear = struct.unpack("<BHB", block[:4])
                disposal, clear = packed >> 2 & 7, clear if packed & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, shared
        if w * h > MOST_PIXELS:
            raise ValueError("frame too large")
        if flags & 0x80:
            size = 3 << (flags & 7) + 1
            palette, at = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size
        code_size = data[at]
        if palette is None or not 1 <= code_size <= 11:
            raise ValueError("no palette" if palette is None else "bad code size")
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, code_size, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order)]
        kept = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        shown = samples[: box.shape[0], : box.shape[1]]
        if clear >= 0:
            seen = shown != clear
            box[seen, :3] = palette[shown[seen]]
            box[seen, 3] = 255
        else:
            for k in range(3):
                box[..., k] = palette[:, k][shown]
            box[..., 3] = 255
        yield Frame(index, delay, left, top, w, h, samples, canvas)
        if disposal == 2:
            box[:] = 0
        elif disposal == 3:
            canvas[:] = kept
        index, delay, disposal, clear = index + 1, 0, 0, -1


def histogram(canvas: np.ndarray) -> list[int]:
    """Counts of red, then green, then blue values in BINS equal bins, visible pixels only."""
    seen = canvas.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    counts = [np.bincount(seen[:, k], minlength=256) for k in range(3)]
    return [int(n) for c in counts for n in c.reshape(BINS, -1).sum(axis=1)]


def payload_of(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of ROW."""
    return text + b"\xff" * (-len(text) % ROW if text else ROW)


def texts_to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_bytes, media): every whole text stored as a GIF.

    A null or empty text is one row of 255s; a long text becomes more frames, so memory is
    bounded by one document. Repeated rows give repeated rows, an empty table gives none;
    other columns of docs are not read.
    """

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            raw = [(t or "").encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_gif(payload_of(r)) for r in raw], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PLACE = ("index", "delay_cs", "left", "top", "width", "height")
FRAMES = f"array<struct<{','.join(f'{n}:int' for n in PLACE)},samples:binary,histogram:array<int>>>"


def _read(data: bytes, samples: bool) -> tuple[list[dict], str | None, tuple]:
    """The frames of stored media, what is wrong with it, and (size, SHA-256, CRC of the last 32) of the values that its frames show in the first channel."""
    frames, fault, whole, tail, size = [], None, hashlib.sha256(), b"", 0
    try:
        for f in decode_gif(data):
            pixels = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
            whole.update(pixels)
            tail, size = (tail + pixels)[-32:], size + len(pixels)
            frames.append({n: getattr(f, n) for n in PLACE} | {"samples": f.samples.tobytes() if samples else None, "histogram": histogram(f.canvas)})
    except FAULTS as wrong:
        fault = f"broken after {len(frames)} frames: {wrong}"
    return frames, fault, (size, whole.hexdigest(), zlib.crc32(tail))


def media_frames(media: DataFrame, samples: bool = True) -> DataFrame:
    """(doc_id, media) as (doc_id, n_bytes, frames, fault, shown_bytes, shown_sha256, shown_crc32, media_bytes, media_sha256).

    frames are timed frames with their palette indices (where `samples`) and the histogram of
    the canvas while they show: BINS counts of each channel. Null media has no frames and null
    figures. Truncated or corrupt media keeps the frames before the fault, which `fault` names.
    Repeated rows stay, an empty table gives none; of other columns only n_bytes is kept,
    null where there is none.
    """
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in PLACE] + [("samples", pa.binary()), ("histogram", pa.list_(pa.int32()))]))
    names = ["doc_id", "n_bytes", "frames", "fault", "shown_bytes", "shown_sha256", "shown_crc32", "media_bytes", "media_sha256"]
    kinds = [kind, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for m in b.column("media").to_pylist():
                if m is None:
                    rows.append(([], None, None, None, None, None, None))
                else:
                    frames, fault, shown = _read(m, samples)
                    rows.append((frames, fault, *shown, len(m), hashlib.sha256(m).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names)

    n_bytes = F.col("n_bytes") if "n_bytes" in media.columns else F.lit(None).cast("long").alias("n_bytes")
    schema = f"doc_id long, n_bytes long, frames {FRAMES}, fault string, shown_bytes long, shown_sha256 string, shown_crc32 long, media_bytes long, media_sha256 string"
    return media.select("doc_id", n_bytes, "media").mapInArrow(run, schema)


def media_digest(media: DataFrame) -> DataFrame:
    """Reads stored GIFs back: the payload seen through palette and composition, and a feature of its frames.

    The feature is computed from the columns of media_frames: number of frames, time shown and
    the sum of their histograms. Null media gives nulls and the feature of no frames; broken
    media gives what its whole frames hold, and fault says so.
    """
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 3 * BINS), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    shown = F.aggregate("frames", F.lit(0), lambda a, f: a + f["delay_cs"])
    feature = F.concat(F.size("frames").cast("string"), F.lit(" frames, "), shown.cast("string"), F.lit(" cs, histogram "), F.array_join(total.cast("array<string>"), " "))
    read = media_frames(media, samples=False)
    return read.select(
        "doc_id", "n_bytes", F.col("shown_bytes").alias("payload_bytes"), F.col("shown_sha256").alias("payload_sha256"), F.col("shown_crc32").alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"), "fault",
    )
