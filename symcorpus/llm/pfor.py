"""Token-id files: patched frame-of-reference blocks, and their order over all documents.

A file holds whole documents in doc_id order. Its bytes: the magic, block length, number of
ids and of blocks, the index of block starts, then the blocks. A block holds its minimum, the
width that fits most of its ids less the minimum, the packed ids, and its exceptions as a list
of places and values. Files are rows of a Parquet table in the shared folder, which any
executor can read; memory is bounded by a file or by one document, whichever is larger.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import word_encoder
from .shared import saved

MAGIC = b"PFR1"
BLOCK = 512
PERCENT = 95
#: Ids after which a file is closed at the next end of a document.
FILE_IDS = 1 << 16


def encode_blocks(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as the bytes of one file."""
    n = len(ids)
    count = -(-n // BLOCK)
    padded = np.full(count * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    blocks = padded.reshape(count, BLOCK)
    least = blocks.min(axis=1, initial=0xFFFFFFFF) if count else np.zeros(0, np.uint32)
    above = blocks - least[:, None]
    usual = np.sort(above, axis=1)[:, BLOCK * PERCENT // 100] if count else least
    width = np.array([int(v).bit_length() for v in usual], np.int64)
    body: list[bytes] = [b""] * count
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        part = above[own]
        odd = (part >> np.uint32(w)) > 0 if w < 32 else np.zeros(part.shape, bool)
        low = part & np.uint32((1 << int(w)) - 1)
        bits = (low[:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        for k, at in enumerate(own):
            places = np.flatnonzero(odd[k]).astype("<u2")
            head = struct.pack("<IBH", int(least[at]), int(w), len(places))
            body[at] = head + packed[k].tobytes() + places.tobytes() + part[k][places].astype("<u4").tobytes()
    starts = np.cumsum([0, *map(len, body)]).astype("<u8")
    return MAGIC + struct.pack("<HQI", BLOCK, n, count) + starts.tobytes() + b"".join(body)


def decode_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (not included) of a file, all by default; the index finds them."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id file")
    block, n, count = struct.unpack_from("<HQI", data, 4)
    last = count if last is None else min(last, count)
    starts = np.frombuffer(data, "<u8", count + 1, 18)
    base = 18 + 8 * (count + 1)
    heads = [struct.unpack_from("<IBH", data, base + int(starts[k])) for k in range(first, last)]
    out = np.zeros((max(last - first, 0), block), np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        own, size = np.flatnonzero(width == w), block * int(w) // 8
        if w:
            packed = np.stack([np.frombuffer(data, np.uint8, size, base + int(starts[first + k]) + 7) for k in own])
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), block, int(w))
            full = np.zeros((len(own), block, 32), np.uint8)
            full[:, :, : int(w)] = bits
            out[own] = np.packbits(full, axis=2, bitorder="little").view("<u4")[..., 0]
    for k, (least, w, odd) in enumerate(heads):
        at = base + int(starts[first + k]) + 7 + block * w // 8
        if odd:
            out[k, np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
        out[k] += np.uint32(least)
    return out.ravel()[: max(min(n, last * block) - first * block, 0)]


FILES = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<int>, data binary"


def write_files(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """Encodes whole texts and writes files of ids; returns the table of files.

    Documents are dealt by ranges of doc_id (nulls first) and of the text's beginning, which
    parts null and repeated ids, and sorted by doc_id and text, so part, seq and the place in a
    file give the order over all. A null text is empty; every document ends with end_id, so an empty one
    has one id. Repeated rows stay, an empty table gives no file, other columns are not read.
    """

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        doc_ids, parts, size = [], [], 0

        def closed():
            ids = np.frombuffer(b"".join(parts), "<u4")
            values = [[part], [seq], [len(ids)], [doc_ids], [[len(p) // 4 for p in parts]], [encode_blocks(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "seq", "n_ids", "doc_ids", "lengths", "data"])

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= FILE_IDS:
                    yield closed()
                    seq, doc_ids, parts, size = seq + 1, [], [], 0
        if parts:
            yield closed()

    rows = docs.select("doc_id", F.col(text).alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return saved(rows.mapInArrow(run, FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the table of files.

    start counts the ids of all documents before: those of earlier parts, of earlier files
    of the part, and of earlier documents in the file. Only counts are summed over files.
    """

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = decode_blocks(row["data"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(ids[a:e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(run, "part int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    counts = files.select("part", "seq", "n_ids")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition of the write, whose number is a setting
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("parts_before"))
    within = counts.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("files_before"))
    bases = within.join(parts, "part").select("part", "seq", (F.col("parts_before") + F.col("files_before")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
