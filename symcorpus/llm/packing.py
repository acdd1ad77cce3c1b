"""Best-fit packing of documents into sequences, planned on the counts of piece lengths.

Pieces of one length are interchangeable, so the plan needs only how many there are of each
length: at most `capacity` numbers, whatever the corpus. The plan says which bins hold which
lengths; a document finds its place by its rank among the documents of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import byte_encoder
from .shared import saved

CAPACITY = 1024
PARTS = 256
#: Pieces of a document that its sequence numbers leave room for: 2 ** 20.
PIECE_BITS = 20


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in order, number of such bins) for counts[length] pieces.

    Lengths above a third of the capacity are large: greedy matching pairs the longest left
    with the longest that fits beside it, at most two a bin. Then every smaller length, from
    long to short, goes to the bins with the least gap that holds it, or to new bins. Each
    step moves all bins or pieces of a kind at once, so steps do not grow with the counts.
    """
    left = {s: n for s, n in counts.items() if n}
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for s in large:
        while left.get(s):
            mate = next((t for t in large if left.get(t) and t <= s and s + t <= capacity and (t != s or left[s] > 1)), None)
            if mate is None:
                open_bins[capacity - s][(s,)] += left.pop(s)
                continue
            n = left[s] // 2 if mate == s else min(left[s], left[mate])
            left[s] -= n
            left[mate] -= n
            open_bins[capacity - s - mate][(s, mate)] += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g, bins in open_bins.items() if g >= s and bins), default=None)
            if gap is None:
                each = capacity // s
                if left[s] >= each:
                    open_bins[capacity - each * s][(s,) * each] += left[s] // each
                if left[s] % each:
                    open_bins[capacity - left[s] % each * s][(s,) * (left[s] % each)] += 1
                left[s] = 0
                continue
            kind, have = next(iter(open_bins[gap].items()))
            n = min(have, left[s])
            open_bins[gap].pop(kind)
            if have > n:
                open_bins[gap][kind] = have - n
            open_bins[gap - s][(*kind, s)] += n
            left[s] -= n
    return [(kind, n) for gap in sorted(open_bins) for kind, n in open_bins[gap].items()]


def slots(bins: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of every place in the plan."""
    used: dict[int, int] = defaultdict(int)
    base, out = 0, []
    for kind, n in bins:
        offset = 0
        for s in kind:
            out.append((s, used[s], used[s] + n, base, offset))
            used[s] += n
            offset += s
        base += n
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, crcs) for each row: ids with the end id, and the CRC-32 of each piece's ids.

    The first piece has n_tokens mod capacity ids (capacity, where that is 0), every other
    one capacity. A null text is empty and has the end id alone.
    """

    def run(batches):
        encoder, end = byte_encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            ids = [i + end for i in encoder.encode(b.column("text").to_pylist())]
            crcs = []
            for i in ids:
                first = (len(i) // 4 - 1) % capacity * 4 + 4
                crcs.append([zlib.crc32(i[:first]), *(zlib.crc32(i[k : k + 4 * capacity]) for k in range(first, len(i), 4 * capacity))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "crcs"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Sequences hold at most capacity ids without gaps. Only first pieces are packed, the
    others fill a sequence each, numbered below zero. Rows with a null or repeated doc_id
    are documents of their own; a null text is empty, an empty table gives no row, other
    columns of docs are not read. The counts of at most capacity lengths, and the plan made
    from them, are all that the driver holds; ids are never shuffled.
    """
    made = saved(token_pieces(docs, tokenizer, end_id, capacity, text), "pieces")
    first = ((F.col("n_tokens") - 1) % capacity + 1).cast("int")
    # by hash, so that ids of one residue, null ids and repeated ids are spread
    part = F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(PARTS)).cast("int")
    rows = made.withColumn("first", first).withColumn("part", part)
    counts = rows.groupBy("first", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    lengths = {r["first"]: r["n"] for r in counts.groupBy("first").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.createDataFrame(slots(plan_bins(lengths, capacity), capacity), "length int, from_rank long, to_rank long, base long, offset long")
    # bases has at most capacity * PARTS rows of 20 bytes; places grow with capacity alone
    ranked = rows.join(F.broadcast(bases), ["first", "part"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("first", "part").orderBy("doc_id", "n_tokens", "crcs")) - 1
    ranked = ranked.withColumn("rank", rank)
    placed = ranked.join(F.broadcast(places), (F.col("first") == F.col("length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    sequence = F.col("base") + F.col("rank") - F.col("from_rank")
    whole = placed.select("doc_id", "n_tokens", "first", "rank", sequence.alias("packed"), "offset", F.posexplode("crcs").alias("piece", "ids_crc32"))
    later = F.col("piece") > 0
    alone = -1 - F.shiftleft(F.col("rank") * capacity + F.col("first") - 1, PIECE_BITS) - F.col("piece")
    return whole.select(
        "doc_id",
        "piece",
        F.when(later, F.col("first") + (F.col("piece").cast("long") - 1) * capacity).otherwise(F.lit(0)).cast("long").alias("start"),
        F.when(later, F.lit(capacity)).otherwise(F.col("first")).cast("long").alias("length"),
        "ids_crc32",
        F.when(later, alone).otherwise(F.col("packed")).alias("sequence_id"),
        F.when(later, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    )
