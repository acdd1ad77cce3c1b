"""SimHash near-duplicates: bit planes, carry-save counters, abandoned blocks.

Fingerprints within radius r agree on at least one part when their bits are cut into r + 1
parts, on two of r + 2 parts, and so on. Every fingerprint goes to one bucket for each choice
of agreeing parts; a bucket is compared by bit planes. No link is lost whatever the number of
parts; it only sets how large buckets are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import content_keys, heaviest, looked_up, saved, text_of

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of a bucket that one task compares at once; larger buckets are cut into tiles.
TILE = 8192
#: Rows that a task of the comparison holds at once, whole buckets of at most 2 * TILE apart.
HELD = 1 << 18
#: Pairs of a fingerprint and a word of 64 lanes that are compared in one step.
STEP = 1 << 16
#: Shingle hashes that are held at once.
PART = 1 << 14
#: Least hashes of a band; texts of similarity s share one of b bands with chance 1 - (1 - s ** BAND_ROWS) ** b.
BAND_ROWS = 3
#: For texts of five-word similarity 0.8 or more: nine in ten of such fingerprints differ in 14 bits or fewer, 99.7 % of such texts share a band.
WIDE = {"radius": 14, "shingle": 5, "bands": 8}
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALTS, _FACTORS = (np.array([xxhash.xxh64_intdigest(bytes((k,)), seed) | 1 for k in range(64)], np.uint64) for seed in (1, 2))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in parts of at most PART; of the whole sequence where it is shorter."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(line, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-shingle] + 1)
    ends = ends[shingle - 1 :]
    for k in range(0, len(starts), PART):
        a, z = starts[k : k + PART].tolist(), ends[k : k + PART].tolist()
        yield np.fromiter((digest(line[x:y], SEED) for x, y in zip(a, z, strict=True)), np.uint64, len(a))


def sketch(text: bytes, shingle: int = SHINGLE, bands: int = 0) -> tuple[int, list[int]]:
    """The unsigned 64-bit SimHash of a text's word shingles (zero where there is no word) and the keys of its bands.

    A band's key stands for its BAND_ROWS least hashes of shingles under as many functions.
    """
    counts, n, least = np.zeros(64, np.int64), 0, np.full(bands * BAND_ROWS, ONES)
    for part in shingle_hashes(text, shingle):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
        if bands:
            mixed = (part ^ _SALTS[: len(least), None]) * _FACTORS[: len(least), None]
            least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    if not n:
        return 0, []
    keys = [xxhash.xxh3_64_intdigest(least[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), k) for k in range(bands)]
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]), keys


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text alone."""
    return sketch(text, shingle)[0]


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, bands: int = 0) -> DataFrame:
    """(doc_id, k, fp, bands) for each row of docs, k a hash of the text, fp and bands signed longs. A null text has no words."""

    def run(batches):
        for b in batches:
            made = [sketch((t or "").encode(), shingle, bands) for t in b.column("text").to_pylist()]
            fps = np.array([fp for fp, _ in made], np.uint64).view(np.int64)
            keys = [np.array(keys, np.uint64).view(np.int64) for _, keys in made]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "k", "fp", "bands"])

    rows = docs.select("doc_id", text_of(text).alias("text")).select("doc_id", content_keys(F.col("text"))[0].alias("k"), "text")
    return rows.mapInArrow(run, "doc_id long, k long, fp long, bands array<long>")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: word w of plane p holds bit p of fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_masks(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, word): a mask of the lanes at radius or fewer differing bits.

    Carry-save counters of one bit each per lane count the differing planes; a lane that
    passes the radius is dead, and a word with no live lane is abandoned.
    """
    out = np.zeros(len(query), np.uint64)
    here, live = np.arange(len(query)), lanes.copy()
    width = (radius + 4).bit_length()
    counter = np.zeros((width, len(query)), np.uint64)
    for p in range(64):
        flip = (ONES * (query >> np.uint64(p) & np.uint64(1))).astype(np.uint64)
        carry = planes[p][word] ^ flip
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        if p % 4 == 3 or p == 63:
            over = _over(counter, radius)
            live &= ~over
            # dead lanes restart, so that a counter never wraps round
            counter &= ~over
            keep = live != 0
            if not keep.all():
                here, live, counter, query, word = here[keep], live[keep], counter[:, keep], query[keep], word[keep]
            if not len(here):
                return out
    out[here] = live
    return out


def _over(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, by comparing from the top bit."""
    above, same = np.zeros_like(counter[0]), np.full_like(counter[0], ONES)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            above |= same & counter[k]
            same &= ~counter[k]
    return above


class _Forest:
    """Union of rows by least label; edges come out as row to root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            a, b = low[apart], high[apart]
            np.minimum.at(self.root, b, a)
            while not np.array_equal(nearer := self.root[self.root], self.root):
                self.root = nearer


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside buckets; rows of a bucket are adjacent."""
    n = len(fps)
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(ends, prepend=0))
    planes, forest = _planes(fps), _Forest(n)
    row = np.arange(n)
    words = (end - 1) // 64 - (row + 1) // 64 + 1
    words[end - row < 2] = 0
    bounds = np.searchsorted(np.cumsum(words), np.arange(STEP, int(words.sum()) + STEP, STEP), side="left")
    for a, b in zip([0, *(bounds[:-1] + 1)], bounds + 1, strict=True):
        some = words[a:b]
        if not some.sum():
            continue
        query = np.repeat(row[a:b], some)
        word = np.repeat((row[a:b] + 1) // 64, some) + np.arange(len(query)) - np.repeat(np.cumsum(some) - some, some)
        first, last = query + 1 - 64 * word, end[query] - 64 * word  # lanes [first, last) belong to the bucket
        lanes = np.where(first > 0, ONES << np.maximum(first, 0).astype(np.uint64), ONES)
        lanes &= np.where(last < 64, ~(ONES << np.minimum(last, 63).astype(np.uint64)), ONES)
        mask = near_masks(planes, fps[query], word, lanes, radius)
        hit = np.flatnonzero(mask)
        bits = np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(bits)
        forest.join(query[hit[at]], 64 * word[hit[at]] + lane)
    far = np.flatnonzero(forest.root != row)
    return fps[far], fps[forest.root[far]]


def _compare(batches, radius: int):
    """Rows (key, fp), sorted by key, as edges (u, v)."""

    def out(keys, fps):
        u, v = _links(keys, fps.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        keys = np.concatenate([keys, b.column("key").to_numpy()])
        fps = np.concatenate([fps, b.column("fp").to_numpy()])
        if len(keys) >= HELD:
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut:
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(keys, fps)


def _part_masks(parts: int) -> list[int]:
    sizes = [64 // parts + (k < 64 % parts) for k in range(parts)]
    starts = [sum(sizes[:k]) for k in range(parts)]
    return [((1 << n) - 1) << s for n, s in zip(sizes, starts, strict=True)]


def bucket_keys(fp: Column, radius: int, parts: int) -> Column:
    """One key for each choice of parts - radius agreeing parts."""
    masks = _part_masks(parts)
    keys = []
    for k, chosen in enumerate(combinations(masks, parts - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def parts_for(n: int, radius: int) -> int:
    """The least number of parts whose buckets hold 512 of n random fingerprints, 4 above the least at most."""
    parts = radius + 1
    while parts < radius + 4 and n >> (64 * (parts - radius) // parts) > 512:
        parts += 1
    return parts


def near_links(fps: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp), enough to join all within radius. No link is lost."""
    parts = parts or parts_for(fps.count(), radius)
    return bucket_links(fps.select(F.explode(bucket_keys(F.col("fp"), radius, parts)).alias("key"), "fp"), radius)


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that join all fingerprints within radius that share a bucket, from distinct rows (key, fp).

    Buckets of over TILE members are cut by hash into tiles and every pair of tiles is
    compared, each in a task of its own; one task holds at most two tiles and HELD rows.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cut = looked_up(keyed, sizes, ["key"], heaviest(sizes, ["key"])).filter("found IS NOT NULL")
    cut = cut.withColumn("g", F.ceil(F.col("found.n") / TILE).cast("long"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda x: F.xxhash64("key", F.least(own, x), F.greatest(own, x)))
    tiles = cut.select(F.explode(F.when(F.col("g") == 1, F.array("key")).otherwise(pair)).alias("key"), "fp")
    edges = tiles.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, radius), "u long, v long")
    return edges.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, bands: int = 0) -> DataFrame:
    """(doc_id, k, fp, root, component_id) for each row of docs.

    Rows that links of at most radius differing bits join share root, one of their
    fingerprints; component_id is their smallest doc_id. Without bands every pair of
    fingerprints within radius is linked; with bands only those whose texts share one of
    `bands` bands of BAND_ROWS least shingle hashes, so a wide radius links no chance pairs.
    Texts without words have fingerprint zero and are linked like any other. Rows with a null
    doc_id never name a component, so a component of such rows alone has a null one; repeated
    rows stay; an empty table gives none; other columns of docs are not read. k is a hash of
    the text.
    """
    marks = saved(fingerprints(docs, text, shingle, bands), "fingerprints")
    least = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = bucket_links(marks.select(F.explode("bands").alias("key"), "fp").distinct(), radius) if bands else near_links(least.select("fp"), radius)
    rooted = components(edges)
    joined = least.join(rooted, least.fp == rooted.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = looked_up(joined, roots, ["root"], heaviest(roots, ["root"]))
    named = saved(named.select("fp", "n", "root", "found.component_id"), "components")
    found = looked_up(marks, named.drop("n"), ["fp"], heaviest(named, ["fp"]))
    return found.select("doc_id", "k", "fp", "found.root", "found.component_id")


def keep_one(docs: DataFrame, text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, bands: int = 0) -> DataFrame:
    """docs with one row of each near-duplicate group, with all its columns, whatever their names.

    That of the smallest doc_id stays; of several rows with that doc_id, or of a group
    without any, one with the least text hash; of rows equal in both, any one. Null and empty
    texts are near-duplicates of each other; an empty table stays empty.
    """
    marks = near_duplicates(docs, text, radius, shingle, bands).filter("doc_id <=> component_id")
    winners = marks.groupBy("root", "component_id").agg(F.min("k").alias("k"))
    # the id and whether it is null, as plain keys: the rows of a winner are then in one partition
    plain = [F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__none"), F.col("k").alias("__k")]
    keys = ["__id", "__none", "__k"]
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), content_keys(text_of(text))[0].alias("k")).select("row", *plain)
    chosen = keyed.join(winners.select(F.col("component_id").alias("id"), "k").select(*plain), keys, "left_semi")
    return chosen.dropDuplicates(keys).select("row.*")


def hex16(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
