"""Removal of every byte that a repeated string of a given number of bytes covers.

Suffixes are sorted blockwise with a difference cover (suffixes.py); a string is repeated where
neighbours in suffix order agree in its whole length, so one order serves several lengths.
Which suffixes may be neighbours is settled first, by content: each window of the least length
is owned by an anchor, its block of the least hash, and equal windows have equal blocks at the
same offset. So all suffixes whose windows can be equal are in the bucket of one block, buckets
are dealt to tasks, and a task sorts some buckets at a time. Windows in a bucket that holds one
text alone need no sorting: if that text is there twice, all its windows repeat.

A bucket of more than LARGE places could be any size. Its windows are cut into nodes of NODE
neighbours and compared by hash: by what all windows of a node share, by the whole of a node,
and last window by window.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import content_keys, freed, frequent, heaviest, looked_up, repeated_rows, saved, scratch, text_of
from .suffixes import repeated

SPAN = 400
#: Repeated strings of so many bytes are reported beside, and removed by the pipeline: passages of 50 words are shorter than SPAN.
SHORT = 256
BLOCK = 48
NODE = 16
#: Places of a bucket that is sorted in one task, at most.
LARGE = 8192
#: Parts that places of a large bucket are dealt to.
PARTS = 256
#: Bytes of text that are sorted at once, about; no bucket of at most LARGE places is over LARGE * (2 * SHORT + SPAN).
SORTED = 3 << 19
#: Windows that are hashed at once, whatever the length of texts.
CHUNK = 1 << 16
#: Rows of an Arrow batch that goes back to Spark, about.
ROWS = 1 << 14
_INDEX_BITS = 17
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes((b,)), 7) for b in range(256)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2 ** 64, to the powers 0 to n - 1."""
    if n not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[n] = both[0], both[1]
    return _POWERS[n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def anchors(buffer: np.ndarray, ends: np.ndarray, span: int = SHORT, block: int = BLOCK):
    """Arrays (document, place, first, last) for each chunk of a buffer of documents.

    place is the anchor's offset in its document, first to last are the offsets of the windows
    that own it. A rolling hash picks anchors and does nothing else, so its collisions are
    harmless. Where a chunk ends, an anchor's windows may be cut in two.
    """
    reach, n = span - block + 1, len(buffer)
    power, inverse = _powers(CHUNK + 2 * span)
    starts = np.concatenate([[0], ends[:-1]])
    mask = np.uint64((1 << _INDEX_BITS) - 1)
    for a in range(0, n - span + 1, CHUNK):
        count = min(CHUNK, n - span + 1 - a)
        x = buffer[a : a + count + span - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_LETTERS[x] * power[: len(x)], out=sums[1:])
        places = len(x) - block + 1
        least = (_mixed((sums[block:] - sums[:places]) * inverse[:places]) & ~mask) | np.arange(places, dtype=np.uint64)
        size = 1
        while 2 * size <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:count], least[reach - size : reach - size + count])
        d0, d1 = np.searchsorted(ends, (a, a + count - 1), side="right")
        own = ends[d0 : d1 + 1]
        parts = np.minimum(own, a + count) - np.maximum(starts[d0 : d1 + 1], a)
        whole = np.flatnonzero(np.arange(a + span, a + span + count) <= np.repeat(own, parts))
        if not len(whole):
            continue
        at = (least[whole] & mask).astype(np.int64)
        turn = np.flatnonzero((at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1))
        first, last = whole[np.append(0, turn + 1)], whole[np.append(turn, len(whole) - 1)]
        at = at[np.append(0, turn + 1)]
        doc = np.searchsorted(ends, a + at, side="right")
        base = a - starts[doc]
        yield doc, at + base, first + base, last + base


PLACES = "k1 long, k2 long, place int, first int, last int, stop int, name long, class long"


def _places(contents: DataFrame, span: int, reach: int, block: int) -> DataFrame:
    """Every anchor: its windows' text goes from first to stop, `reach` bytes after the last window's start or up to the text's end.

    name is a hash of the anchor's block and class one of the text and of the place of the
    anchor and the windows in it: 128 bits, two functions that share nothing.
    """
    names = [c.split()[0] for c in PLACES.split(", ")]
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            ends = np.cumsum([len(r) for r in raw])
            data = b"".join(raw)
            view = memoryview(data)
            for doc, place, first, last in anchors(np.frombuffer(data, np.uint8), ends, span, block):
                size = np.array([len(raw[d]) for d in range(int(doc[0]), int(doc[-1]) + 1)])[doc - doc[0]]
                stop, base = np.minimum(last + reach, size), ends[doc] - size
                name = [digest(view[p : p + block]) for p in (base + place).tolist()]
                seeds = (place - first) << 20 | (last - first)
                kind = [xxhash.xxh64_intdigest(view[x:y], s) for x, y, s in zip((base + first).tolist(), (base + stop).tolist(), seeds.tolist(), strict=True)]
                hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (name, kind)]
                yield pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), *(pa.array(v.astype(np.int32)) for v in (place, first, last, stop)), *hashes], names)

    return contents.filter(F.octet_length("text") >= span).select("k1", "k2", "text").mapInArrow(run, PLACES)


def _with_texts(contents: DataFrame, places: DataFrame, make, schema: str) -> DataFrame:
    """make(bytes of a text, one of its places) gives rows; they come out for every place, some thousands at a time."""
    fields = [c for c in places.columns if c not in ("k1", "k2")]
    lists = places.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("items"))
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")), strict=True)

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, types, strict=True)], names)

    def run(batches):
        for b in batches:
            rows = []
            for k1, k2, text, items in zip(*(b.column(n) for n in ("k1", "k2", "text", "items")), strict=True):
                raw, k1, k2 = text.as_py().encode(), k1.as_py(), k2.as_py()
                for item in items:
                    rows += [(k1, k2, *row) for row in make(raw, item.as_py())]
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    return contents.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "items").mapInArrow(run, schema)


RANGES = "k1 long, k2 long, start int, end int, level int"
_RANGE_NAMES = [c.split()[0] for c in RANGES.split(", ")]


def _ranges_of(k1, k2, first, last, stop, texts, levels):
    """A batch of RANGES of places whose buckets are whole; rows of arrays, texts from first to stop."""
    count = last - first + 1
    row = np.repeat(np.arange(len(first)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = stop - first
    found = repeated(b"".join(texts), (np.cumsum(size) - size)[row] + step, size[row] - step, levels)
    out = [[] for _ in range(5)]
    for level, flags in zip(levels, found, strict=True):
        hit = np.flatnonzero(flags)
        turn = np.flatnonzero((row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1))
        a, z = hit[np.append(0, turn + 1)] if len(hit) else hit, hit[np.append(turn, len(hit) - 1)] if len(hit) else hit
        for column, v in zip(out, (k1[row[a]], k2[row[a]], first[row[a]] + step[a], first[row[a]] + step[z] + level, np.full(len(a), level)), strict=True):
            column.append(v)
    types = [pa.int64()] * 2 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), k) for v, k in zip(out, types, strict=True)], _RANGE_NAMES)


def _sorted_ranges(texts: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Rows (k1, k2, name, first, last, stop, piece), sorted by name in each partition, as RANGES; whole buckets are sorted, some at a time."""

    def run(batches):
        def done(t):
            number = lambda n: t.column(n).to_numpy().astype(np.int64)
            return _ranges_of(*map(number, ("k1", "k2", "first", "last", "stop")), t.column("piece").to_pylist(), levels)

        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            name = held.column("name").to_numpy()
            turns = np.append(0, np.flatnonzero(name[1:] != name[:-1]) + 1)
            size = np.cumsum(held.column("stop").to_numpy().astype(np.int64) - held.column("first").to_numpy())
            at = 0
            for turn in turns[1:].tolist():
                if size[turn - 1] - (size[at - 1] if at else 0) >= SORTED:
                    yield done(held.slice(at, turn - at))
                    at = turn
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield done(held)

    return texts.mapInArrow(run, RANGES)


def _nodes(contents: DataFrame, places: DataFrame, levels: tuple[int, ...], node: int) -> DataFrame:
    """Groups of at most `node` windows of each place and level: hashes of what all of them share and of all they hold."""

    def make(raw, x):
        place, rows = x["place"], []
        for level in levels:
            back, ahead = place - min(x["last"], len(raw) - level), place - x["first"]
            for j in range(back // node * node, ahead + 1, node):
                low, high = max(back, j), min(ahead, j + node - 1)  # windows begin `low` to `high` bytes before the place
                core = xxhash.xxh3_128_intdigest(raw[place - j : place - j - node + 1 + level], seed=j << 16 | level)
                whole = xxhash.xxh3_64_intdigest(raw[place - high : place - low + level], seed=high << 16 | low)
                signed = [h - (1 << 63) for h in (core >> 64, core & (1 << 64) - 1, whole)]
                rows.append((place - high, place - low, level, *signed))
        return rows

    return _with_texts(contents, places, make, "k1 long, k2 long, first int, last int, level int, core1 long, core2 long, whole long")


def _large_ranges(contents: DataFrame, places: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """RANGES of places in buckets of any size, by hashes of nodes and then of windows; no bucket meets in one task."""
    ranges = lambda df: df.select("k1", "k2", F.col("first").alias("start"), (F.col("last") + F.col("level")).alias("end"), "level")
    core = ["core1", "core2"]
    nodes = saved(_nodes(contents, places, levels, NODE), "nodes")
    open_nodes = saved(repeated_rows(nodes, core), "open-nodes")
    whole = saved(repeated_rows(open_nodes, [*core, "whole"]).select("k1", "k2", "first", "last", "level"), "whole-nodes")
    # a node that is there twice has repeated windows only; windows of the others may equal its windows too
    same = ["k1", "k2", "first", "last", "level"]
    apart = open_nodes.select(*same).join(whole, same, "left_anti").withColumn("mine", F.lit(True))
    once = open_nodes.join(whole, same, "left_semi").dropDuplicates([*core, "whole"]).select(*same).withColumn("mine", F.lit(False))
    again = apart.union(once).select("k1", "k2", F.struct("first", "last", "level", "mine").alias("x"))

    def make(raw, item):
        x = item["x"]
        hashes = [(at, xxhash.xxh3_128_intdigest(raw[at : at + x["level"]], seed=x["level"])) for at in range(x["first"], x["last"] + 1)]
        return [(at, at, x["level"], (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), int(x["mine"])) for at, h in hashes]

    windows = saved(_with_texts(contents, again, make, "k1 long, k2 long, first int, last int, level int, core1 long, core2 long, mine int"), "windows")
    out = ranges(whole).union(ranges(repeated_rows(windows, core).filter("mine = 1")))
    return saved(out, "large-ranges")


def repeated_ranges(contents: DataFrame, levels: tuple[int, ...], block: int = BLOCK) -> DataFrame:
    """RANGES: bytes covered by strings of `level` bytes, for each level, that begin twice or more.

    contents holds each distinct text once, as (k1, k2, text). Places are dealt by their
    block; those of a frequent block by their document too, so that no task gets all of it.
    """
    levels = tuple(sorted(levels))
    found = saved(_places(contents, levels[0], levels[-1], block), "places")
    hot = F.broadcast(frequent(found, ["name"], LARGE).withColumn("hot", F.lit(True)))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("k1", "k2"), F.lit(PARTS))).otherwise(F.lit(-1))
    dealt = found.join(hot, "name", "left").withColumn("part", part)
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    bucket = Window.partitionBy("name", "part").orderBy("class", "k1")
    kind = Window.partitionBy("name", "part", "class").orderBy("k1")
    dealt = dealt.withColumn("rows", F.count("*").over(bucket.rowsBetween(*every)))
    dealt = dealt.withColumn("mixed", F.min("class").over(bucket.rowsBetween(*every)) != F.max("class").over(bucket.rowsBetween(*every)))
    dealt = dealt.withColumn("copies", F.count("*").over(kind.rowsBetween(*every))).withColumn("nth", F.row_number().over(kind))
    large = F.coalesce("hot", F.lit(False)) | (F.col("rows") > LARGE)
    dealt = dealt.withColumn("large", large).filter("copies > 1 OR mixed OR large")
    kept = saved(dealt.select("k1", "k2", "place", "first", "last", "stop", "name", "copies", "nth", "mixed", "large"), "repeated-places")
    freed(found)

    # the text of a class that is there twice is repeated from end to end
    level = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    settled = kept.filter("copies > 1").select("*", level).filter("stop - first >= level")
    ranges = settled.select("k1", "k2", F.col("first").alias("start"), F.least(F.col("last") + F.col("level"), F.col("stop")).alias("end"), "level")
    one = kept.filter("nth = 1 AND (mixed OR large)")
    texts = _with_texts(contents, one.filter("NOT large").select("k1", "k2", "name", "first", "last", "stop"), lambda raw, x: [(x["name"], x["first"], x["last"], x["stop"], raw[x["first"] : x["stop"]])], "k1 long, k2 long, name long, first int, last int, stop int, piece binary")
    ranges = ranges.union(_sorted_ranges(texts.repartition("name").sortWithinPartitions("name"), levels))
    big = one.filter("large").select("k1", "k2", "place", "first", "last")
    if not big.isEmpty():
        ranges = ranges.union(_large_ranges(contents, big, levels))
    ranges = saved(ranges, "ranges")
    freed(kept)
    return ranges


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


CUTS = "k1 long, k2 long, n_removed long, n_repeated long, n_spans long, kept_sha256 string, kept string"


def cut_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, short: int | None = None, texts: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(CUTS of each distinct text that has repeated bytes, the keys of the most frequent texts).

    k1 and k2 are content_keys of the text. A text that several rows hold is repeated whole
    if it is long enough; texts shorter than span, null and empty ones never lose any byte.
    Spans are judged on the input. n_repeated counts the bytes that repeated strings of
    `short` bytes cover (of span bytes where short is None). kept, filled with `texts`, is the
    rest of the text less the characters that a cut leaves in part.
    Each distinct text is written once, bucketed by its keys, so later joins don't move texts;
    what is written on the way is freed.
    """
    spark, short = docs.sparkSession, short or span
    whole = docs.select(text_of(text).alias("text")).select(*content_keys(F.col("text")), "text")
    once = whole.groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.first("text").alias("text"))
    name, path = f"contents_{uuid.uuid4().hex}", scratch(spark, "contents")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "k1", "k2").saveAsTable(name)
    contents = spark.table(name)
    contents.saved_at = path
    ranges = repeated_ranges(contents, tuple({short, span}), block)
    lists = ranges.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "level")).alias("ranges"))

    def cut(raw: bytes, ranges: list[dict]) -> tuple:
        by = {level: [(r["start"], r["end"]) for r in some] for level, some in groupby(sorted(ranges, key=lambda r: r["level"]), key=lambda r: r["level"])}
        spans = merged(by.get(span, []))
        keep = [raw[a:z] for a, z in pairwise([0, *(x for s in spans for x in s), len(raw)])][::2]
        # each part apart, so that no two halves make a new character
        said = "".join(k.decode(errors="ignore") for k in keep) if texts else None
        total = lambda runs: sum(z - a for a, z in runs)
        return total(spans), total(merged(by.get(short, []))), len(spans), hashlib.sha256(b"".join(keep)).hexdigest(), said

    def run(batches):
        for b in batches:
            rows = [cut(t.encode(), r) for t, r in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(5)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], ["k1", "k2", "n_removed", "n_repeated", "n_spans", "kept_sha256", "kept"])

    parts = contents.filter("rows = 1").select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "ranges").mapInArrow(run, CUTS)
    n = F.octet_length("text").cast("long")
    gone, zero = n >= span, F.lit(0).cast("long")
    copied = contents.filter((F.col("rows") > 1) & (n >= short)).select(
        "k1", "k2", F.when(gone, n).otherwise(zero).alias("n_removed"), n.alias("n_repeated"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256)).alias("kept_sha256"), F.when(F.lit(texts), F.when(gone, "").otherwise(F.col("text"))).alias("kept"),
    )
    cuts = saved(parts.unionByName(copied), "cuts")
    heavy = saved(heaviest(contents, ["k1", "k2"], "rows"), "heavy-texts")
    spark.sql(f"DROP TABLE {name}")
    freed(contents, ranges)
    return cuts, heavy


def dedup_report(docs: DataFrame, text: str = "text", span: int = SPAN, short: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated) for each row of docs.

    Repeated rows stay and lose all (each is the other's repetition); null and empty texts
    lose nothing; an empty table gives none; other columns of docs are not read.
    """
    cuts, heavy = cut_repeats(docs, text, span, short, block=block)
    own = docs.select("doc_id", text_of(text).alias("text"))
    own = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), *content_keys(F.col("text")))
    found = looked_up(own, cuts.drop("kept"), ["k1", "k2"], heavy)
    zero = lambda n: F.coalesce(f"found.{n}", F.lit(0).cast("long")).alias(n)
    return found.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("found.kept_sha256", "whole").alias("kept_sha256"), zero("n_repeated"))


def without_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """docs with their text less its repeated bytes; characters that a cut leaves in part go too.

    Rows and all other columns stay, whatever their names; a null text stays null. A text
    that several rows hold goes from all of them if it has span bytes.
    """
    cuts, heavy = cut_repeats(docs, text, span, texts=True, block=block)
    k1, k2 = content_keys(text_of(text))
    keyed = docs.select(F.struct("*").alias("row"), k1, k2)
    found = looked_up(keyed, cuts.select("k1", "k2", "kept"), ["k1", "k2"], heavy)
    kept: Column = F.when(F.col(f"row.`{text}`").isNotNull(), F.coalesce("found.kept", f"row.`{text}`"))
    return found.select(*[kept.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
