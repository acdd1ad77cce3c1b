"""Substring removal by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frequent, saved, text_of

#: A span has at least RUN sentences and at least WORDS words, or is one piece of WORDS words.
RUN = 2
WORDS = 16
#: A sentence of LONG words or more is cut before the word of the least hash in each window of LONG words.
LONG = 16
#: Documents of the sample that finds frequent spans, about; rows that make a span frequent; parts that these are dealt to.
SAMPLE_DOCS = 2_000
OFTEN = 512
PARTS = 256
#: Spans that a task holds before they go back to Spark, whatever the number and length of texts.
ROWS = 1 << 14
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+[\x20\x09-\x0D]*|$)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def pieces(sentence: str) -> list[str]:
    """A long sentence cut at places that its words choose, so equal words are cut alike wherever they begin."""
    found = list(_WORD.finditer(sentence))
    if len(found) < LONG:
        return [sentence]
    hashes = [crc32(m.group().encode()) for m in found]
    chosen, best = [0], -1
    for last in range(LONG - 1, len(hashes)):
        begin = last - LONG + 1
        if best < begin:
            best = min(range(begin, last + 1), key=hashes.__getitem__)
        elif hashes[last] < hashes[best]:
            best = last
        if best != chosen[-1]:
            chosen.append(best)
    at = [0, *(found[i].start() for i in chosen[1:]), len(sentence)]
    return [sentence[x:y] for x, y in pairwise(at)]


def sentences(text: str) -> list[str]:
    """A text cut into sentences, with the blanks after each; joined they are the text.

    Sentences end with . ! ? or a line; what has no word joins the sentence before.
    """
    out: list[str] = []
    for s in _SENTENCE.findall(text):
        if not s:
            continue
        if not s.strip(" \t\n\r\x0b\x0c.!?") and out:
            out[-1] += s
        elif len(s) < 2 * LONG - 1:
            out.append(s)
        else:
            out += pieces(s)
    return out


def spans(parts: list[str], run: int = RUN, words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first, end, text) of the shortest spans that begin and that end at each sentence, blanks made single.

    Each longer span is covered by these, so a repeated run of sentences is found up to its last
    one. A text too short for a span is one as a whole.
    """
    clean = [" ".join(w for w in _BLANK.split(p) if w).encode() for p in parts]
    counts = np.cumsum([0, *(c.count(b" ") + 1 if c else 0 for c in clean)])
    at = np.arange(len(parts))
    ends = np.searchsorted(counts, counts[:-1] + words)
    ends = np.where(ends == at + 1, ends, np.maximum(ends, at + run))
    starts = np.searchsorted(counts, counts[1:] - words, "right") - 1
    starts = np.where(starts == at, starts, np.minimum(starts, at + 1 - run))
    both = {(i, e) for i, e in enumerate(ends.tolist()) if e <= len(parts)} | {(i, e) for e, i in enumerate(starts.tolist(), 1) if i >= 0}
    joined, place = b" ".join(clean), np.cumsum([0, *(len(c) + 1 for c in clean)]).tolist()
    if both:
        yield from ((i, e, joined[place[i] : place[e] - 1]) for i, e in sorted(both))
    elif counts[-1]:
        yield 0, len(parts), joined.strip()


def _span_table(docs: DataFrame, run_of: int, words: int, most: int = ROWS) -> DataFrame:
    """Places and hashes of all spans; texts are taken one by one, and `most` rows go back at once."""
    names = ["doc_id", "k", "first", "end", "h1", "h2"]

    def batch_of(ids, keys, firsts, ends, digests):
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names)

    def run(batches):
        for b in batches:
            held = [], [], [], [], []
            for doc_id, k, text in zip(b.column("doc_id").to_pylist(), b.column("k").to_pylist(), b.column("text"), strict=True):
                left = spans(sentences(text.as_py()), run_of, words)
                while some := list(islice(left, most - len(held[0]))):
                    firsts, ends, said = zip(*some, strict=True)
                    for column, values in zip(held, ([doc_id] * len(some), [k] * len(some), firsts, ends, map(xxhash.xxh3_128_digest, said)), strict=True):
                        column.extend(values)
                    if len(held[0]) >= most:
                        yield batch_of(*held)
                        held = [], [], [], [], []
            yield batch_of(*held)

    return docs.mapInArrow(run, "doc_id long, k long, first int, end int, h1 long, h2 long")


def drop_repeated_spans(docs: DataFrame, text: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept) for each row of docs.

    A span that occurs again keeps its first occurrence, by doc_id (nulls first), content and
    place; the sentences of every other occurrence go, in the same document as in others.
    Rows with equal doc_id and text count as one document and share its result. A null or
    empty text has no sentence; an empty table gives none; other columns of docs are not read.
    Spans are dealt once, by their hashes, as they are the most bytes. Those of hashes that a
    sample finds frequent (a bounded list) are dealt by document, so that no task gets all of
    one; their first occurrences are then compared over these parts.
    """
    keyed = docs.select("doc_id", text_of(text).alias("text")).select("doc_id", F.xxhash64(F.md5("text")).alias("k"), "text")
    part = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    hot = frequent(_span_table(keyed if part == 1 else keyed.sample(part, 7), run, words), ["h1", "h2"], OFTEN, part)
    place = F.struct("doc_id", "k", "first")
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "k"), F.lit(PARTS))).otherwise(F.lit(-1))
    tagged = _span_table(keyed, run, words).join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["h1", "h2"], "left").withColumn("part", dealt).drop("hot")
    origin = F.min(place).over(Window.partitionBy("h1", "h2", "part"))
    seen = tagged.withColumn("origin", origin).filter(~place.eqNullSafe(F.col("origin")) | (F.col("part") >= 0))
    seen = saved(seen.select("doc_id", "k", "first", "end", F.when(F.col("part") >= 0, F.struct("h1", "h2", "origin")).alias("of")), "repeated-spans")
    # of frequent spans: the least of the parts' origins is the first occurrence
    parts = seen.filter("of IS NOT NULL").groupBy("of.h1", "of.h2").agg(F.min("of.origin").alias("origin"))
    often = seen.filter("of IS NOT NULL").join(F.broadcast(parts.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2")), (F.col("of.h1") == F.col("g1")) & (F.col("of.h2") == F.col("g2")))
    later = seen.filter("of IS NULL").select("doc_id", "k", "first", "end").union(often.filter(~place.eqNullSafe(F.col("origin"))).select("doc_id", "k", "first", "end"))
    lists = later.groupBy("doc_id", "k").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("k").alias("kk"), "ranges")
    joined = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("kk")), "left")

    def cut(batches):
        for b in batches:
            rows = []
            for t, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                parts = sentences(t)
                gone = {i for r in ranges or [] for i in range(r["first"], r["end"])}
                rows.append((len(parts), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone)))
            n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "kept"])

    return joined.select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, kept string")
