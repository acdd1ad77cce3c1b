"""Tokens of two tokenizers over one text, linked where their bytes overlap.

A tokenization is an incidence matrix, tokens by bytes, held as CSR (row pointers and column
numbers). With A and B those of two tokenizers, the rows of A B', taken by Gustavson's way (each
entry of a row of A brings the row of B' that it names, and what comes twice is added up), are the
tokens of B that a token of A overlaps, and by how many bytes. Bytes where tokens of both end cut
them into groups; tokens by groups are two more matrices, whose product links all tokens of a
group. That one can have as many entries as the square of a group's size, so it stays factored
and only its row sizes are worked out.

Texts are encoded once: each row's digests and its distinct linked id pairs are written. Counts of
pairs over the corpus are added up in tasks and shuffled as sums; rows then look their pairs up,
those of the largest counts in a bounded broadcast table, others by a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import _SPELLING, Encoder, byte_cut
from .shared import freed, largest, saved, text_of

#: Entries of one round of the product, and characters of the texts that are worked on at once, about.
BLOCK = 1 << 20
TEXTS = 2 << 20
#: Distinct pairs that a task holds before it hands on their counts.
HELD = 1 << 20
#: Pairs of the broadcast table, 17 bytes each. Any other pair has at most 1 in FREQUENT of all links.
FREQUENT = 262_144


class Csr(NamedTuple):
    """A matrix of ones: row i has the columns cols[rows[i] : rows[i + 1]]."""

    rows: np.ndarray
    cols: np.ndarray


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, of tokens that end at these offsets."""
    return Csr(np.append(0, ends), np.arange(ends[-1] if len(ends) else 0))


def transposed(m: Csr, n_cols: int) -> Csr:
    row = np.repeat(np.arange(len(m.rows) - 1), np.diff(m.rows))
    return Csr(np.append(0, np.cumsum(np.bincount(m.cols, minlength=n_cols))), row[np.argsort(m.cols, kind="stable")])


def product(a: Csr, b: Csr, n_cols: int) -> tuple[Csr, np.ndarray]:
    """The product and its values: how many ways lead from a row of a to a column of b; rows in blocks of BLOCK entries."""
    rows, cols, values = [np.zeros(1, np.int64)], [], []
    n, at = len(a.rows) - 1, 0
    while at < n:
        to = max(int(np.searchsorted(a.rows, a.rows[at] + BLOCK, side="right")) - 1, at + 1)
        named = a.cols[a.rows[at] : a.rows[to]]
        size = b.rows[named + 1] - b.rows[named]
        brought = np.repeat(b.rows[named] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row = np.repeat(np.repeat(np.arange(to - at), np.diff(a.rows[at : to + 1])), size)
        key = row * n_cols + b.cols[brought]
        if (key[1:] < key[:-1]).any():
            key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(np.append(first, len(key)))
        rows.append(rows[-1][-1] + np.cumsum(np.bincount(key // n_cols, minlength=to - at)))
        cols.append(key % n_cols)
        values.append(times)
        at = to
    none = np.zeros(0, np.int64)
    return Csr(np.concatenate(rows), np.concatenate([none, *cols])), np.concatenate([none, *values])


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries of each row of a product whose rows of b share no column: the symbolic half of Gustavson's way."""
    brought = np.append(0, np.cumsum(np.diff(b.rows)[a.cols]))
    return brought[a.rows[1:]] - brought[a.rows[:-1]]


class Alignment(NamedTuple):
    """Links are entries of A B' with their shared bytes; groups are each token's; together: with how many tokens of B each of A shares one."""

    links: Csr
    shared: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int
    together: np.ndarray


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Alignment:
    """Two tokenizations of the same bytes, by the ends of their tokens; both end where the bytes end."""
    n_bytes = int(a_ends[-1]) if len(a_ends) else 0
    links, shared = product(incidence(a_ends), transposed(incidence(b_ends), n_bytes), max(len(b_ends), 1))
    ends = np.zeros((2, n_bytes + 1), bool)
    ends[0, a_ends], ends[1, b_ends] = True, True
    common = np.cumsum(ends[0] & ends[1])
    n_groups = int(common[-1])
    a_group, b_group = common[a_ends - 1], common[b_ends - 1]
    grouped = Csr(np.arange(len(a_group) + 1), a_group)
    members = transposed(Csr(np.arange(len(b_group) + 1), b_group), n_groups)
    return Alignment(links, shared, a_group, b_group, n_groups, product_sizes(grouped, members))


class Tokenizers:
    """A: a byte-level file of the tokenizers library, given a space and the text. B: a sentencepiece model, given the text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a, self.b = Encoder(path_a, byte_cut), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.library.encode_special_tokens = True
        byte = {s: b for b, s in _SPELLING.items()} | {chr(b): b for b in range(256) if b not in _SPELLING}
        spelled = {i: s for s, i in self.a.library.get_vocab(with_added_tokens=True).items()}
        as_bytes = lambda s: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        self.a_bytes = [as_bytes(spelled.get(i, "")) for i in range(max(spelled) + 1)]
        names = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in names]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # what a group's text has for a token: a comma after it, or what ends its side of the group
        said = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.a_said = [said(len(self.a_bytes), mark) for mark in ",|"]
        self.b_said = [said(len(self.b_bytes), mark) for mark in ",;"]

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for each text; None where it is null or empty, or a side's tokens don't have its bytes."""
        some = [t for t in texts if t]
        both = zip(some, self.a.encode([" " + t for t in some]), self.b.encode(some, num_threads=1), strict=True)

        def whole(text, a, b):
            a, raw = np.frombuffer(a, "<u4").astype(np.int64), b" " + text.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) != raw or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
                return None
            return a, np.array(b, np.int64)

        found = iter([whole(*x) for x in both])
        return [next(found) if t else None for t in texts]


class Row(NamedTuple):
    """One text's alignment: numbers of things, the hash of its groups, its distinct pairs (a * 2**32 + b) and their links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    n_shared: int = 0
    groups_sha256: str = ""
    pairs: np.ndarray = np.zeros(0, np.int64)
    times: np.ndarray = np.zeros(0, np.int64)


def aligned_rows(own: Tokenizers, texts: list[str | None]) -> list[Row]:
    """Some texts, aligned as one run of bytes: both tokenizers end a token where a text ends."""
    found = own.encoded(texts)
    whole = [x for x in found if x is not None]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *(x[k] for x in whole)]) for k in range(2))
    x = align(np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b]))
    pairs = a[np.repeat(np.arange(len(a)), np.diff(x.links.rows))] << 32 | b[x.links.cols]
    # tokens in the order of the groups' text: those of A before those of B
    last_a, last_b = (np.diff(g, append=x.n_groups) > 0 for g in (x.a_group, x.b_group))
    said = np.empty(len(a) + len(b), object)
    said[np.arange(len(a)) + np.searchsorted(x.b_group, x.a_group)] = np.where(last_a, own.a_said[1][a], own.a_said[0][a])
    said[np.arange(len(b)) + np.searchsorted(x.a_group, x.b_group, side="right")] = np.where(last_b, own.b_said[1][b], own.b_said[0][b])
    together, ends, groups = np.append(0, np.cumsum(x.together)), x.links.rows, np.append(x.a_group, x.n_groups)
    rows, i, k = [], 0, 0
    for ids_a, ids_b in whole:
        j, m = i + len(ids_a), k + len(ids_b)
        own_pairs, times = np.unique(pairs[ends[i] : ends[j]], return_counts=True)
        digest = hashlib.sha256("".join(said[i + k : j + m].tolist())[:-1].encode()).hexdigest()
        rows.append(Row(j - i, m - k, int(groups[j] - groups[i]), int(ends[j] - ends[i]), int(together[j] - together[i]), digest, own_pairs, times))
        i, k = j, m
    rest = iter(rows)
    return [Row() if y is None else next(rest) for y in found]


def some_texts(batch: pa.RecordBatch) -> Iterator[list[str | None]]:
    """The texts of a batch in order, those of about TEXTS characters at a time."""
    held, size = [], 0
    for said in batch.column("text"):
        held.append(said.as_py())
        size += len(held[-1] or "")
        if size >= TEXTS:
            yield held
            held, size = [], 0
    yield held


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int32)))


def _own(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))


LINKS = "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>, link_rows array<int>, link_cols array<int>, shared_bytes array<int>"


def links(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Both tokenizations of every row and the CSR of their links: token i of A is linked to the tokens
    link_cols[link_rows[i] : link_rows[i + 1]] of B, with so many shared bytes; groups are numbered in order.

    Texts that are null or empty, or whose tokens have other bytes, have empty lists. Repeated
    rows stay; an empty table gives none; other columns are not read.
    """
    names = [c.split()[0] for c in LINKS.split(", ")]

    def run(batches):
        own = tokenizers(path_a, path_b)
        none = np.zeros(0, np.int64)
        for b in batches:
            out = []
            for found in (x for texts in some_texts(b) for x in own.encoded(texts)):
                a, c = found or (none, none)
                x = align(np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[c]))
                out.append((a, c, x.a_group, x.b_group, x.links.rows, x.links.cols, x.shared))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(_lists(list(c)) for c in columns)], names)

    return _own(docs, text).mapInArrow(run, LINKS)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, a_steps array<int>, b array<int>, times array<int>"


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The numbers and hash of every row, and its distinct pairs in order: a as steps from pair to pair, b, and their links."""
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches):
        own = tokenizers(path_a, path_b)
        for b in batches:
            rows = [row for texts in some_texts(b) for row in aligned_rows(own, texts)]
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            steps = [np.diff(r.pairs >> 32, prepend=0) for r in rows]
            lists = _lists(steps), _lists([r.pairs & 0xFFFFFFFF for r in rows]), _lists([r.times for r in rows])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array([r.groups_sha256 for r in rows], pa.string()), *lists], names)

    return _own(docs, text).mapInArrow(run, ALIGNED)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, pair, links) of all pairs of a batch of ALIGNED."""
    size = np.diff(batch.column("b").offsets.to_numpy())
    flat = lambda name: batch.column(name).flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    steps = np.append(0, np.cumsum(flat("a_steps")))
    begins = np.cumsum(size) - size
    return row, (steps[1:] - steps[begins][row]) << 32 | flat("b"), flat("times")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n): how many links of rows (ALIGNED) join the two ids; tasks hand on sums of HELD pairs at a time."""

    def run(batches):
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [total], 0

        def summed():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def batch():
            keys, n = held.pop()
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for b in batches:
            _, keys, n = _pairs(b)
            held.append((keys, n))
            size += len(keys)
            if size >= 2 * HELD:
                held, size = [summed()], 0
                if len(held[0][0]) >= HELD:
                    yield batch()
                    held = [total]
        held = [summed()]
        yield batch()

    return rows.select("a_steps", "b", "times").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


REPORT = "row long, n_best long, count_sum long, rare array<struct<a:int,b:int,links:int>>"


def link_report(docs: DataFrame, path_a: str, path_b: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared) of every row.

    n_best: links whose pair's count is the highest of its id of B; count_sum: counts over links;
    n_shared: pairs of tokens of one group. The `frequent` pairs of the largest counts are
    broadcast with their counts; links of others are shuffled, once a row and pair, to
    meet their counts. Texts without tokens have zeros and ''. Repeated rows stay and an empty
    table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    rows = saved(aligned(docs, path_a, path_b, text).withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = saved(pair_counts(rows), "pair-counts")
    # one row for each id of B at most
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    best = saved(counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")
    table = largest(best, F.col("n"), frequent).toPandas()
    keys = table["a"].to_numpy(np.int64) << 32 | table["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    spread = spark.sparkContext.broadcast((keys[order], table["n"].to_numpy(np.int64)[order], table["best"].to_numpy(bool)[order]))

    def run(batches):
        known, n, is_best = spread.value
        for b in batches:
            row, pairs, times = _pairs(b)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            to, of = row[hit], at[hit]
            sums = np.zeros((2, b.num_rows), np.int64)
            np.add.at(sums[0], to, is_best[of] * times[hit])
            np.add.at(sums[1], to, n[of] * times[hit])
            other = ~hit
            each = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (pairs[other] >> 32, pairs[other] & 0xFFFFFFFF, times[other])], ["a", "b", "links"])
            ends = np.append(0, np.cumsum(np.bincount(row[other], minlength=b.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends), each)], ["row", "n_best", "count_sum", "rare"])

    told = saved(rows.select("row", "a_steps", "b", "times").mapInArrow(run, REPORT), "known-links")
    asked = told.select("row", F.inline("rare"))
    more = asked.join(best, ["a", "b"]).select("row", F.when(F.col("best"), F.col("links")).otherwise(0).cast("long").alias("n_best"), (F.col("n") * F.col("links")).alias("count_sum"))
    sums = more.union(told.select("row", "n_best", "count_sum")).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = saved(rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"), "link-report")
    freed(rows, counts, best, told)
    return out
