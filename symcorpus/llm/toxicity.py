"""Toxic passages as maximum-scoring segments of token log-odds, and scores of documents from them.

Words and their prefixes are counted by label, once a document. A word's share of toxic documents
has a Dirichlet (here: beta) prior around the share of its longest prefix, that of its shorter
prefixes, and so on to the share of all documents; its log-odds less a drift are its score. One
linear scan finds every maximal segment of a text. How high segments of clean texts come is fitted
as an extreme-value distribution, so the segments of a text give a p-value whatever its length,
and a logistic curve turns that evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import among, freed, largest, saved, text_of

#: Characters of the prefixes that stand behind a word, and of a word that count.
PREFIXES = (4, 6, 8)
MOST_CHARS = 64
#: Documents that a prior is worth, and what a token costs, in nats.
STRENGTH = 4.0
DRIFT = 1.5
#: Features of the model: those of the largest z. A bound of the broadcast table, some 10 MB.
FEATURES = 200_000
#: Scores of segments below this are noise; those of a p-value of at most SIGNIFICANT are passages.
LEAST_SCORE = 2.0
SIGNIFICANT = 0.05
#: Labelled rows that the logistic curve is fitted on, about, at most.
CURVE_ROWS = 20_000
#: Distinct features that a task holds before it hands their counts on.
HELD = 200_000
_WORD = re.compile(r"[^\W_]+")
_EULER = 0.5772156649015329


def words(text: str) -> list[str]:
    return [w[:MOST_CHARS] for w in _WORD.findall(text.lower())]


def features(word: str) -> list[str]:
    """From the shortest prefix, marked by a star, to the word."""
    return [*(word[:k] + "*" for k in PREFIXES if len(word) > k), word]


class LogOdds(dict):
    """Scores of words, each worked out when it is first asked for."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int, strength: float = STRENGTH, drift: float = DRIFT):
        super().__init__()
        self.counts, self.strength = counts, strength
        self.share = (toxic + 1) / (toxic + clean + 2)
        self.base = math.log(self.share / (1 - self.share)) + drift

    def __missing__(self, word: str) -> float:
        if len(self) >= 2 * HELD:
            self.clear()
        share = self.share
        for f in features(word):
            if f in self.counts:
                toxic, clean = self.counts[f]
                share = (toxic + self.strength * share) / (toxic + clean + self.strength)
        score = self[word] = math.log(share / (1 - share)) - self.base
        return score


class Segment(NamedTuple):
    start: int
    end: int
    score: float


def segments(scores: np.ndarray) -> list[Segment]:
    """All maximal scoring segments of a sequence, disjoint and in order; their ends are exclusive.

    Each candidate keeps the sums before and after it and, as a link, the last earlier candidate
    of a lesser sum before; links are followed at most once, so the scan is linear. Stretches of
    equal sign come as one step.
    """
    if not len(scores):
        return []
    up = scores > 0
    turn = np.append(0, np.flatnonzero(up[1:] != up[:-1]) + 1)
    sums = np.cumsum(np.add.reduceat(scores, turn)).tolist()
    ends = np.append(turn[1:], len(scores)).tolist()
    starts, rising = turn.tolist(), up[turn].tolist()
    first, last, left, right, link = [], [], [], [], []
    for k, rises in enumerate(rising):
        if not rises:
            continue
        a, low, high = starts[k], sums[k - 1] if k else 0.0, sums[k]
        j = len(first) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            a, low = first[j], left[j]
            for column in (first, last, left, right, link):
                del column[j + 1 :]
            for column in (first, last, left, right):
                column.pop()
            j = link.pop()
        for column, v in ((first, a), (last, ends[k]), (left, low), (right, high), (link, j)):
            column.append(v)
    return [Segment(a, z, r - x) for a, z, x, r in zip(first, last, left, right, strict=True)]


def scored(text: str, model: LogOdds) -> np.ndarray:
    said = words(text)
    return np.fromiter(map(model.__getitem__, said), float, len(said))


class Tail(NamedTuple):
    """Highest segments of clean texts of n words: P(highest >= s) = 1 - exp(-k n exp(-rate s))."""

    rate: float
    log_k: float

    def normal(self, score: float, n: int) -> float:
        """A score as nats above what n words of clean text are expected to reach."""
        return self.rate * score - self.log_k - math.log(max(n, 1))

    def passages(self, found: Iterable[Segment], n: int, level: float = SIGNIFICANT) -> list[Segment]:
        return [s for s in found if -math.expm1(-math.exp(min(-self.normal(s.score, n), 50.0))) <= level]

    def evidence(self, scores: list[float], n: int) -> float:
        """The least log p-value, negated, of the r highest segments together, over all r.

        r normalised scores of sum t have p-value exp(-t) t**(r-1) / (r! (r-1)!), and each
        further segment that is tried halves what is left of the level.
        """
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            total += self.normal(score, n)
            if total <= r:
                break
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            best = max(best, -log_p - r * math.log(2))
        return best


class Model(NamedTuple):
    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    tail: Tail
    slope: float
    offset: float

    def probability(self, evidence: float) -> float:
        x = self.offset + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(min(x, 700.0), -700.0)))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: rows of 1 are held out, 0 and 2 are the folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold, pick) of each row of docs that has a label and isn't held out; pick is a hash of the id.

    The label of an id that has several is toxic if one of them is; null labels and null ids count for nothing.
    Rows without a label are left out before texts move.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    said = known.filter((remainder() != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(remainder() != 1)
    joined = among(some, said, "doc_id").join(said.hint("merge"), "doc_id")
    return joined.select("text", "toxic", remainder().alias("fold"), F.xxhash64("doc_id").alias("pick"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, a1, a0, b1, b0): toxic and clean documents that have it, by fold; '' has all documents.

    Tasks add up what they read, hand on HELD features at a time, and only sums are shuffled.
    """
    kinds = {(0, 1): 0, (0, 0): 1, (2, 1): 2, (2, 0): 3}
    names = ["a1", "a0", "b1", "b0"]

    def run(batches):
        held: dict[str, list[int]] = {}

        def batch():
            columns = zip(*held.values(), strict=True) if held else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["feature", *names])

        for b in batches:
            for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                kind = kinds[int(fold), int(toxic > 0)]
                for f in {"", *(f for w in set(words(text)) for f in features(w))}:
                    if f not in held:
                        held[f] = [0] * 4
                    held[f][kind] += 1
                if len(held) >= HELD:
                    yield batch()
                    held.clear()
        yield batch()

    counted = rows.mapInArrow(run, "feature string, a1 long, a0 long, b1 long, b0 long")
    return counted.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def best_features(counts: DataFrame, toxic: int, clean: int, most: int = FEATURES) -> DataFrame:
    """Features of two documents or more, `most` of them at most, by how far their share is from that of all documents: a z of 1 or more."""
    share = toxic / (toxic + clean)
    one, n = F.col("a1") + F.col("b1"), F.col("a1") + F.col("a0") + F.col("b1") + F.col("b0")
    z = F.abs(one - n * share) / F.sqrt(n * (share * (1 - share)))
    return largest(counts.withColumn("z", z).filter((n >= 2) & (F.col("feature") != "")), F.col("z"), most).drop("z")


def fitted_tail(clean: list[tuple[float, float, float, float]]) -> Tail:
    """From (n, mean of highest, variance of highest, mean of log words) of clean documents, by moments."""
    if not clean or not clean[0][0]:
        return Tail(1.0, 0.0)
    _, mean, variance, log_words = clean[0]
    rate = math.pi / math.sqrt(6 * max(variance or 0.0, 1e-2))
    return Tail(rate, rate * mean - _EULER - log_words)


def fitted_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, not below zero, and offset of the logistic curve of x, by Newton's steps with a light ridge."""
    design = np.stack([x, np.ones_like(x)], 1)
    at = np.zeros(2)
    ridge = np.array([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), design.T @ (y - p) - ridge * at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = FEATURES) -> Model:
    """The model of labelled documents that aren't held out.

    The texts of each fold are scored by the counts of the other fold, so the tail and the curve
    are those of unseen texts. All labelled rows count for features and tail; the curve is
    fitted on a part of them by the hash of their ids, CURVE_ROWS at most, about. Without rows of both labels every score is that share.
    """
    rows = saved(training_rows(docs, labels), "labelled")
    counts = saved(feature_counts(rows), "feature-counts")
    totals = counts.filter("feature = ''").collect()
    a1, a0, b1, b0 = totals[0][1:] if totals else (0, 0, 0, 0)
    toxic, clean = a1 + b1, a0 + b0
    if not toxic or not clean:
        share = (toxic + 1) / (toxic + clean + 2)
        return Model({}, toxic, clean, Tail(1.0, 0.0), 0.0, math.log(share / (1 - share)))
    table = best_features(counts, toxic, clean, most).toPandas()
    names, numbers = table["feature"].tolist(), table[["a1", "a0", "b1", "b0"]].to_numpy()
    spread = docs.sparkSession.sparkContext.broadcast((names, numbers, (a1, a0, b1, b0)))

    def run(batches):
        names, numbers, all_ = spread.value
        by = {fold: LogOdds(dict(zip(names, map(tuple, numbers[:, at : at + 2].tolist()), strict=True)), all_[at], all_[at + 1]) for fold, at in ((0, 2), (2, 0))}
        for b in batches:
            out = []
            for text, toxic, fold, pick in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold", "pick")), strict=True):
                scores = scored(text, by[int(fold)])
                found = [s.score for s in segments(scores)]
                out.append((pick, int(toxic > 0), len(scores), max(found, default=0.0), [s for s in found if s >= LEAST_SCORE]))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pick", "toxic", "n", "highest", "scores"])

    seen = saved(rows.mapInArrow(run, "pick long, toxic int, n long, highest double, scores array<double>"), "segments")
    quiet = seen.filter("toxic = 0 AND n > 0").agg(F.count("*"), F.avg("highest"), F.var_samp("highest"), F.avg(F.ln("n")))
    tail = fitted_tail([tuple(r) for r in quiet.collect()])

    def judge(batches):
        for b in batches:
            evidence = [tail.evidence(s, n) for s, n in zip(b.column("scores").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(evidence, pa.float64())], ["toxic", "evidence"])

    parts = max(1, math.ceil((toxic + clean) / CURVE_ROWS))
    picked = seen.filter(F.pmod("pick", F.lit(parts)) == 0).orderBy("pick", "toxic", "n", "highest")
    some = picked.mapInArrow(judge, "toxic int, evidence double").toPandas()
    freed(rows, counts, seen)
    slope, offset = fitted_curve(np.log1p(some["evidence"].to_numpy()), some["toxic"].to_numpy().astype(float))
    return Model({f: (int(x[0] + x[2]), int(x[1] + x[3])) for f, x in zip(names, numbers, strict=True)}, toxic, clean, tail, slope, offset)


PASSAGES = "doc_id long, n_words long, evidence double, score double, passages array<struct<start:int,end:int,score:double>>"


def toxic_passages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, n_words, evidence, score, passages) of every row: words start to end - 1 of a passage are toxic together.

    Only the text is read. Null and empty texts have no words, no evidence and the score of
    that; repeated rows stay, an empty table gives none.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    def run(batches):
        own = spread.value
        odds = LogOdds(own.counts, own.toxic, own.clean)
        for b in batches:
            out = []
            for said in b.column("text"):
                scores = scored(said.as_py() or "", odds)
                found = segments(scores)
                evidence = own.tail.evidence([s.score for s in found if s.score >= LEAST_SCORE], len(scores))
                told = own.tail.passages((s for s in found if s.score >= LEAST_SCORE), len(scores))
                out.append((len(scores), evidence, own.probability(evidence), [s._asdict() for s in told]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "evidence", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PASSAGES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, n_passages, evidence) of every row of docs; a null id isn't held out."""
    judged = toxic_passages(docs, fit(docs, labels))
    held = F.coalesce(remainder() == 1, F.lit(False))
    return judged.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_words", F.size("passages").alias("n_passages"), "evidence")


