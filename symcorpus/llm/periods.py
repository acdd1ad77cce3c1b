"""Runs of words that repeat with a period, by Lyndon roots, and texts with runs collapsed.

The first phase of Baier's suffix sorter refines groups of suffixes from the greatest down; when a
group's turn comes, its members' context is the longest Lyndon word that begins at each, so the
phase ends with the Lyndon array and nothing need be sorted further. Every run has a root that is
the longest Lyndon word at its place under the order of the words or under the opposite order, so
two such arrays give all candidates, and longest common extensions to both sides give the runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

#: A run has so many words at least, and its period so many times.
LEAST_WORDS = 6
TIMES = 4
#: Rounds in which places that no run can reach are dropped; fewer rounds only leave more to sort.
ROUNDS = 12


def lyndon_array(codes: Sequence[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, under the order of the codes.

    Groups begin as the places of one code and are taken from the greatest down. A member's
    predecessor is the last place before it whose group is yet to come (places that are done are
    skipped by a union-find structure). A place that is predecessor of c members of the group
    has its context followed by c contexts of the group, so it goes into a new group right
    above its own, those of greater c higher.
    """
    n = len(codes)
    places: defaultdict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(codes):
        places[c].append(i)
    order = sorted(places)
    rank = {c: g for g, c in enumerate(order)}
    members = [places[c] for c in order]
    group = [rank[c] for c in codes]
    below, above = [g - 1 for g in range(len(order))], [*range(1, len(order)), -1]
    length = [1] * n
    size = [1] * len(order)
    left = list(range(n))  # where the search for a place that is not done goes on
    at = len(order) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        for i in own:
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and left[j] != j:
                k = left[j]
                if k >= 0:
                    left[j] = left[k]
                j = k
            left[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            by: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
            for j, c in times.items():
                by[c, group[j]].append(j)
            for c, old in sorted(by, reverse=True):
                new = len(members)
                moved = by[c, old]
                members.append(moved)
                size.append(size[old] + c * size[at])
                for j in moved:
                    group[j] = new
                    length[j] = size[new]
                up = above[old]
                above[old], below[up] = new, new
                below.append(old)
                above.append(up)
        at = below[at]
    return length


class Extensions:
    """Longest common extensions of pairs of places, by names of all blocks of 1, 2, 4, ... codes; exact."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.names = [codes.astype(np.int64)]
        width = 1
        while 2 * width <= self.n:
            before = self.names[-1]
            pairs = before[:-width] * (int(before.max()) + 1) + before[width:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            width *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a on equal those from b on; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a + out, b + out
            fits = np.flatnonzero(y + (1 << k) <= self.n)
            same = fits[self.names[k][x[fits]] == self.names[k][y[fits]]]
            out[same] += 1 << k
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes before a equal those before b; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            fits = np.flatnonzero(x >= 0)
            same = fits[self.names[k][x[fits]] == self.names[k][y[fits]]]
            out[same] += 1 << k
        return out


def runs_of(codes: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Every run (start, length, period) of at least `least` codes and `times` periods, by start, then period."""
    n = len(codes)
    if n < least:
        return []
    starts, periods = [], []
    for own in (codes, codes.max() - codes):
        roots = np.array(lyndon_array(own.tolist()), np.int64)
        place = np.arange(n)
        # a run of four periods or more holds three roots on end at least
        good = (place + 2 * roots <= n) & (roots[np.minimum(place + roots, n - 1)] == roots)
        if times > 3:
            good &= (place + 3 * roots <= n) & (roots[np.minimum(place + 2 * roots, n - 1)] == roots)
        starts.append(place[good])
        periods.append(roots[good])
    start, period = np.concatenate(starts), np.concatenate(periods)
    if not len(start):
        return []
    common = Extensions(codes)
    ahead, back = common.ahead(start, start + period), common.back(start, start + period)
    first, length = start - back, back + period + ahead
    long = (length >= least) & (length >= times * period)
    found = np.unique(np.stack([first[long], period[long], length[long]], 1), axis=0)
    return [(int(a), int(size), int(p)) for a, p, size in found]


def stretches(codes: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint ranges of places outside which no run lies, and of which each run lies in one.

    After its first period q, each place of a run has an equal one at most q before it, and
    these are (times - 1) q places or more. So a place whose last equal one is farther than a
    (times - 1)th of its stretch of kept places is in no such part of a run, and goes.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n + 1)
    same = np.flatnonzero(codes[order][1:] == codes[order][:-1])
    gap[order[same + 1]] = order[same + 1] - order[same]
    keep = gap <= n
    for _ in range(ROUNDS):
        edge = np.flatnonzero(np.diff(keep, prepend=False, append=False))
        a, z = edge[::2], edge[1::2]
        size = z - a
        whole = size >= max(least - least // times, 1)
        a, size = a[whole], size[whole]
        if not len(a):
            return []
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        close = gap[at] <= np.repeat(size // (times - 1), size)
        after = np.zeros(n, bool)
        after[at[close]] = True
        if (after == keep).all():
            break
        keep = after
    edge = np.flatnonzero(np.diff(keep, prepend=False, append=False))
    out: list[tuple[int, int]] = []
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        a -= min(a, (z - a) // (times - 1))
        while out and a <= out[-1][1]:
            a = min(a, out.pop()[0])
        out.append((a, z))
    return out


def word_codes(words: list) -> np.ndarray:
    """Numbers of words in order of their first place."""
    known: defaultdict = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def periodic_runs(codes: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """runs_of(codes), worked out where runs can be."""
    out = []
    for a, z in stretches(codes, least, times):
        _, own = np.unique(codes[a:z], return_inverse=True)
        out += [(a + start, length, period) for start, length, period in runs_of(own, least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def repeated_tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one id of ten: from which word each word of a text of n is taken, so that its tail is periodic; else None."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


RUNS = "doc_id long, n_words long, runs array<struct<start:int,length:int,period:int>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))


def word_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, times: int = TIMES, made: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs of words by start, and its kept words joined by a space.

    made: texts of one id of ten get a periodic tail first (repeated_tail), as the query's
    contract has it; a null id never does. Words part at the six ASCII blanks. A null, empty or
    blank text has no words; repeated rows stay; an empty table gives none; other columns are not
    read. Texts are worked on one by one where they are read, so nothing is shuffled.
    """

    def run(batches):
        for b in batches:
            out = []
            for doc_id, said in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = said.as_buffer().to_pybytes().split()
                if made and (at := repeated_tail(len(words), doc_id)) is not None:
                    words = [words[i] for i in at.tolist()]
                found = periodic_runs(word_codes(words), least, times)
                rest = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()] if found else words
                out.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(rest).decode()))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), _RUN, pa.string()), strict=True))], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, RUNS)


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, exact; the first, then the shortest period of equals."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
