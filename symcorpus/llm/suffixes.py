"""Blockwise suffix sorting with a difference cover, for one block of text.

COVER is a difference cover modulo PERIOD: for any two positions some shift below PERIOD puts
both into the cover sample, the positions that are in COVER modulo PERIOD. Ranks of the sample
are made once for a block, by doubling. Suffixes are then sorted one bucket at a time, a bucket
holding those between two splitters: by their first PERIOD bytes, and where these tie by the
ranks of the sample at the shift that the two suffixes have in common. Suffixes that agree in
the first `limit` bytes count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD = 16
COVER = (0, 1, 2, 5, 8)
#: Suffixes of a bucket, about; only suffixes of equal first eight bytes make a larger one.
BUCKET = 1 << 16


def _shifts() -> np.ndarray:
    """The least shift that puts residues a and b both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    both = [[int(np.flatnonzero(inside[a : a + PERIOD] & inside[b : b + PERIOD])[0]) for b in range(PERIOD)] for a in range(PERIOD)]
    return np.array(both, np.int64)


SHIFT = _shifts()
_SLOT = np.zeros(PERIOD, np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys from 0, equal keys alike."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return out


class CoverRanks:
    """Ranks of the cover sample of a text by their first 16, 32, 64 ... and `limit` bytes."""

    def __init__(self, text: bytes, limit: int):
        self.limit = -(-limit // PERIOD) * PERIOD
        raw = text + bytes(self.limit + 4 * PERIOD)
        #: The eight bytes at each position, as a number in their order.
        self.words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        sample = (np.arange((len(text) + self.limit) // PERIOD + 2)[:, None] * PERIOD + np.array(COVER)).ravel()
        size = PERIOD
        self.ranks = {size: self._pairs(_ranked(self._at(sample)), _ranked(self._at(sample + 8)))}
        while size < self.limit:
            more = min(size, self.limit - size)  # the second half may overlap the first
            now, size = self.ranks[size], size + more
            later = np.zeros_like(now)
            step = more // PERIOD * len(COVER)
            later[:-step] = now[step:]
            self.ranks[size] = self._pairs(now, later)

    def _at(self, positions: np.ndarray) -> np.ndarray:
        return self.words[positions].astype(np.uint64)

    @staticmethod
    def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return _ranked(first.astype(np.int64) << 32 | second)

    @staticmethod
    def _index(positions: np.ndarray) -> np.ndarray:
        return (positions >> 4) * len(COVER) + _SLOT[positions & PERIOD - 1]

    def order(self, starts: np.ndarray) -> np.ndarray:
        """The permutation that puts the suffixes at starts in order."""
        head, second = self._at(starts), self._at(starts + 8)
        order = np.lexsort((second, head))
        at, head, second = starts[order], head[order], second[order]
        begin = np.append(0, np.flatnonzero((head[1:] != head[:-1]) | (second[1:] != second[:-1])) + 1)
        size = np.diff(np.append(begin, len(at)))
        ranks = self.ranks[self.limit]
        while len(begin := begin[size > 1]):
            # every run of ties is split in three by a pivot of its own, all runs at once
            size = size[size > 1]
            run = np.repeat(np.arange(len(begin)), size)
            place = np.arange(len(run)) + (begin - np.cumsum(size) + size)[run]
            own, pivot = at[place], at[begin + size // 2][run]
            shift = SHIFT[own & PERIOD - 1, pivot & PERIOD - 1]
            a, b = ranks[self._index(own + shift)], ranks[self._index(pivot + shift)]
            side = 3 * run + 1 + (a > b) - (a < b)
            turned = np.argsort(side, kind="stable")
            at[place], order[place] = own[turned], order[place][turned]
            less, same, more = np.bincount(side, minlength=3 * len(begin)).reshape(-1, 3).T
            begin, size = np.concatenate([begin, begin + less + same]), np.concatenate([less, more])
        return order

    def agree(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n bytes at a and at b are equal, n from 2 * PERIOD to limit."""
        same = (self.words[a] == self.words[b]) & (self.words[a + 8] == self.words[b + 8])
        shift = SHIFT[a & PERIOD - 1, b & PERIOD - 1]
        inner = (n - PERIOD + 1) // PERIOD * PERIOD  # a shift and this many bytes are n bytes at most
        done = 0
        for size in sorted((s for s in self.ranks if s & s - 1 == 0), reverse=True):
            while inner - done >= size:
                same &= self.ranks[size][self._index(a + shift + done)] == self.ranks[size][self._index(b + shift + done)]
                done += size
        for k in [*range(inner, n - 8, 8), n - 8]:
            same &= self.words[a + k] == self.words[b + k]
        return same


def buckets(heads: np.ndarray, most: int = BUCKET) -> Iterator[np.ndarray]:
    """Indexes of suffixes by bucket; splitters are drawn from the suffixes' first eight bytes."""
    step = max(1, most // 64)
    splitters = np.unique(np.sort(heads[::64])[step::step]) if len(heads) > most else heads[:0]
    which = np.searchsorted(splitters, heads, side="right")
    for k in range(len(splitters) + 1):
        yield np.flatnonzero(which == k)


def repeated(text: bytes, starts: np.ndarray, room: np.ndarray, levels: tuple[int, ...]) -> list[np.ndarray]:
    """For each level: which of the starts begin a string of so many bytes that begins at another start too.

    room is how many bytes after a start are its own; a start of less room than the level has
    no such string.
    """
    ranks = CoverRanks(text, max(levels))
    out = [np.zeros(len(starts), bool) for _ in levels]
    for mine in buckets(ranks.words[starts].astype(np.uint64)):
        if len(mine) < 2:
            continue
        mine = mine[ranks.order(starts[mine])]
        at = starts[mine]
        for level, found in zip(levels, out, strict=True):
            # neighbours in suffix order that agree make a run of equal strings
            run = np.append(0, np.cumsum(~ranks.agree(at[:-1], at[1:], level)))
            whole = room[mine] >= level
            found[mine] = whole & (np.bincount(run[whole], minlength=run[-1] + 1) > 1)[run]
    return out
