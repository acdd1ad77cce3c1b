"""Token ids of whole texts by public vocabularies, through caches of pre-tokens.

Each library cuts a text into pre-tokens and encodes them one by one, so the ids of a text
are those of its pre-tokens in a row. The cut is done here only for texts whose characters
are plain Latin-1 prose, where it is sure to be the library's own; any other text, and any
with a marker of a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Entries of a worker's cache; a full one starts anew.
CACHE = 600_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_LOWER = "a-zß-öø-ÿ"
_PLAIN = bytes(range(32, 127)) + b"\t\n\r" + bytes(b for b in range(0xC0, 0x100) if b not in (0xD7, 0xF7))
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_CUT = re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_WORD_CUT = re.compile(rf"{_ENDINGS}|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+")


def _spelling() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_SPELLING = _spelling()


def plain(text: str) -> bool:
    """Whether the quick cut is sure to be the library's."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def byte_cut(text: str) -> list[str]:
    return _BYTE_CUT.findall(text)


def word_cut(text: str) -> list[str]:
    return _WORD_CUT.findall(text.lower())


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by a file of the tokenizers library."""

    def __init__(self, path: str, cut):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.cut, self.cache = Tokenizer.from_file(path), cut, {}

    def _learn(self, word: str) -> bytes:
        """A pre-token's ids; its bytes are first spelled in the letters of the vocabulary."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        spelled = word.encode().decode("latin-1").translate(_SPELLING)
        ids = self.cache[word] = np.array([t.id for t in self.library.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text is empty."""
        out: list[bytes] = []
        get, learn = self.cache.get, self._learn
        for text in texts:
            if not text:
                out.append(b"")
            elif plain(text):
                words = self.cut(text)
                ids = list(map(get, words))
                if None in ids:
                    ids = [i if i is not None else get(w) or learn(w) for w, i in zip(words, ids, strict=True)]
                out.append(b"".join(ids))
            else:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> Encoder:
    return Encoder(path, byte_cut)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> Encoder:
    return Encoder(path, word_cut)


class PieceCounter:
    """Token counts of texts by a sentencepiece model, through two tiers of pre-token lengths.

    A space begins a pre-token and no piece of the model holds a space after another
    character, so merges stay inside pre-tokens. known: frequent pre-tokens and their counts.
    """

    def __init__(self, path: str, known: dict[str, int]):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.cache = known, {}
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        self.apart = all("▁" not in p.lstrip("▁") for p in pieces)

    def __missing__(self, word: str) -> int:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        n = self.cache[word] = len(self.library.encode(word))
        return n

    def __getitem__(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.cache.get(word)
        return self.__missing__(word) if n is None else n

    def count(self, text: str) -> int:
        if not self.apart or "  " in text or "▁" in text or text[:1] in ("", " ") or text[-1:] == " " or "\0" in text:
            return len(self.library.encode(text))
        known, words, total = self.known, text.split(" "), 0
        counts = list(map(known.get, words))
        if None not in counts:
            return sum(counts)
        cache = self.cache
        for word, n in zip(words, counts, strict=True):
            if n is None:
                n = cache.get(word)
                if n is None:
                    n = self.__missing__(word)
            total += n
        return total


_COUNTERS: dict[str, tuple[str, PieceCounter]] = {}


def piece_counter(path: str, key: str = "", words: str = "", sizes: Sequence[int] = ()) -> PieceCounter:
    """The worker's counter for a model, whose cache lasts over tasks; the table of known words, parted by spaces, is made once for each key."""
    held, counter = _COUNTERS.get(path) or (None, PieceCounter(path, {}))
    if held != key:
        counter.known = dict(zip(words.split(" "), map(int, sizes), strict=True)) if len(sizes) else {}
        _COUNTERS[path] = key, counter
    return counter
