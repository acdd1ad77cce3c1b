"""Token counts by a two-tier lookup of pre-token lengths on the map side."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import piece_counter
from .shared import text_of

#: Words of the broadcast table, each of at most MOST_CHARS characters: some 400 KB.
FREQUENT = 32_768
MOST_CHARS = 64
#: Rows from which frequent words are drawn, and words that one task names. The table only saves time: counts do not depend on it.
SAMPLE_ROWS = 2_000
NAMED = 4_096
LIMIT = 4096


def frequent_words(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, words: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of a random sample of about `rows` rows.

    Each task counts the words of its own sampled rows and names NAMED of them at most; these
    short lists are merged here, so no pre-token is ever shuffled.
    """
    part = min(1.0, rows / max(1, docs.count()))
    some = docs.select(text_of(text).alias("text"))

    def run(batches):
        seen = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(w for w in t.split(" ") if 0 < len(w) <= MOST_CHARS)
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:NAMED]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    merged = Counter()
    for r in (some if part == 1 else some.sample(part, 5)).mapInArrow(run, "word string, n long").collect():
        merged[r["word"]] += r["n"]
    return [w for w, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:words]]


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; a null text is empty and has no tokens.

    The frequent pre-tokens (FREQUENT words of at most MOST_CHARS characters) are broadcast as
    one string with two bytes a word for its length in tokens (a character has four byte tokens at
    most, so a word has 4 * MOST_CHARS + 1); a worker makes its table of them once. Others are
    encoded once and kept in the worker's bounded cache. Nothing is shuffled. Texts that cannot be cut surely are
    encoded whole. Repeated rows stay, an empty table gives none, other columns are not read.
    """
    words = frequent_words(docs, text)
    counter = piece_counter(model)
    sizes = np.array([len(counter.library.encode(w)) for w in words], np.uint16)
    known = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, " ".join(words), sizes))

    def run(batches):
        counter = piece_counter(model, *known.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
