"""Splits, metrics, bigrams and look-ups that deal their rows once at most, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symcorpus.operators import ranks, rules, sequences, splits
from symcorpus.sources import runs


def nodes(frame, name):
    return len(re.findall(rf"^[\s:+|-]*{name}\b", frame._jdf.queryExecution().optimizedPlan().toString(), re.M))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 11, 400])
def test_splits_are_ranges_of_hashes(spark, n):
    texts = [(k, f"text {k // 2}" if k % 5 else None) for k in range(n)]
    got = splits.assign_splits(splits.fingerprint(spark.createDataFrame(texts, "source_id long, content string")))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    order = sorted({sha(x) for _, x in texts if x is not None}, key=lambda h: sha("0" + h))
    groups = len(order) + any(x is None for _, x in texts)
    named = dict(zip(order, [s for s, k in zip(splits.SPLITS, splits.allocate_splits(groups)) for _ in range(k)]))
    assert {r["source_id"]: r["split"] for r in got.collect()} == {i: named[sha(x)] for i, x in texts if x is not None}
    assert nodes(got, "Join") == 0 and nodes(got, "Aggregate") == 0  # no text is shuffled


def _texts():
    draw = random.Random(7)
    return [(k, ("train", "validation", "test")[min(k % 5, 2)], [draw.choice(["a"] * 9 + ["b", "c", "", f"r{k}", f"q{k % 7}"]) for _ in range(k % 23)]) for k in range(160)]


def test_metrics_need_no_window(spark):
    frame = spark.createDataFrame(_texts(), "source_id long, split string, tokens array<string>")
    result = rules.evaluate(frame.select("split", "tokens"))
    assert nodes(result, "Window") == 0
    pairs = [(s, a, b) for _, s, x in _texts() for a, b in zip(x, x[1:]) if b != ""]
    train, words = Counter((a, b) for s, a, b in pairs if s == "train"), {t for _, _, x in _texts() for t in x}
    after = defaultdict(dict)
    for (a, b), n in train.items():
        after[a][b] = n
    assert any(a not in after for _, a, _ in pairs)
    best = {a: min(c, key=lambda b: (-c[b], b)) for a, c in after.items()}
    for r in result.collect():
        own = [(a, b) for s, a, b in pairs if s == r["split"]]
        nll = sum(-math.log((train[a, b] + 1) / (sum(after[a].values()) + len(words))) for a, b in own) / len(own)
        assert (r["tokens"], r["nll"]) == (len(own), pytest.approx(nll, abs=1e-4))
        assert r["top1"] == pytest.approx(sum(b == best.get(a, min(words)) for a, b in own) / len(own), abs=1e-6)


def test_bigrams_are_dealt_once(spark):
    frame = spark.createDataFrame([(k, x) for k, _, x in _texts()], "sequence_id long, tokens array<string>")
    counts, words = Counter((a, b) for _, _, x in _texts() for a, b in zip(x, x[1:])), {t for _, _, x in _texts() for t in x}
    totals = Counter()
    for (a, _), n in counts.items():
        totals[a] += n
    wanted = {(a, b): (n, round(math.log((n + 1) / (totals[a] + len(words))), 6)) for (a, b), n in counts.items()}
    for keep in (runs.staged, lambda df: df):
        scored = sequences.bigram_scores(frame, keep=keep)
        got = {(r["prev"], r["next"]): (r["n"], pytest.approx(r["log_p"], abs=2e-6)) for r in scored.collect()}
        assert got == wanted
    scored = sequences.bigram_scores(frame, keep=runs.staged)
    assert nodes(scored, "RepartitionByExpression") == 1


def test_known_counts_are_not_taken_again(spark):
    kept = []

    def keep(rows):
        kept.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return runs.staged(rows)

    tokens = [(k, random.Random(k).choice(["the"] * 30 + [f"w{k % 60}", None])) for k in range(2000)]
    rows = spark.createDataFrame(tokens, "at int, token string")
    counts = runs.staged(sequences.token_counts(rows))
    table = runs.staged(sequences.vocabulary(counts.filter("token IS NOT NULL"), runs.staged))
    got = sequences.ids_of(rows, table, keep, counts)
    words = sorted({t for _, t in tokens if t})
    assert {r["at"]: r["id"] for r in got.collect()} == {k: words.index(t) if t else None for k, t in tokens}
    assert len(kept) == 1 and "Aggregate" not in kept[0]  # the frequent entries alone are written


def test_frequent_keys_are_bounded(spark):
    counts = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "key string, n long")
    for most in (0, 1, 36, 37, 100, 1000):
        held = {r["n"] for r in ranks.frequent(counts, "n", most).collect()}
        assert len(held) <= most and all(n * most <= 2 * sum(range(100)) for n in set(range(100)) - held)
    assert len(ranks.frequent(counts, "n", 36).collect()) == 36 and ranks.frequent(counts.limit(0), "n", 5).count() == 0
