"""The fit in epochs against a plain loop over tokens."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from symcorpus.operators import events, fitting, rules

SEQUENCES = [
    (1, "train", "a b a b c a b"), (2, "train", "b c a b b"), (5, "train", "a b c c a"), (10, "train", "c a b z"), (3, "validation", "a b c a q"), (4, "validation", "b"), (6, "test", "q q q q"), (7, "train", None),
]


def plain_history(epochs, min_delta, patience):
    pairs = {"count": Counter(), "tune": Counter(), "valid": Counter()}
    for i, split, text in SEQUENCES:
        words = (text or "").split(" ") if text is not None else []
        part = {"train": "tune" if i % 5 == 0 else "count", "validation": "valid"}.get(split)
        if part:
            pairs[part].update(zip(words, words[1:]))
    every = set().union(*pairs.values())
    size, total = len({n for _, n in every}), sum(pairs["count"].values())
    before, after = Counter(), Counter()
    for (p, n), k in pairs["count"].items():
        before[p] += k
        after[n] += k
    probabilities = lambda p, n: (1 / size, after[n] / total, pairs["count"][p, n] / before[p] if before[p] else 0.0)
    loss = lambda part, w: -sum(k * math.log(sum(a * b for a, b in zip(w, probabilities(*x)))) for x, k in pairs[part].items()) / sum(pairs[part].values())
    w, best, without, out = [1 / 3] * 3, math.inf, 0, []
    for epoch in range(1, epochs + 1):
        train = loss("tune", w)
        new = [0.0] * 3
        for x, k in pairs["tune"].items():
            each = [a * b for a, b in zip(w, probabilities(*x))]
            new = [s + k * v / sum(each) for s, v in zip(new, each)]
        w = [v / sum(pairs["tune"].values()) for v in new]
        valid = loss("valid", w)
        out += [(epoch, "train", train, sum(pairs["tune"].values()), *w), (epoch, "validation", valid, sum(pairs["valid"].values()), *w)]
        best, without = (valid, 0) if valid < best - min_delta else (best, without + 1)
        if without >= patience:
            break
    return out


def frame(spark):
    return spark.createDataFrame(SEQUENCES, "source_id long, split string, text string").select("source_id", "split", F.split("text", " ").alias("tokens"))


@pytest.mark.parametrize("settings", [fitting.Settings(4, 1e-9, 3), fitting.Settings(30, 0.01, 2)])
def test_epochs_are_those_of_a_plain_loop(spark, settings):
    history = fitting.fitted(frame(spark), F.col("source_id") % 5 == 0, settings)
    want = plain_history(*settings)
    got = [tuple(r) for r in history.orderBy("epoch", "phase").collect()]
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[3] == b[3] and a[2:] == pytest.approx(b[2:]) for a, b in zip(got, want))
    told = events.early_stopping(fitting.phase_losses(history), settings.min_delta, settings.patience).first()
    last = max(r[0] for r in got)
    assert told["stopped_epoch"] == (last if last < settings.epochs else None) or told["epochs_without"] >= settings.patience
    audit = rules.history_audit(fitting.phase_losses(history)).first()
    assert audit["contiguous"] and audit["finite"]
    tags = {r["tag"] for r in fitting.history_scalars(history).collect()}
    assert tags == {"loss/train", "loss/validation", "perplexity/train", "perplexity/validation", "weights/uniform", "weights/unigram", "weights/bigram"}


def test_weights_stay_a_distribution_and_train_loss_falls(spark):
    rows = fitting.fitted(frame(spark), F.col("source_id") % 5 == 0, fitting.Settings(6, 0.0, 9)).filter("phase = 'train'").orderBy("epoch").collect()
    assert all(sum(r[p] for p in fitting.PARTS) == pytest.approx(1) for r in rows)
    assert all(b["loss"] <= a["loss"] + 1e-12 for a, b in zip(rows, rows[1:]))


def test_nothing_to_tune_or_validate_on_gives_no_epochs(spark):
    assert fitting.fitted(frame(spark).filter("split <> 'validation'"), F.col("source_id") % 5 == 0).count() == 0
    assert fitting.fitted(frame(spark), F.lit(False)).count() == 0
    assert fitting.fitted(frame(spark).limit(0), F.lit(True)).count() == 0
