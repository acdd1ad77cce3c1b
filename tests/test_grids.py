"""Grids of settings and structural durations by hand."""

import bisect
import random

from pyspark.sql import functions as F

from symcorpus.operators import events, grids, tokens

SETTING = "grid_id string, ord int, start_beat int, end_beat int, resolution int"


def test_nearest_is_that_of_a_plain_search(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        lengths = sorted(rng.sample(range(2000), rng.choice([0, 1, 2, 3, 64, 500])))
        rows.append((k, rng.randrange(-100, 2200), lengths))
    got = {r["k"]: r["x"] for r in spark.createDataFrame(rows, "k int, v long, lengths array<long>").select("k", grids.nearest(F.col("v"), F.col("lengths")).alias("x")).collect()}
    for k, v, lengths in rows:
        assert got[k] == (min(lengths, key=lambda x: (abs(x - v), -x)) if lengths else None), (v, lengths[: bisect.bisect(lengths, v) + 1])


def test_settings_of_the_default_grid_give_its_lengths(spark):
    settings = spark.createDataFrame([("g", 1, 0, 4, 24), ("g", 2, 4, 16, 4)], SETTING)
    rows = spark.range(1, 9000).select(F.lit("g").alias("grid_id"), "id")
    wrong = grids.on_grids(rows, "id", settings, 480).filter(F.col("length") != tokens.grid(F.col("id")))
    assert grids.grid_issues(settings).count() == 0 and wrong.count() == 0


def test_settings_that_break_a_rule(spark):
    rows = [("gap", 1, 0, 4, 8), ("gap", 2, 5, 8, 8), ("late", 1, 1, 2, 8), ("empty", 1, 0, 0, 8), ("far", 1, 0, 65, 8), ("none", 1, 0, 4, None), ("fine", 1, 0, 1, 64), ("fine", 2, 1, 64, 1), ("swapped", 1, 4, 8, 4), ("swapped", 2, 0, 4, 4)]
    got = {(r["grid_id"], r["ord"], r["rule"]) for r in grids.grid_issues(spark.createDataFrame(rows, SETTING)).collect()}
    behind = "does not follow the range before"
    assert got == {("gap", 2, behind), ("late", 1, "does not start at beat 0"), ("empty", 1, "range of beats"), ("far", 1, "range of beats"), ("none", 1, "resolution"), ("swapped", 1, "does not start at beat 0"), ("swapped", 2, behind)}
    asked = spark.createDataFrame([("gap", 5), ("unknown", 5), (None, 5), ("fine", None), ("fine", 5)], "grid_id string, v long")
    lengths = [(r["grid_id"], r["v"], r["length"]) for r in grids.on_grids(asked, "v", spark.createDataFrame(rows, SETTING), 480).collect()]
    assert sorted(lengths, key=str) == sorted([("gap", 5, None), ("unknown", 5, None), (None, 5, None), ("fine", None, None), ("fine", 5, 7)], key=str)


def test_closing_rests_are_phrases(spark):
    notes = spark.createDataFrame([(k, 0, 100 if k < 6 else 250) for k in range(8)], "source_id int, onset_tick long, end_tick long")
    told = [(0, 100.0), (1, 300.0), (2, 300.00000001), (3, 301.0), (4, -5.0), (5, float("nan")), (6, 200.0), (9, 900.0)]
    ends = spark.createDataFrame(told, "source_id int, duration double")
    count = lambda **k: {r["source_id"]: r["n_phrases"] for r in events.phrase_counts(notes, 100, ends, **k).collect()}
    assert count() == {0: 1, 1: 3, 2: 3, 3: 4, 4: 1, 5: 1, 6: 3, 7: 3}
    assert count(partial=False) == {0: 1, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 2, 7: 2}
    phrases = spark.createDataFrame([(6, 0), (6, 1), (6, 2), (8, 0)], "source_id int, phrase_index long")
    assert sorted(map(tuple, events.counted_phrases(phrases, events.phrase_counts(notes, 100, ends, partial=False)).collect())) == [(6, 0), (6, 1)]
