"""Hand-made cases of tonality, token streams and published runs."""

import math

import pytest
from pyspark.sql import functions as F

from symcorpus.operators import rules, tokens, tonality
from symcorpus.sources import runs

NOTES = "source_id int, phrase_index int, seq int, onset_tick long, end_tick long, pitch int"


def phrase(spark, rows):
    return spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], NOTES)


def stream(frame):
    return [r["token"] for r in frame.orderBy("pos").collect()]


def test_phrygian_and_its_transposition(spark):
    pitches = [52, 53, 55, 57, 59, 60, 62, 64]
    rows = [(s, 0, i, i * 480, i * 480 + 480, p + 3 * s) for s in (0, 1) for i, p in enumerate(pitches)]
    got = {r["source_id"]: (r["tonic"], r["mode"]) for r in tonality.infer(spark.createDataFrame(rows, NOTES)).collect()}
    assert got == {0: ("E", "PHRYGIAN"), 1: ("G", "PHRYGIAN")}


def test_stream_of_one_phrase(spark):
    notes = phrase(spark, [(0, 480, 60), (0, 480, 64), (2000, 2480, 62)])
    bends = spark.createDataFrame([(1, 0, 0, 8191), (2, 0, 0, 1)], "source_id int, phrase_index int, tick long, value int")
    labels = spark.createDataFrame([(1, 2, "VIBRATO"), (1, 2, "SLIDE_UP")], "source_id int, seq int, type string")
    got = stream(tokens.encode(notes, bends, F.lit(120.0), labels))
    assert got == [
        "Bar_None", "Position_0", "Tempo_121.29", "PitchBend_8191", "Pitch_60", "Duration_1.0.24", "Pitch_64", "Duration_1.0.24",
        "Bar_None", "Position_4", "Pitch_62", "Duration_1.0.24", "Technique_SLIDE_UP", "Technique_VIBRATO",
    ]


def test_closing_bars_follow_a_long_note_and_can_go(spark):
    empty = spark.createDataFrame([], "source_id int, phrase_index int, tick long, value int")
    whole = tokens.encode(phrase(spark, [(0, 5760, 60)]), empty, F.lit(120.0))
    assert stream(whole) == ["Bar_None", "Position_0", "Tempo_121.29", "Pitch_60", "Duration_12.0.4", "Bar_None", "Bar_None"]
    assert stream(tokens.without_closing_bars(whole))[-1] == "Duration_12.0.4"


def test_run_is_reused_and_never_changed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, split string")
    assert runs.publish(rows, str(tmp_path), "r")[1] == "created"
    assert runs.publish(rows.repartition(3), str(tmp_path), "r")[1] == "reused"
    with pytest.raises(ValueError):
        runs.publish(rows.filter("x = 2"), str(tmp_path), "r")
    assert runs.read(spark, str(tmp_path), "r").count() == 3


def test_evaluation_counts_the_train_split_alone(spark):
    texts = {1: "a b a b a c", 2: "a b a d", 3: "z b  b"}
    words = spark.createDataFrame([(i, k, w) for i, t in texts.items() for k, w in enumerate(t.split(" "))], "sequence_id long, pos long, token string")
    splits = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "test")], "sequence_id long, split string")
    got = {r["split"]: (r["tokens"], r["nll"], r["top1"]) for r in rules.evaluate_trained(words, splits).collect()}
    v = 6  # a b c d z and the empty token, which is no target
    train = [(2, 3), (2, 2), (2, 3), (2, 2), (1, 3)]
    validation = [(2, 3), (2, 2), (0, 3)]
    test = [(0, 0), (0, 0)]
    loss = lambda rows: round(-sum(math.log((c + 1) / (n + v)) for c, n in rows) / len(rows), 4)
    assert got == {"train": (5, loss(train), 0.8), "validation": (3, loss(validation), round(2 / 3, 6)), "test": (2, loss(test), 0.0)}
