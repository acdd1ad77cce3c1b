"""Sidecars: one file that holds, and one for each rule that it can break."""

import json

import pytest
from pyspark.sql import functions as F

from symcorpus.operators import sidecars as sc

NOTES = [(0, 10, 60, 90), (20, 30, 62, 90), (40, 60, 64, 90)]
KEYS = ("onset_tick", "end_tick", "pitch", "velocity")
HASH = "a" * 64


def mark(note, *techniques):
    return {"note": dict(zip(KEYS, note)), "techniques": list(techniques)}


def slide(way, target):
    return {"type": "SLIDE", "direction": way, "target_pitch": target}


def labels(**changed):
    root = {"schema_version": 1, "source_midi": "a.mid", "source_sha256": HASH, "ticks_per_quarter": 480, "instrument_index": 1, "coverage": "COMPLETE"}
    root |= {"note_techniques": [mark(NOTES[0], {"type": "VIBRATO"}, slide("UP", 65)), mark(NOTES[1], {"type": "DEAD_NOTE"})], "palm_mute_ranges": [{"start_tick": 20, "end_tick": 41}]}
    return root | changed


def spans(*pairs):
    return labels(palm_mute_ranges=[{"start_tick": a, "end_tick": b} for a, b in pairs])


def tonality(**changed):
    return {"schema_version": 1, "source_midi": "a.mid", "source_sha256": HASH, "instrument_index": 1, "tonic": "A", "mode": "MINOR"} | changed


VIBRATO = {"type": "VIBRATO"}
CASES = [
    (labels(), None),
    (labels(note_techniques=[], palm_mute_ranges=[]), None),
    (labels(schema_version=True), "schema_version"),
    (labels(schema_version=1.0), "schema_version"),
    (labels(schema_version="1"), "schema_version"),
    (labels(source_midi="dir/a.mid"), "source_midi"),
    (labels(source_sha256="A" * 64), "source_sha256"),
    (labels(ticks_per_quarter=0), "ticks_per_quarter"),
    (labels(instrument_index=2), "instrument_index"),
    (labels(coverage=None), "coverage"),
    (labels(extra=1), "fields"),
    (labels(note_techniques=None), "note_techniques"),
    (labels(note_techniques=[7]), "entry is no object"),
    (labels(note_techniques=[{"note": {}}]), "entry fields"),
    (labels(note_techniques=[{"note": [], "techniques": []}]), "note is no object"),
    (labels(note_techniques=[{"note": {"onset_tick": 0}, "techniques": []}]), "note fields"),
    (labels(note_techniques=[mark((-1, 10, 60, 90), VIBRATO)]), "note onset_tick"),
    (labels(note_techniques=[mark((0, 10, 128, 90), VIBRATO)]), "note pitch"),
    (labels(note_techniques=[mark((20, 10, 60, 90), VIBRATO)]), "note ends before it starts"),
    (labels(note_techniques=[mark((0, 11, 60, 90), VIBRATO)]), "no such note"),
    (labels(note_techniques=[mark(NOTES[0], VIBRATO), mark(NOTES[0], VIBRATO)]), "note twice"),
    (labels(note_techniques=[mark(NOTES[0])]), "no techniques"),
    (labels(note_techniques=[mark(NOTES[0], "VIBRATO")]), "technique is no object"),
    (labels(note_techniques=[mark(NOTES[0], {"type": "PALM_MUTE"})]), "technique type"),
    (labels(note_techniques=[mark(NOTES[0], {"type": "VIBRATO", "target_pitch": 3})]), "technique fields"),
    (labels(note_techniques=[mark(NOTES[0], slide("LEFT", 61))]), "slide direction"),
    (labels(note_techniques=[mark(NOTES[0], slide("UP", 200))]), "slide target"),
    (labels(note_techniques=[mark(NOTES[0], slide("DOWN", 60))]), "slide distance"),
    (labels(note_techniques=[mark(NOTES[0], slide("UP", 85))]), "slide distance"),
    (labels(note_techniques=[mark(NOTES[0], slide("UP", 84))]), None),
    (labels(note_techniques=[mark(NOTES[0], VIBRATO, VIBRATO)]), "technique twice"),
    (labels(note_techniques=[mark(NOTES[0], slide("UP", 61), slide("DOWN", 59))]), "slide up and down"),
    (labels(note_techniques=[mark(NOTES[0], {"type": "DEAD_NOTE"}, VIBRATO)]), "dead note with another"),
    (labels(palm_mute_ranges={}), "palm_mute_ranges"),
    (labels(palm_mute_ranges=[1]), "range is no object"),
    (labels(palm_mute_ranges=[{"start_tick": 1}]), "range fields"),
    (spans((-1, 5)), "range start_tick"),
    (spans((5, 5)), "range ends before it starts"),
    (spans((0, 1 << 60)), "range beyond the source"),
    (spans((11, 20)), "range without a note"),
    (spans((0, 21), (20, 41)), "ranges overlap"),
    (spans((20, 41), (0, 20)), "ranges touch"),
    (tonality(), None),
    (tonality(tonic="UNKNOWN", mode="UNKNOWN"), None),
    (tonality(mode="UNKNOWN"), None),
    (tonality(tonic="UNKNOWN"), "mode without tonic"),
    (tonality(tonic="Db"), "tonic"),
    (tonality(mode=3), "mode"),
]
TEXTS = [
    (None, "no strict JSON"),
    ("", "no strict JSON"),
    ("[1]", "no object"),
    (json.dumps(labels()) + " x", "no strict JSON"),
    (json.dumps(labels()) + "],[1", "no strict JSON"),
    (json.dumps(labels()) + '},{"y":1', "no strict JSON"),
    (json.dumps(labels()).replace('"pitch": 60', '"pitch": 60, "pitch": 60'), "no strict JSON"),
    (json.dumps(labels()).replace("480", "NaN"), "no strict JSON"),
    (json.dumps(labels()) + " " * sc.MOST_BYTES["techniques"], "too large"),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(i, "tonality" if "tonic" in root else "techniques", json.dumps(root)) for i, (root, _) in enumerate(CASES)]
    rows += [(len(CASES) + i, "techniques", text) for i, (text, _) in enumerate(TEXTS)]
    n = len(rows)
    rows += [(n, "tonality", json.dumps(tonality()))] * 2 + [(n + 5, "tonality", json.dumps(tonality()))]
    ids = spark.range(n + 1).withColumnRenamed("id", "source_id")
    sources = ids.select("source_id", F.lit("a.mid").alias("name"), F.lit(HASH).alias("sha256"), F.lit(480).alias("ppq"), F.lit(1).alias("instrument_index"), F.lit(2).alias("n_tracks"))
    notes = ids.crossJoin(spark.createDataFrame(NOTES * 2, "onset_tick long, end_tick long, pitch int, velocity int"))
    return sc.read_sidecars(spark.createDataFrame(rows, "source_id long, kind string, text string"), sources, notes, ids.withColumn("fin", F.lit(60)))


def test_first_broken_rule_is_told(read):
    got = {r["source_id"]: r["reason"] for r in read.issues.collect()}
    wanted = {i: reason for i, (_, reason) in enumerate(CASES + TEXTS) if reason} | {len(CASES) + len(TEXTS): "several sidecars of a kind"}
    assert got == wanted


def test_whole_sidecars_give_their_rows(read):
    rows = {(r["onset_tick"], r["type"], r["target_pitch"]) for r in read.annotations.filter("source_id = 0").collect()}
    assert rows == {(0, "VIBRATO", None), (0, "SLIDE_UP", 65), (20, "DEAD_NOTE", None), (20, "PALM_MUTE", None), (40, "PALM_MUTE", None)}
    assert [tuple(r) for r in read.ranges.filter("source_id < 2").collect()] == [(0, 20, 41)]
    good = [i for i, (root, reason) in enumerate(CASES) if reason is None and "tonic" in root]
    assert sorted(r["source_id"] for r in read.tonalities.collect()) == good
    assert {r["source_id"] for r in read.annotations.select("source_id").distinct().collect()} <= {i for i, (root, reason) in enumerate(CASES) if reason is None}


def test_annotations_beyond_the_most_are_told(spark, monkeypatch):
    monkeypatch.setattr(sc, "MOST_ANNOTATIONS", 3)
    rows = [(0, "techniques", json.dumps(labels())), (1, "techniques", json.dumps(labels(palm_mute_ranges=[])))]
    ids = spark.range(2).withColumnRenamed("id", "source_id")
    sources = ids.select("source_id", F.lit("a.mid").alias("name"), F.lit(HASH).alias("sha256"), F.lit(480).alias("ppq"), F.lit(1).alias("instrument_index"), F.lit(2).alias("n_tracks"))
    notes = ids.crossJoin(spark.createDataFrame(NOTES, "onset_tick long, end_tick long, pitch int, velocity int"))
    got = sc.read_sidecars(spark.createDataFrame(rows, "source_id long, kind string, text string"), sources, notes, ids.withColumn("fin", F.lit(60)))
    assert [tuple(r) for r in got.issues.collect()] == [(0, "techniques", "too many annotations")]


def test_no_sidecars_give_no_rows(spark):
    none = spark.createDataFrame([], "source_id long, kind string, text string")
    sources = spark.createDataFrame([], "source_id long, name string, sha256 string, ppq int, instrument_index int, n_tracks int")
    notes = spark.createDataFrame([], "source_id long, onset_tick long, end_tick long, pitch int, velocity int")
    got = sc.read_sidecars(none, sources, notes, spark.createDataFrame([], "source_id long, fin long"))
    assert [d.count() for d in got] == [0, 0, 0, 0]


def test_orphans_of_both_kinds(spark):
    files = [("d/a.mid.techniques.json",), ("d/b.mid.techniques.json",), ("e/a.mid.tonality.json",), ("d/a.mid.tonality.json",), ("d/a.mid",)]
    got = sc.orphans(spark.createDataFrame(files, "path string"), spark.createDataFrame([("d/a.mid",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("d/b.mid.techniques.json", "techniques"), ("e/a.mid.tonality.json", "tonality")]
