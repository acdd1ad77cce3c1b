"""Sidecars whose heads are written and read back: a number that is no integer spoils its own sidecar alone."""

import json

from pyspark.sql import functions as F

from symcorpus.operators import sidecars as sc
from symcorpus.sources import runs

HASH = "a" * 64
NOTE = {"onset_tick": 0, "end_tick": 10, "pitch": 60, "velocity": 90}


def labels(note, start=0):
    root = {"schema_version": 1, "source_midi": "a.mid", "source_sha256": HASH, "ticks_per_quarter": 480, "instrument_index": 1, "coverage": "COMPLETE"}
    return json.dumps(root | {"note_techniques": [{"note": note, "techniques": [{"type": "VIBRATO"}]}], "palm_mute_ranges": [{"start_tick": start, "end_tick": 5}]})


def test_fractions_in_one_sidecar_leave_the_integers_of_others(spark):
    texts = [labels(NOTE), labels(NOTE | {"velocity": 90.0}), labels(NOTE, start=0.0), labels(NOTE)]
    rows = spark.createDataFrame([(i, "techniques", text) for i, text in enumerate(texts)], "source_id long, kind string, text string").coalesce(1)
    ids = spark.range(len(texts)).withColumnRenamed("id", "source_id")
    sources = ids.select("source_id", F.lit("a.mid").alias("name"), F.lit(HASH).alias("sha256"), F.lit(480).alias("ppq"), F.lit(1).alias("instrument_index"), F.lit(2).alias("n_tracks"))
    notes = ids.select("source_id", *[F.lit(v).alias(k) for k, v in NOTE.items()])
    together = lambda df: runs.staged(df.coalesce(1))
    got = sc.read_sidecars(rows, sources, notes, ids.withColumn("fin", F.lit(60)), together)
    assert sorted(map(tuple, got.issues.collect())) == [(1, "techniques", "note velocity"), (2, "techniques", "range start_tick")]
    assert sorted(r["source_id"] for r in got.annotations.filter("type = 'VIBRATO'").collect()) == [0, 3]
    assert sorted(map(tuple, got.ranges.collect())) == [(0, 0, 5), (3, 0, 5)]
