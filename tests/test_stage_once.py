"""The second stage reads what the first one wrote: no given table is read again for the contents of phrases."""

import pytest

from symcorpus.operators import stages
from symcorpus.plans import second_stage_queries
from symcorpus.sources import runs


class Stopped(Exception):
    pass


def test_contents_of_phrases_read_written_tables_alone(spark, monkeypatch):
    def publish(rows, *_):
        raise Stopped(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(runs, "publish", publish)
    with pytest.raises(Stopped) as stopped:
        second_stage_queries._first(spark, "/root/testdata/sf0.001", True)
    plan = str(stopped.value)
    assert "tempo_bpm" in plan and "event_id" not in plan


def test_notes_of_labelled_sources_are_written_once(spark):
    phrases = spark.createDataFrame([(s, 0, i, i, 10 * i, 10 * i + 9, 60 + i, 90) for s in (1, 2) for i in range(4)], "source_id long, phrase_index long, note_index int, seq long, source_tick long, source_end long, pitch int, velocity int")
    labels = spark.createDataFrame([(s, 10, 19, 61, 90, "VIBRATO", None) for s in (1, 2)], "source_id long, onset_tick long, end_tick long, pitch int, velocity int, type string, target_pitch int")
    mutes = spark.createDataFrame([(1, 5, 25), (1, 8, 12), (2, 0, 99)], "source_id long, start_tick long, end_tick long")
    coverage = spark.createDataFrame([(1, "COMPLETE"), (2, "UNLABELED")], "source_id long, coverage string")
    kept = []

    def keep(rows):
        kept.append(runs.staged(rows))
        return kept[-1]

    got = stages.phrase_labels(phrases, labels, mutes, coverage, keep)
    assert sorted(map(tuple, got.select("source_id", "note_index", "type").collect())) == [(1, 1, "PALM_MUTE_ON"), (1, 1, "VIBRATO"), (1, 3, "PALM_MUTE_OFF")]
    assert len(kept) == 1 and {r["source_id"] for r in kept[0].collect()} == {1}
