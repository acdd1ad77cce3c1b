"""Hand-made cases of the second stage: one encoding a phrase, variants in token space, the gate, all-or-nothing publication."""

import pytest
from pyspark.sql import functions as F

from symcorpus.operators import second_stage as two
from symcorpus.operators.tokens import id_of
from symcorpus.sources import runs

PITCH, SIZE = id_of("Pitch"), 21
RECORD = (
    "source_id long, phrase_index long, semitones int, split string, track_number int, instrument_index int, output_file string, num_notes long, num_bends int, num_expressive int, bend_range int, "
    "synthetic_initial boolean, synthetic_reset boolean, output_sha256 string, output_size_bytes long, coverage string, techniques array<struct<type:string,note_index:int>>, nominal_duration double, actual_duration double, tonic string, mode string"
)


def record(source=1, phrase=0, semitones=0, notes=2, tonic="C", mode="MAJOR", file="run/train/a.mid"):
    return (source, phrase, semitones, "train", 0, 0, file, notes, 0, 0, None, False, False, "0" * 64, 40, "COMPLETE", [("VIBRATO", 1)], 8.0, 8.0, tonic, mode)


def mode_name():
    from symcorpus.operators.tonality import MODES

    return next(iter(MODES))


@pytest.fixture(scope="module")
def stage(spark):
    phrases = spark.createDataFrame([(1, 0, 0, 0, 480, 60, 90), (1, 0, 1, 1920, 2400, 64, 90), (2, 0, 0, 0, 480, 108, 90), (2, 0, 1, 480, 960, 100, 90)], "source_id long, phrase_index long, note_index int, onset_tick long, end_tick long, pitch int, velocity int")
    wheel = spark.createDataFrame([(1, 10, 4096), (1, 12, 100), (1, 500, 0)], "source_id long, tick long, value int")
    labels = spark.createDataFrame([(1, 0, 1, "VIBRATO", None), (1, 0, 1, "SLIDE_UP", 70), (1, 0, 1, "SLIDE_UP", 72)], "source_id long, phrase_index long, note_index int, type string, target_pitch int")
    tempi = spark.createDataFrame([(1, 120.0), (2, 40.0)], "source_id long, tempo_bpm double")
    sources = spark.createDataFrame([(1, "train", 0, True), (2, "train", 0, True), (3, "train", 0, True)], "source_id long, split string, instrument_index int, compatible boolean")
    return runs.staged(two.phrase_contents(phrases, wheel, labels, tempi)), sources


def test_contents_hold_labels_in_order_and_the_wheel(stage):
    one = stage[0].filter("source_id = 1").first()
    assert [n["labels"] for n in one["notes"]] == [[], ["SLIDE_UP", "VIBRATO"]]
    assert [tuple(e) for e in one["events"]] == [(10, 4096), (12, 100), (500, 0)]
    body = two.bodies(stage[0]).filter("source_id = 1").first()
    # ticks 10 and 12 lie in one cell
    assert (body["n_notes"], body["n_bends"], body["n_labels"]) == (2, 2, 2)


def test_variants_move_pitches_alone(spark, stage):
    mode = mode_name()
    rows = spark.createDataFrame([record(semitones=k, tonic=t, mode=mode) for k, t in ((0, "C"), (3, "D_SHARP"))], RECORD)
    got = {r["semitones"]: r["ids"] for r in two.framed(rows, two.bodies(stage[0])).collect()}
    pitches = {k: [i - PITCH + SIZE for i in ids if PITCH <= i < PITCH + 88] for k, ids in got.items()}
    assert pitches == {0: [60, 64], 3: [63, 67]}
    rest = [[i for i in ids[3:] if not PITCH <= i < PITCH + 88] for ids in got.values()]
    assert rest[0] == rest[1] and got[3][1] - got[0][1] == 3 and got[0][0] == id_of("BOS") and got[0][-1] == id_of("EOS")


def test_gate_and_rules_name_every_failure(spark, stage):
    mode = mode_name()
    rows = [
        record(mode=mode), record(semitones=1, mode=mode, notes=3), record(semitones=2, mode=mode, file="run/train/a.wav"), record(phrase=7, mode=mode), record(2, semitones=1, mode=mode), record(9, mode=mode),
        record(semitones=None, mode=mode), record(semitones=4, mode=mode), record(semitones=4, mode=mode),
    ]
    declared = spark.createDataFrame(rows, RECORD)
    # the labels of source 1 are two distinct ones on a note; its records name one, which the stage does not count
    made = two.tokenized_fragments(declared, stage[1], stage[0], "run", 64)
    assert [(r["source_id"], r["semitones"]) for r in made.rows.collect()] == [(1, 0)]
    told = {(r["source_id"], r["phrase_index"], r["semitones"]): r["rules"] for r in made.failures.collect()}
    assert told[1, 0, 1] == "declared notes differ"
    assert told[1, 0, 2] == "no MIDI file"
    assert told[1, 7, 0] == "phrase without contents"
    assert "id outside the vocabulary" in told[2, 0, 1] and "note count differs" in told[2, 0, 1]
    assert "absent or incompatible source" in told[9, 0, 0]
    assert "missing semitones" in told[1, 0, None] and told[1, 0, 4] == "declared twice" and len(told) == 7
    short = two.tokenized_fragments(declared.limit(1), stage[1], stage[0], "run", 5)
    assert short.rows.count() == 0 and short.failures.first()["rules"] == "too long"
    none = two.tokenized_fragments(declared.limit(0), stage[1], stage[0], "run", 64)
    assert none.rows.count() == 0 and none.failures.count() == 0


def test_sequences_are_published_all_or_none(spark, stage, tmp_path):
    root = str(tmp_path)
    runs.write_manifest(root, "one", {}, stage[1], spark.createDataFrame([record(mode=mode_name())], RECORD))
    held = runs.read_manifest(spark, root)
    made = two.tokenized_fragments(held.fragments, held.sources, stage[0], "run", 64)
    bad = spark.createDataFrame([(1, 0, k, "too long") for k in range(7)], "source_id long, phrase_index long, semitones int, rules string")
    place = f"{root}/tokenized"
    with pytest.raises(runs.Rejected, match="7 declared fragments rejected: 1/0/0: too long"):
        runs.write_sequences(place, held, {"limit": 64}, made.rows, bad, two.FRAGMENT)
    with pytest.raises(ValueError, match="no current run"):
        runs.read_sequences(spark, place)
    first = runs.write_sequences(place, held, {"limit": 64}, made.rows, made.failures, two.FRAGMENT)
    assert runs.write_sequences(place, held, {"limit": 64}, made.rows, made.failures, two.FRAGMENT) == first
    got = runs.read_sequences(spark, place, held)
    assert got.run_id == first and got.first_run == "one" and got.summary["sequences"] == 1
    assert got.summary["total_tokens"] == got.rows.select(F.sum(F.size("ids"))).first()[0]
    with pytest.raises(runs.Drift, match="made from run one"):
        runs.read_sequences(spark, place, held._replace(run_id="other"))
    assert runs.write_sequences(place, held, {"limit": 32}, made.rows, made.failures, two.FRAGMENT) != first


def test_phrases_are_encoded_once(spark, stage, tmp_path):
    rows = spark.createDataFrame([record(mode=mode_name()), record(semitones=1, mode=mode_name(), notes=3), record(semitones=2, mode=mode_name(), file="run/train/a.wav")], RECORD)
    plans = []

    def keep(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        frame.write.parquet(place := str(tmp_path / str(len(plans))))
        return spark.read.schema(frame.schema).parquet(place)

    plain, once = (two.tokenized_fragments(rows, stage[1], stage[0], "run", 64, *more) for more in ((), (keep,)))
    assert sum("Window" in p for p in plans) == 1
    assert not any("Window" in x._jdf.queryExecution().optimizedPlan().toString() for x in once)
    for a, b in zip(plain, once):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
