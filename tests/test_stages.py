"""Hand-made cases of the first stage, of contracts, batches, histories, listings and manifests."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from symcorpus.functions import scalars
from symcorpus.operators import contracts, events, rules, sequences, splits, stages, tokens
from symcorpus.sources import runs

NOTES = "source_id long, instrument_index int, is_drum boolean, seq long, onset_tick long, end_tick long, pitch int, velocity int"
BENDS = "source_id long, seq long, tick long, value int"


def notes_of(spark, rows):
    return spark.createDataFrame([(s, 0, False, i, a, z, p, 90) for i, (s, a, z, p) in enumerate(rows)], NOTES)


def test_notes_of_other_tracks_never_reach_a_phrase(spark):
    rows = [(1, 0, False, 0, 0, 480, 60, 90), (1, 0, False, 1, 0, 480, 60, 90), (1, 3, True, 2, 0, 480, 36, 90)]
    chosen = spark.createDataFrame([(1, 0, None)], "source_id long, instrument_index int, reason string")
    got = stages.notes_of_tracks(spark.createDataFrame(rows, NOTES), chosen).collect()
    assert [(r["seq"], r["pitch"]) for r in got] == [(0, 60)]


def test_wheel_is_scaled_and_its_state_carried(spark):
    notes = notes_of(spark, [(1, 100, 200, 60), (2, 0, 50, 61), (3, 0, 50, 62), (4, 50, 90, 63)])
    bends = spark.createDataFrame([(1, 0, 10, 8191), (1, 1, 10, 4096), (1, 2, 150, 0), (2, 3, 5, 0), (3, 4, 5, 100), (4, 5, 10, 8191), (4, 6, 20, 0), (4, 7, 70, -8192)], BENDS)
    ranges = spark.createDataFrame([(1, 12), (2, 2), (4, 6)], "source_id long, bend_range int")
    clean, wheel, gone = stages.normalized(notes, bends, ranges)
    # source 1: the last value of tick 10 at twelve semitones is twice as far at six, and is carried to 0
    got = sorted((r["source_id"], r["tick"], r["value"]) for r in wheel.collect())
    assert got == [(1, 0, 8191), (1, 50, 0), (4, 20, -8192)]
    assert {r["source_id"]: r["reason"] for r in gone.collect()} == {3: "bends without a range"}
    assert sorted((r["source_id"], r["onset_tick"], r["source_tick"]) for r in clean.collect()) == [(1, 0, 100), (2, 0, 0), (4, 0, 50)]
    far = spark.createDataFrame([(1, 24)], "source_id long, bend_range int")
    assert [r["reason"] for r in stages.normalized(notes.filter("source_id = 1"), bends, far)[2].collect()] == ["bend beyond six semitones"]


def test_notes_that_meet_on_the_grid_discard_their_source(spark):
    notes = notes_of(spark, [(1, 0, 100, 60), (1, 20, 130, 60), (2, 0, 100, 60), (2, 90, 200, 60)])
    none = spark.createDataFrame([], BENDS), spark.createDataFrame([], "source_id long, bend_range int")
    clean, _, gone = stages.normalized(notes, *none, 120)
    assert [(r["source_id"], r["reason"]) for r in gone.collect()] == [(1, "notes meet on the grid")] and {r["source_id"] for r in clean.collect()} == {2}


def test_windows_carry_and_reset_the_wheel(spark):
    wheel = spark.createDataFrame([(1, 100, 500), (1, 7680, -5), (1, 7700, 0), (1, 30000, 7)], "source_id long, tick long, value int")
    windows = spark.createDataFrame([(1, k) for k in (0, 1, 2, 3, 5)], "source_id long, phrase_index long")
    got = {r["phrase_index"]: ([tuple(x) for x in r["events"]], r["synthetic_initial"], r["synthetic_reset"]) for r in events.sliced_bends(wheel, windows).collect()}
    assert got == {
        0: ([(100, 500, False), (7680, 0, True)], False, True),
        1: ([(0, -5, False), (20, 0, False)], False, False),
        3: ([(6960, 7, False), (7680, 0, True)], False, True),
        5: ([(0, 7, True), (7680, 0, True)], True, True),
    }


def test_labels_follow_notes_and_drop_variants(spark):
    notes = stages.notes_of_tracks(notes_of(spark, [(1, 0, 100, 60), (1, 480, 600, 62), (1, 960, 1000, 64), (2, 0, 100, 60)]), spark.createDataFrame([(1, 0), (2, 0)], "source_id long, instrument_index int"))
    none = spark.createDataFrame([], BENDS), spark.createDataFrame([], "source_id long, bend_range int")
    clean, wheel, _ = stages.normalized(notes, *none)
    phrases = stages.phrases_of(clean, 1)
    labels = spark.createDataFrame([(1, 480, 600, 62, 90, "SLIDE_UP", 66), (1, 0, 100, 60, 90, "VIBRATO", None), (2, 0, 100, 60, 90, "VIBRATO", None)], "source_id long, onset_tick long, end_tick long, pitch int, velocity int, type string, target_pitch int")
    mutes = spark.createDataFrame([(1, 400, 700)], "source_id long, start_tick long, end_tick long")
    coverage = spark.createDataFrame([(1, "COMPLETE"), (2, "UNLABELED")], "source_id long, coverage string")
    told = stages.phrase_labels(phrases, labels, mutes, coverage)
    split = spark.createDataFrame([(1, "train"), (2, "test")], "source_id long, split string")
    made = stages.fragments(phrases, wheel, told, split, stages.Limits(1, 58, 67, -2, 2)).collect()
    assert sorted((r["source_id"], r["semitones"]) for r in made) == [(1, -2), (1, -1), (1, 0), (1, 1), (2, 0)]
    one = next(r for r in made if r["source_id"] == 1)
    assert [tuple(x) for x in one["techniques"]] == [("VIBRATO", 0), ("PALM_MUTE_ON", 1), ("SLIDE_UP", 1), ("PALM_MUTE_OFF", 2)]
    assert (one["num_notes"], one["num_bends"], one["bend_range"]) == (3, 0, None)


def test_ticks_and_seconds(spark):
    good, bad = (F.lit(120.0), F.lit(480)), (F.lit(0.0), F.lit(480))
    row = spark.range(1).select(scalars.ticks_to_seconds(F.lit(720), *good), scalars.seconds_to_ticks(F.lit(0.75), *good), scalars.seconds_to_ticks(F.lit(1.0), *bad), scalars.timing_issue(*bad), scalars.timing_issue(*good)).first()
    assert tuple(row) == (0.75, 720, None, "tempo or resolution not positive", None)


def test_files_are_found_in_any_case_and_ranked(spark, tmp_path):
    for name in ("b.MID", "a/x.midi", "A.mid", "note.txt", "a.mid.bak", "Z/y.Mid"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xx")
    got = runs.listed(runs.scan_files(spark, str(tmp_path))).orderBy("rank").collect()
    assert [r["path"].rsplit(tmp_path.name + "/", 1)[1] for r in got] == ["A.mid", "a/x.midi", "b.MID", "Z/y.Mid"] and [r["rank"] for r in got] == [0, 1, 2, 3]
    assert {r["size_bytes"] for r in got} == {2}
    with pytest.raises(AnalysisException):
        runs.scan_files(spark, f"{tmp_path}/missing").collect()


def test_manifest_names_one_run_and_strays_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    sources = spark.createDataFrame([(1, "train", True), (2, "none", False)], "source_id int, split string, compatible boolean")
    parts = spark.createDataFrame([(1, 0, "train"), (1, 1, "train")], "source_id int, phrase_index int, split string")
    assert runs.write_manifest(root, "old", {"a": 1}, sources, parts) == {"discovered_files": 2, "compatible_sources": 1, "discarded_sources": 1, "generated_fragments": 2}
    runs.publish(parts.withColumn("phrase_index", F.lit(9)), root, "fragments-stray")
    runs.write_manifest(root, "new", {"a": 2}, sources, parts.filter("phrase_index = 0"))
    held = runs.read_manifest(spark, root)
    assert (held.run_id, held.configuration, held.summary["generated_fragments"]) == ("new", {"a": 2}, 1)
    assert [(r["source_id"], r["phrase_index"]) for r in held.fragments.collect()] == [(1, 0)] and held.sources.count() == 2
    stray = spark.createDataFrame([(1, 0, "x"), (1, 7, "y")], "source_id int, phrase_index int, data string")
    assert [r["data"] for r in runs.declared_only(stray, held.fragments, ["source_id", "phrase_index"]).collect()] == ["x"]
    with pytest.raises(ValueError):
        runs.read(spark, root, "fragments-absent")


def test_batches_are_padded_to_their_longest(spark):
    rows = [(1, [5, 6, 7], "UNLABELED"), (2, [5, 8], "COMPLETE"), (3, [5, 6, 6, 9, 7], "UNLABELED")]
    frame = spark.createDataFrame(rows, "sequence_id long, ids array<int>, coverage string")
    got = {r["sequence_id"]: r.asDict() for r in sequences.padded_batches(frame, 2, 0, [6], runs.staged).collect()}
    assert (got[1]["input_ids"], got[1]["target_ids"], got[1]["unknown_mask"]) == ([5, 6], [6, 7], [False, True])
    assert (got[2]["input_ids"], got[2]["target_ids"], got[2]["attention_mask"], got[2]["unknown_mask"]) == ([5, 0], [8, 0], [True, False], [False, False])
    assert (got[3]["batch"], got[3]["place"], got[3]["length"], got[3]["unknown_mask"]) == (1, 0, 4, [False, True, True, False])
    with pytest.raises(Exception, match="pad inside sequence 4"):
        sequences.padded_batches(spark.createDataFrame([(4, [1, 0, 2], "COMPLETE")], frame.schema), 2, 0, [], runs.staged).collect()


def test_pairs_of_arrays(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, []), (4, None)], "sequence_id long, tokens array<string>")
    assert sorted(tuple(r) for r in sequences.pairs_of(frame).collect()) == [(1, 0, "a", "b"), (1, 1, "b", "c")]


def test_header_rules(spark):
    headers = spark.createDataFrame([(1, 1, 480, 3), (2, 2, 480, 1), (3, 1, 0, 1), (4, 0, 96, 2), (5, 1, 96, 2), (6, 0, 96, 1)], "source_id long, file_type int, ppq int, n_tracks int")
    meta = spark.createDataFrame([(1, 2, "time_signature"), (1, 1, "set_tempo"), (1, 1, "text"), (5, 0, "set_tempo"), (6, 1, "set_tempo")], "source_id long, track int, kind string")
    got = {r["source_id"]: r["reason"] for r in contracts.header_issues(headers, meta).collect()}
    assert got == {1: "global events outside track 0: set_tempo, time_signature", 2: "asynchronous file type 2", 3: "ticks per beat not positive", 4: "file type 0 with more than one track"}


def test_label_rules(spark):
    told = {1: [("SLIDE_UP", 0), ("SLIDE_DOWN", 0)], 2: [("VIBRATO", 1), ("VIBRATO", 0)], 3: [("PALM_MUTE_ON", 0), ("PALM_MUTE_OFF", 0)], 4: [("HUM", 0)], 5: [("VIBRATO", 9)], 6: [("VIBRATO", 0), ("VIBRATO", 0)], 7: [("VIBRATO", 0)], 8: [("SLIDE_UP", 0), ("VIBRATO", 0), ("DEAD_NOTE", 2)]}
    labels = spark.createDataFrame([(k, i, *x) for k, some in told.items() for i, x in enumerate(some)], "key long, at int, type string, note_index int")
    records = spark.createDataFrame([(k, "UNLABELED" if k == 7 else "COMPLETE", 3) for k in told], "key long, coverage string, num_notes int")
    got = {}
    for r in contracts.label_issues(labels, records).collect():
        got.setdefault(r["key"], set()).add(r["rule"])
    assert got == {1: {"slide up and down"}, 2: {"labels out of order"}, 3: {"mute on and off"}, 4: {"unknown label"}, 5: {"label outside the notes"}, 6: {"label twice"}, 7: {"labels without coverage"}}


def test_sampling_rules(spark):
    streams = {
        0: "Bar_None Position_0 Tempo_121.29 Pitch_60 Duration_1.0.24 Bar_None EOS_None",
        1: "Bar_None Position_5 Pitch_60 Duration_1.0.24 Position_5 Pitch_61 Duration_1.0.24 Bar_None EOS_None",
        2: "Bar_None Position_0 Pitch_60 Duration_1.0.24 Pitch_60 Duration_1.0.24 EOS_None",
        3: "Bar_None Position_0 Pitch_60 Duration_1.0.24 Technique_PALM_MUTE_OFF Technique_VIBRATO Technique_DEAD_NOTE Technique_VIBRATO Bar_None EOS_None",
        4: "Bar_None Position_0 Pitch_60 Duration_1.0.24 Technique_PALM_MUTE_ON Position_4 Pitch_61 Duration_1.0.24 Technique_PALM_MUTE_ON Technique_SLIDE_UP Technique_SLIDE_DOWN Bar_None EOS_None",
    }
    frame = spark.createDataFrame([(1, k, i, w) for k, s in streams.items() for i, w in enumerate(s.split())], "source_id long, phrase_index int, pos long, token string")
    got = {}
    for r in contracts.token_rules(tokens.typed(frame), 2, 6).collect():
        got.setdefault(r["phrase_index"], {})[r["rule"]] = r["n"]
    assert got == {
        1: {"position falls": 1}, 2: {"pitch twice at a place": 1, "EOS does not follow a bar": 1},
        3: {"mute does not alternate": 1, "dead note with another label": 2, "label twice": 1}, 4: {"mute does not alternate": 1, "slide up and down": 1},
    }
    assert {r["rule"] for r in contracts.token_rules(tokens.typed(frame), 1, 99).collect()} >= {"too many notes at a place", "EOS too early"}


def test_objective_and_history_rules(spark):
    rows = spark.createDataFrame([(1, 0, True), (2, 8, True), (3, 8, False), (4, 99, False), (5, 3, True)], "row_id long, target int, unknown boolean")
    assert sorted(tuple(r) for r in rules.objective_issues(rows, 0, [8, 9], 64).collect()) == [(1, "unknown padding"), (2, "unknown prompt"), (4, "target outside the vocabulary")]
    history = spark.createDataFrame([(1, 1, 2.0, 10), (1, 2, 1.0, 10), (1, 3, 1.5, 10), (2, 1, 1.0, 4), (2, 3, float("inf"), 4)], "run_id long, epoch int, validation_loss double, tokens long")
    told = spark.createDataFrame([(1, 2, 1.0, 1), (2, 1, 1.0, 2)], "run_id long, best_epoch int, best_loss double, without int")
    types = spark.createDataFrame([(1, k, t, n, loss) for k, loss in ((1, 2.0), (2, 1.0), (3, 1.5)) for t, n in (("a", 4), ("b", 6))] + [(2, 1, "a", 3, 1.2), (2, 3, "a", 4, 1.0)], "run_id long, epoch int, type string, n long, loss double")
    got = sorted(tuple(r) for r in rules.history_issues(history, told, types).collect())
    assert got == [(2, "epochs with gaps"), (2, "loss not finite"), (2, "losses of types disagree"), (2, "type counts do not add up")]


def test_limits_count_muted_notes(spark):
    ann = spark.createDataFrame([(1,)] * 3 + [(2,)], "source_id long")
    notes = spark.createDataFrame([(2, True)] * 4 + [(2, False)], "source_id long, muted boolean")
    ranges = spark.createDataFrame([(2,)], "source_id long")
    assert [tuple(r) for r in contracts.limit_issues(ann, notes, ranges, 4).collect()] == [(2, 2, 5)]


def test_run_id_covers_configuration_and_sidecars(spark):
    rows = [(f"p{i}", f"{i:064x}", None if i % 2 else "s") for i in range(50)]
    frame = spark.createDataFrame(rows, "path string, sha256 string, sidecar string")
    one = lambda f, c: splits.canonical_run_id(f, c).first()[0]
    base = one(frame, {"a": 1, "b": [2]})
    assert base == one(frame.orderBy(F.desc("path")).repartition(5), {"b": [2], "a": 1}) and len(base) == 20
    assert len({base, one(frame, {"a": 2, "b": [2]}), one(frame.fillna("t", ["sidecar"]), {"a": 1, "b": [2]}), one(frame.limit(49), {"a": 1, "b": [2]})}) == 4


def test_donor_ties_of_splits():
    assert splits.allocate_splits(4, (0.475, 0.475, 0.05)) == [1, 2, 1]
    assert splits.allocate_splits(0) == [0, 0, 0] and splits.allocate_splits(10**12) == [8 * 10**11, 10**11, 10**11]


def _tables(spark):
    sources = spark.createDataFrame([(1, True, "train"), (2, False, "none")], "source_id int, compatible boolean, split string")
    return sources, spark.createDataFrame([(1, 0, "train"), (1, 1, "train")], "source_id int, phrase_index int, split string")


def test_drift_stops_a_publication(spark, tmp_path):
    sources, parts = _tables(spark)
    before = spark.createDataFrame([(k, "x") for k in range(9)], "key int, sha256 string")
    after = spark.createDataFrame([(k, "y" if k > 1 else "x") for k in range(1, 10)], "key int, sha256 string")
    runs.write_manifest(str(tmp_path), "one", {}, sources, parts, lambda: (before, before))
    with pytest.raises(runs.Drift, match=r"9 inputs .*: 0 \(removed\), 2 \(changed\), 3 \(changed\), 4 \(changed\), 5 \(changed\)$"):
        runs.write_manifest(str(tmp_path), "two", {}, sources, parts, lambda: (before, after))
    assert runs.read_manifest(spark, str(tmp_path)).run_id == "one"
    with pytest.raises(ValueError, match="not declared"):
        runs.read(spark, str(tmp_path), "fragments-two")


def test_one_of_many_writers_declares(spark, tmp_path):
    made = [runs.prepare(spark.createDataFrame([(k, "train")], "x int, split string"), str(tmp_path), "r") for k in (1, 2, 1)]

    def attempt(m):
        try:
            return runs.declare(spark, str(tmp_path), "r", m)[1]
        except (ValueError, runs.Conflict) as lost:
            return type(lost).__name__

    with ThreadPoolExecutor(12) as pool:
        assert sum(pool.map(lambda k: runs.create_once(spark, f"{tmp_path}/once", str(k)), range(12))) == 1
    assert [attempt(m) for m in made] == ["created", "ValueError", "reused"]
    assert [r["x"] for r in runs.read(spark, str(tmp_path), "r", verify=True).collect()] == [1]


def test_a_later_version_needs_the_one_it_follows(spark, tmp_path):
    sources, parts = _tables(spark)
    root = str(tmp_path)
    runs.write_manifest(root, "one", {}, sources, parts)
    runs.write_manifest(root, "two", {}, sources, parts.limit(1), follows=1)
    with pytest.raises(runs.Conflict):
        runs.write_manifest(root, "three", {}, sources, parts.limit(0), follows=1)
    assert runs.read_manifest(spark, root).run_id == "two"
    assert runs.write_manifest(root, "two", {}, sources, parts.limit(1), follows=1)["generated_fragments"] == 1  # says the same
    assert runs.write_manifest(root, "none", {}, sources.limit(0), parts.limit(0)) == {"discovered_files": 0, "compatible_sources": 0, "discarded_sources": 0, "generated_fragments": 0}


def test_rows_that_are_not_what_was_declared_are_refused(spark, tmp_path):
    sources, parts = _tables(spark)
    runs.write_manifest(str(tmp_path), "one", {}, sources, parts)
    place = runs._entry(spark, str(tmp_path), "fragments-one")["place"]
    parts.limit(1).write.mode("append").partitionBy("split").parquet(place)
    with pytest.raises(ValueError, match="does not hold"):
        runs.read_manifest(spark, str(tmp_path))
    with pytest.raises(ValueError, match="plain name"):
        runs.publish(parts, str(tmp_path), "../x")
