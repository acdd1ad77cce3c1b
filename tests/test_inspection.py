"""Every rule of the inspection by hand-made files, one broken rule each, and the verdicts on them."""

import pytest

from symcorpus.operators import inspection as ins

NOTES = "source_id long, instrument_index int, is_drum boolean, seq long, onset_tick long, end_tick long, pitch int, velocity int"
WHEEL = "source_id long, instrument_index int, seq long, tick long, value int"
CONTROLS = "source_id long, instrument_index int, seq long, tick long, number int, value int"
MESSAGES = "source_id long, track int, ord long, delta long, on_flag int, pitch int, velocity int"
GOOD = [(101, 0), (100, 0), (6, 6)]


def setup(rows, tick=0):
    return [(k, tick, n, v) for k, (n, v) in enumerate(rows)]


@pytest.mark.parametrize(
    "rows, semitones, issue",
    [
        (setup(GOOD), 6.0, None),
        (setup([*GOOD, (38, 50)]), 6.5, None),
        (setup([*GOOD, (38, 50), (38, 25)]), 6.25, None),
        (setup([*GOOD, *GOOD]), 6.0, None),
        (setup([*GOOD, (6, 6), (38, 0)]), 6.0, None),
        (setup([(6, 2)]), None, "data entry without parameter"),
        (setup([(101, 0), (100, 1), (6, 2)]), None, "data entry without parameter"),
        (setup([(101, 0), (100, 0), (6, 0)]), None, "range not positive"),
        (setup([(101, 0), (100, 0)]), None, "selection without a range"),
        (setup([(101, 0), (100, 0), (38, 5)]), None, "fine range without a coarse one"),
        (setup([*GOOD, (101, 0), (38, 5)]), None, "fine range without a coarse one"),
        (setup([*GOOD, (101, 0), (100, 0), (6, 5)]), None, "range changes"),
        (setup([*GOOD, (38, 10), (101, 0), (100, 0), (6, 6)]), None, "range changes"),
        (setup([(7, 100), *GOOD]), None, "unsupported controller"),
        (setup([*GOOD, (6, 7), (64, 0)]), None, "unsupported controller"),
        (setup(GOOD, -1), None, "range controls out of time"),
        # order is that of ticks, then of numbers in the file
        ([(0, 10, 6, 6), (1, 0, 101, 0), (2, 0, 100, 0)], 6.0, None),
    ],
)
def test_scan_of_the_range(spark, rows, semitones, issue):
    frame = spark.createDataFrame([(1, 0, *r) for r in rows], "source_id long, instrument_index int, seq long, tick long, number int, value int")
    assert tuple(ins.bend_ranges(frame, "source_id").first())[1:] == (semitones, issue)


def tracks_of(spark, notes, wheel=(), controls=(), **rules):
    frames = spark.createDataFrame(notes, NOTES), spark.createDataFrame(list(wheel), WHEEL), spark.createDataFrame(list(controls), CONTROLS)
    return {(r["source_id"], r["instrument_index"]): r for r in ins.inspect_tracks(*frames, ins.Rules(**{"least_notes": 2} | rules)).collect()}


def line(source, track=0, drum=False, low=60, n=3):
    return [(source, track, drum, k, 100 * k, 100 * k + 50, low + k, 90) for k in range(n)]


def controls(source, rows=GOOD, tick=0, track=0):
    return [(source, track, k, tick, n, v) for k, (n, v) in enumerate(rows)]


def test_rules_of_tracks_come_in_their_order(spark):
    notes = [*line(1), *line(1)[:1], *line(2, drum=True, low=10, n=1), *line(3), *line(4), *line(5), *line(6), *line(7), (8, 0, False, 0, -5, 10, 60, 9), (8, 0, False, 1, 7, 7, 61, 9), (8, 0, False, 2, 7, 9, 61, 9)]
    wheel = [(1, 0, 0, 5, 100), (1, 0, 1, 6, 0), (3, 0, 0, 5, 100), (4, 0, 0, 5, 100), (5, 0, 0, 5, -8192), (6, 0, 0, 5, 0), (7, 0, 0, 5, 9000), (7, 0, 1, -5, 1)]
    told = [*controls(1), *controls(4, tick=6), *controls(5, [(101, 0), (100, 0), (6, 12)]), *controls(6, [(101, 0), (100, 0)]), *controls(7, [(101, 0), (100, 0), (6, 2)], -0)]
    got = tracks_of(spark, notes, wheel, told)
    reasons = {k[0]: r["reason"] for k, r in got.items()}
    assert reasons == {
        1: "", 2: "drum track, too few notes, pitch out of range", 3: "wheel moves without a range", 4: "range set after the wheel moves", 5: "wheel beyond 6 semitones",
        6: "selection without a range", 7: "range set after the wheel moves, 2 invalid wheel events", 8: "2 invalid notes",
    }
    one = got[1, 0]
    assert (one["raw_notes"], one["n_notes"], one["collapsed"], one["n_bends"], one["n_expressive"], one["bend_range"], one["compatible"]) == (4, 3, 1, 2, 1, 6.0, True)
    assert got[6, 0]["bend_range"] is None and got[4, 0]["issues"] == ["range set after the wheel moves"]


def messages_of(notes, track=0, source=1):
    """On and off rows by time; a note is (onset, end or None, pitch, velocity)."""
    rows = sorted([(a, 1, p, v) for a, z, p, v in notes] + [(z, 0, p, 0) for a, z, p, v in notes if z is not None])
    ticks = [r[0] for r in rows]
    return [(source, track, k, t - (ticks[k - 1] if k else 0), f, p, v) for k, (t, f, p, v) in enumerate(rows)]


def test_lifetimes_of_notes(spark):
    cases = {
        1: ([(0, 10, 60, 9), (10, 20, 60, 9)], None),
        2: ([(0, 10, 60, 9), (5, 20, 60, 9)], "notes overlap"),
        3: ([(0, 10, 60, 9), (0, 10, 60, 9)], None),
        4: ([(0, 10, 60, 9), (0, 12, 60, 9)], "notes overlap"),
        5: ([(0, None, 60, 9), (30, 40, 61, 9)], "note-on without an end"),
        6: ([(0, 10, 60, 9), (0, 10, 60, 8)], "notes overlap"),
    }
    rows = [m for k, (notes, _) in cases.items() for m in messages_of(notes, source=k)]
    # the first broken track names the issue
    rows += messages_of([(0, None, 60, 9)], 0, 7) + messages_of([(0, 10, 60, 9), (5, 20, 60, 9)], 1, 7)
    got = {r["source_id"]: r["issue"] for r in ins.lifetime_issues(spark.createDataFrame(rows, MESSAGES).repartition(3)).collect()}
    assert got == {k: issue for k, (_, issue) in cases.items() if issue} | {7: "note-on without an end"}


def found(spark, index=None, **rules):
    notes = [*line(1), *line(1, 1, n=4), *line(2), *line(3), *line(4), *line(5, drum=True), *line(6), *line(7), *line(8)]
    tempi = [(1, 0, 120.0), (1, 1, 120.0005), (3, 0, 120.0), (3, 1, 60.0), (4, 0, float("nan")), (6, 0, 90.0)]
    meters = [(1, 0, 4, 4), (3, 0, 10, 4), (3, 1, 3, 4), (3, 2, 4, 4)]
    heads = [(k, 1, 480, 2) for k in range(1, 7)] + [(7, 2, 0, 1), (8, 1, 480, 3), (9, 1, 480, 1)]
    meta = [(1, 0, "set_tempo"), (8, 2, "time_signature"), (8, 1, "set_tempo"), (8, 1, "text")]
    frames = (
        spark.createDataFrame(notes, NOTES), spark.createDataFrame([], WHEEL), spark.createDataFrame([], CONTROLS), spark.createDataFrame(messages_of([(0, None, 60, 9)], 0, 6), MESSAGES),
        spark.createDataFrame(tempi, "source_id long, seq int, bpm double"), spark.createDataFrame(meters, "source_id long, seq int, numerator int, denominator int"),
        spark.createDataFrame(heads, "source_id long, file_type int, ppq int, n_tracks int"), spark.createDataFrame(meta, "source_id long, track int, kind string"),
    )
    return ins.inspect(*frames, ins.Rules(**{"least_notes": 2} | rules), index)


def test_verdicts_on_files(spark):
    result = found(spark)
    got = {r["source_id"]: r for r in result.sources.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        1: None, 2: None, 3: "tempo changes; unsupported meters: 3/4, 10/4", 4: "tempo not a positive number", 5: "no valid track (instrument 0: drum track)", 6: "note-on without an end",
        7: "asynchronous file type 2", 8: "global events outside track 0: set_tempo, time_signature", 9: "no tracks",
    }
    assert (got[1]["instrument_index"], got[1]["tempo_bpm"], got[1]["n_tempi"], got[1]["meters"]) == (1, 120.0, 2, "4/4")
    assert (got[2]["tempo_bpm"], got[2]["n_tempi"], got[2]["meters"]) == (120.0, 0, "4/4 (implicit)")
    assert got[6]["tempo_bpm"] is None and got[6]["n_tracks"] == 0 and got[3]["meters"] == "10/4, 3/4, 4/4"
    assert tuple(ins.report_totals(result.sources).first()) == (9, 2, 7)
    assert {r["source_id"] for r in ins.merged_records(result.sources).filter("status = 'accepted' AND reason IS NULL").collect()} == {1, 2}
    assert [tuple(r) for r in ins.top_reasons(result.sources, 1).collect()] == [("asynchronous file type 2", 1)]
    missing = {r["source_id"]: r["reason"] for r in found(spark, meter_may_miss=False).sources.collect()}
    assert missing[2] == "meter is missing" and missing[1] is None


def test_a_track_may_be_asked_for(spark):
    got = {r["source_id"]: (r["instrument_index"], r["reason"]) for r in found(spark, 0).sources.collect()}
    assert got[1] == (0, None) and got[5] == (None, "track 0 is invalid: drum track")
    assert found(spark, 1).sources.filter("source_id = 2").first()["reason"] == "track 1 asked, which the file does not have"


def test_no_files_give_no_rows(spark):
    result = found(spark)
    assert ins.inspect_tracks(*(spark.createDataFrame([], s) for s in (NOTES, WHEEL, CONTROLS))).count() == 0 and result.tracks.count() == 9
