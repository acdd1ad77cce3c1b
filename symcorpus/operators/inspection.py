"""Inspection of source files: every rule of tracks and files in one ordered pass, and the verdict on each source."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import KEY, pair_notes

TRACK = ["source_id", "instrument_index"]
WHEEL = 8192


class Rules(NamedTuple):
    """Settings of the inspection."""

    pitch_low: int = 21
    pitch_high: int = 108
    least_notes: int = 8
    no_drums: bool = True
    semitones: int = 6
    explicit_range: bool = True
    tempo_tolerance: float = 0.001
    meter: tuple[int, int] = (4, 4)
    meter_may_miss: bool = True


class Inspection(NamedTuple):
    """tracks: a row a track with its counts and issues; sources: a row a file with its verdict."""

    tracks: DataFrame
    sources: DataFrame


def _told(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of broken rules in the order of the rules."""
    texts = [F.when(F.coalesce(bad, F.lit(False)), F.lit(text) if isinstance(text, str) else text) for bad, text in rules]
    return F.filter(F.array(*texts), lambda x: x.isNotNull())


def scan_range(setup: Column) -> Column:
    """struct(bend_range, issue) of a track's controls, an array of (tick, seq, number, value).

    A fold in the order of tick and seq. 101 and 100 select a parameter and begin an epoch; in
    one of parameter 0, 0 each data entry (6) begins a range, and 38 adds hundredths to the
    epoch's last one. The first broken rule ends the scan; ranges that differ break the last.
    """
    state = "struct<msb:int,lsb:int,open:boolean,ranges:array<double>,issue:string>"
    zero = F.struct(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(False), F.array().cast("array<double>"), F.lit(None).cast("string")).cast(state)

    def step(a: Column, x: Column) -> Column:
        number, value = x["number"], x["value"].cast("int")
        selected = F.coalesce((a["msb"] == 0) & (a["lsb"] == 0), F.lit(False))
        issue = (
            F.when(x["tick"] < 0, "range controls out of time")
            .when(~number.isin(6, 38, 100, 101), "unsupported controller")
            .when((number == 6) & ~selected, "data entry without parameter")
            .when((number == 6) & (value <= 0), "range not positive")
            .when((number == 38) & ~(selected & a["open"]), "fine range without a coarse one")
        )
        n = F.size(a["ranges"])
        last = F.floor(F.get(a["ranges"], n - 1)) + value / 100.0
        ranges = F.when(number == 6, F.concat(a["ranges"], F.array(value.cast("double")))).when(number == 38, F.concat(F.slice(a["ranges"], 1, F.greatest(n - 1, F.lit(0))), F.array(last))).otherwise(a["ranges"])
        opened = F.when(number == 6, True).when(number.isin(100, 101), False).otherwise(a["open"])
        new = F.struct(F.when(number == 101, value).otherwise(a["msb"]), F.when(number == 100, value).otherwise(a["lsb"]), opened, F.when(issue.isNull(), ranges).otherwise(a["ranges"]), issue).cast(state)
        return F.when(a["issue"].isNotNull(), a).otherwise(new)

    def finish(a: Column) -> Column:
        first = F.get(a["ranges"], F.lit(0))
        other = F.exists(a["ranges"], lambda r: F.abs(r - first) > 1e-9)
        issue = F.coalesce(a["issue"], F.when(F.size(a["ranges"]) == 0, "selection without a range").when(other, "range changes"))
        return F.struct(F.when(issue.isNull(), first).alias("bend_range"), issue.alias("issue"))

    none = F.struct(F.lit(None).cast("double").alias("bend_range"), F.lit(None).cast("string").alias("issue"))
    return F.when(F.size(setup) == 0, none).otherwise(F.aggregate(F.array_sort(setup), zero, step, finish))


def bend_ranges(controls: DataFrame, *keys: str) -> DataFrame:
    """(keys, bend_range, issue) of controls (keys, tick, seq, number, value)."""
    held = F.collect_list(F.struct("tick", "seq", "number", "value"))
    return controls.groupBy(*keys).agg(scan_range(held).alias("scan")).select(*keys, "scan.bend_range", "scan.issue")


def inspect_tracks(notes: DataFrame, bends: DataFrame, controls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row a track: raw and distinct notes, pitches, wheel counts, the wheel's range, and issues in the order of the rules.

    Notes, wheel and controls become one table of tagged rows, which is grouped once by track.
    A track's controls and distinct notes are held by its task, as a file holds them.
    """
    rows = notes.select(*TRACK, F.lit("note").alias("kind"), F.col("onset_tick").alias("tick"), "end_tick", "pitch", "velocity", "is_drum")
    rows = rows.unionByName(bends.select(*TRACK, F.lit("bend").alias("kind"), "seq", "tick", "value"), True)
    rows = rows.unionByName(controls.select(*TRACK, F.lit("control").alias("kind"), "seq", "tick", "number", "value"), True)
    note, bend, control = (F.col("kind") == k for k in ("note", "bend", "control"))
    moves = bend & (F.col("value") != 0)
    by = rows.groupBy(*TRACK).agg(
        F.coalesce(F.bool_or(F.when(note, F.col("is_drum"))), F.lit(False)).alias("is_drum"),
        F.count_if(note).alias("raw_notes"),
        F.size(F.collect_set(F.when(note, F.struct("tick", "end_tick", "pitch", "velocity")))).cast("long").alias("n_notes"),
        F.min(F.when(note, F.col("pitch"))).alias("min_pitch"),
        F.max(F.when(note, F.col("pitch"))).alias("max_pitch"),
        F.count_if(bend).alias("n_bends"),
        F.count_if(moves).alias("n_expressive"),
        F.min(F.when(moves, F.col("tick"))).alias("first_bend"),
        F.max(F.when(moves, F.abs("value"))).alias("reach"),
        F.count_if(bend & (~F.col("value").between(-WHEEL, WHEEL - 1) | (F.col("tick") < 0))).alias("bad_bends"),
        F.count_if(note & ((F.col("tick") < 0) | (F.col("end_tick") <= F.col("tick")))).alias("bad_notes"),
        F.min(F.when(control & (F.col("number") == 6), F.col("tick"))).alias("first_entry"),
        scan_range(F.collect_list(F.when(control, F.struct("tick", "seq", "number", "value")))).alias("scan"),
    )
    by = by.withColumn("collapsed", F.col("raw_notes") - F.col("n_notes")).withColumn("bend_range", F.col("scan.bend_range"))
    live, ranged = F.col("n_expressive") > 0, F.col("bend_range").isNotNull()
    told = _told(
        (F.lit(rules.no_drums) & F.col("is_drum"), "drum track"),
        (F.col("n_notes") < rules.least_notes, "too few notes"),
        ((F.col("min_pitch") < rules.pitch_low) | (F.col("max_pitch") > rules.pitch_high), "pitch out of range"),
        (F.col("scan.issue").isNotNull(), F.col("scan.issue")),
        (live & F.lit(rules.explicit_range) & ~ranged, "wheel moves without a range"),
        (live & ranged & (F.col("first_entry") > F.col("first_bend")), "range set after the wheel moves"),
        (live & ranged & (F.col("reach") * F.col("bend_range") / WHEEL > rules.semitones + 1e-9), f"wheel beyond {rules.semitones} semitones"),
        (F.col("bad_bends") > 0, F.concat(F.col("bad_bends").cast("string"), F.lit(" invalid wheel events"))),
        (F.col("bad_notes") > 0, F.concat(F.col("bad_notes").cast("string"), F.lit(" invalid notes"))),
    )
    columns = ["is_drum", "raw_notes", "n_notes", "collapsed", "min_pitch", "max_pitch", "n_bends", "n_expressive", "bend_range"]
    return by.withColumn("issues", told).select(*TRACK, *columns, "issues", (F.size("issues") == 0).alias("compatible"), F.array_join("issues", ", ").alias("reason"))


def lifetime_issues(messages: DataFrame) -> DataFrame:
    """(source_id, issue): the first of overlapping notes, a note-on without an end, and unisons of differing ends, by track.

    Messages are paired once; a note-on overlaps if the one before it on its key still sounds
    and began elsewhere or as loud as another.
    """
    order = Window.partitionBy(*KEY).orderBy("on_ord")
    unison = Window.partitionBy(*KEY, "onset_tick", "velocity")
    before = lambda c: F.lag(c).over(order)
    sounds = F.coalesce(before("off_ord"), F.lit(2**62)) > F.col("on_ord")
    overlaps = before("on_ord").isNotNull() & sounds & ((before("onset_tick") != F.col("onset_tick")) | (before("velocity") != F.col("velocity")))
    pairs = pair_notes(messages).withColumn("overlaps", overlaps).withColumn("apart", F.min("end_tick").over(unison) != F.max("end_tick").over(unison))
    rank = F.when(F.col("overlaps"), 0).when(F.col("end_tick").isNull(), 1).when(F.col("apart"), 2)
    first = pairs.select("source_id", "track", rank.alias("rank")).filter("rank IS NOT NULL").groupBy("source_id").agg(F.min(F.struct("track", "rank")).alias("x"))
    return first.select("source_id", F.when(F.col("x.rank") == 1, "note-on without an end").otherwise("notes overlap").alias("issue"))


def tempo_of(tempi: Column, tolerance: float) -> Column:
    """struct(bpm, n, issue) of a file's tempi, an array of (seq, bpm); 120 where there is none."""
    ordered = F.transform(F.array_sort(tempi), lambda x: x["bpm"])
    first, none = F.get(ordered, F.lit(0)), F.size(tempi) == 0
    odd = (first <= 0) | F.exists(ordered, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    issue = F.when(none, None).when(odd, "tempo not a positive number").when(F.exists(ordered, lambda x: F.abs(x - first) > tolerance), "tempo changes")
    return F.struct(F.when(none, F.lit(120.0)).when(~odd, first).alias("bpm"), F.size(tempi).alias("n"), issue.alias("issue"))


def meter_of(meters: Column, rules: Rules) -> Column:
    """struct(meters, issue) of a file's meters, an array of (seq, numerator, denominator); unsupported ones by number."""
    text = lambda x: F.concat_ws("/", x["numerator"], x["denominator"])
    pairs = F.transform(meters, lambda x: F.struct(x["numerator"].alias("numerator"), x["denominator"].alias("denominator")))
    odd = F.array_sort(F.array_distinct(F.filter(pairs, lambda x: (x["numerator"] != rules.meter[0]) | (x["denominator"] != rules.meter[1]))))
    wanted = f"{rules.meter[0]}/{rules.meter[1]}"
    said = F.when(F.size(meters) > 0, F.array_join(F.transform(F.array_sort(meters), text), ", ")).when(F.lit(rules.meter_may_miss), f"{wanted} (implicit)").otherwise("")
    issue = F.when(F.size(odd) > 0, F.concat(F.lit("unsupported meters: "), F.array_join(F.transform(odd, text), ", "))).when((F.size(meters) == 0) & F.lit(not rules.meter_may_miss), "meter is missing")
    return F.struct(said.alias("meters"), issue.alias("issue"))


def inspect(notes: DataFrame, bends: DataFrame, controls: DataFrame, messages: DataFrame, tempi: DataFrame, meters: DataFrame, headers: DataFrame, meta: DataFrame, rules: Rules = Rules(), index: int | None = None, stage=lambda df: df) -> Inspection:
    """Every rule over every file; a file that breaks one stays as a discarded record and stops nothing.

    A file's header, global events outside track 0 and lifetimes of notes come first; the first
    of these is its only issue, for such a file isn't read further. Others have the issues of
    tempo, meter and the choice of a track, in this order. The track of most distinct notes is
    chosen among those without issues, the lowest index of equals, or the one of `index`.
    Tempi, meters, headers, misplaced events, lifetimes and tracks become one table of tagged
    rows, which is grouped once by source. A file is one that has a header.
    """
    tracks = stage(inspect_tracks(notes, bends, controls, rules))
    tag = lambda df, kind, *columns: df.select("source_id", F.struct(*columns).alias(kind))
    misplaced = meta.filter("track > 0 AND kind IN ('set_tempo', 'time_signature')")
    parts = [
        tag(headers, "header", F.col("file_type").cast("int").alias("file_type"), F.col("ppq").cast("int").alias("ppq"), F.col("n_tracks").cast("long").alias("n_tracks")),
        tag(misplaced, "misplaced", "kind"),
        tag(stage(lifetime_issues(messages)), "lifetime", "issue"),
        tag(tempi, "tempo", "seq", F.col("bpm").cast("double").alias("bpm")),
        tag(meters, "meter", "seq", "numerator", "denominator"),
        tag(tracks, "track", "instrument_index", "n_notes", "compatible", "reason"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, True)
    # parts may come dealt by source already, in ways that differ; all of them are dealt anew, once
    by = rows.repartition("source_id").groupBy("source_id").agg(
        F.max("header").alias("header"), F.array_join(F.array_sort(F.collect_set("misplaced.kind")), ", ").alias("misplaced"), F.max("lifetime.issue").alias("lifetime"),
        tempo_of(F.collect_list("tempo"), rules.tempo_tolerance).alias("tempo"), meter_of(F.collect_list("meter"), rules).alias("meter"), F.array_sort(F.collect_list("track")).alias("tracks"),
    ).filter("header IS NOT NULL")
    unread = F.coalesce(
        F.when(F.col("header.file_type") == 2, "asynchronous file type 2").when(F.col("header.ppq") <= 0, "ticks per beat not positive")
        .when((F.col("header.file_type") == 0) & (F.col("header.n_tracks") != 1), "file type 0 with more than one track")
        .when((F.col("header.file_type") == 1) & (F.col("misplaced") != ""), F.concat(F.lit("global events outside track 0: "), "misplaced")),
        "lifetime",
    )
    good = F.filter("tracks", lambda x: x["compatible"])
    best = F.get(F.array_sort(F.transform(good, lambda x: F.struct((-x["n_notes"]).alias("n"), x["instrument_index"].alias("instrument_index")))), F.lit(0))["instrument_index"]
    every = F.array_join(F.transform("tracks", lambda x: F.concat(F.lit("instrument "), x["instrument_index"].cast("string"), F.lit(": "), x["reason"])), "; ")
    unchosen = F.when(F.size("tracks") == 0, "no tracks").when(F.size(good) == 0, F.concat(F.lit("no valid track ("), every, F.lit(")")))
    if index is not None:
        own = F.get(F.filter("tracks", lambda x: x["instrument_index"] == index), F.lit(0))
        best = F.when(own["compatible"], F.lit(index))
        unchosen = F.when(own.isNull(), f"track {index} asked, which the file does not have").when(~own["compatible"], F.concat(F.lit(f"track {index} is invalid: "), own["reason"]))
    issues = F.when(unread.isNotNull(), F.array(unread)).otherwise(F.filter(F.array("tempo.issue", "meter.issue", unchosen), lambda x: x.isNotNull()))
    read = lambda c: F.when(F.col("unread").isNull(), c)
    told = by.withColumn("unread", unread).withColumn("best", best).withColumn("issues", issues).withColumn("compatible", F.size("issues") == 0)
    sources = told.select(
        "source_id", "compatible", F.when(F.col("compatible"), F.col("best")).alias("instrument_index"), read(F.col("tempo.bpm")).alias("tempo_bpm"), read(F.col("tempo.n")).alias("n_tempi"),
        read(F.col("meter.meters")).alias("meters"), F.when(F.col("unread").isNull(), F.size("tracks")).otherwise(0).alias("n_tracks"), "issues", F.when(~F.col("compatible"), F.array_join("issues", "; ")).alias("reason"),
    )
    return Inspection(tracks, sources)


def merged_records(sources: DataFrame) -> DataFrame:
    """Accepted and discarded files as one table of records: accepted ones have their track and tempo, discarded ones their reason."""
    good = sources.filter("compatible").select("source_id", F.lit("accepted").alias("status"), "instrument_index", "tempo_bpm")
    bad = sources.filter("NOT compatible").select("source_id", F.lit("discarded").alias("status"), "reason")
    return good.unionByName(bad, allowMissingColumns=True)


def report_totals(sources: DataFrame) -> DataFrame:
    """Numbers of inspected, compatible and discarded files."""
    return sources.agg(F.count("*").alias("inspected"), F.count_if("compatible").alias("compatible"), F.count_if(~F.col("compatible")).alias("discarded"))


def top_reasons(rejects: DataFrame, k: int = 3, chars: int = 180) -> DataFrame:
    """The k most common reasons, their blanks single, cut at `chars` characters; equals by text."""
    text = F.substring(F.regexp_replace(F.trim("reason"), r"\s+", " "), 1, chars)
    return rejects.filter("reason IS NOT NULL AND reason <> ''").groupBy(text.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def track_rules(tracks: DataFrame, rules: Rules) -> DataFrame:
    """By source: tracks of drums, of too few notes, and with a pitch outside the range."""
    outside = (F.col("min_pitch") < rules.pitch_low) | (F.col("max_pitch") > rules.pitch_high)
    return tracks.groupBy("source_id").agg(F.count_if("is_drum").alias("drums"), F.count_if(F.col("n_notes") < rules.least_notes).alias("short"), F.count_if(outside).alias("outside"))
