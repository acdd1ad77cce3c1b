"""The first stage: tracks chosen, notes and wheel normalised, phrases cut, labels carried, variants made."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .events import NOTE, PHRASE, in_ranges, last_per_tick, phrase_window, sliced_bends
from .inspection import Inspection
from .tokens import TECHNIQUES

FRAGMENT = ["source_id", "phrase_index", "semitones"]


class Limits(NamedTuple):
    """Settings of the stage; phrases of fewer notes and variants outside the pitches go."""

    least_notes: int = 8
    pitch_low: int = 38
    pitch_high: int = 90
    low: int = -6
    high: int = 6
    cell: int | None = None
    augmented: tuple[str, ...] = ("train",)


def notes_of_tracks(notes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct notes of the chosen track of each source, under the least seq of equal ones."""
    own = chosen.filter("instrument_index IS NOT NULL").select("source_id", "instrument_index")
    return notes.join(own, ["source_id", "instrument_index"]).groupBy("source_id", "instrument_index", *NOTE).agg(F.min("seq").alias("seq"))


def scaled_wheel(bends: DataFrame, ranges: DataFrame) -> DataFrame:
    """(source_id, tick, value, issue): the last wheel value of each tick at six semitones.

    ranges holds (source_id, bend_range). A curve of zeros alone says nothing and goes. Where a
    curve that moves has no positive range, or goes beyond six semitones, issue says so.
    """
    live = F.max(F.when(F.col("value") != 0, 1).otherwise(0)).over(Window.partitionBy("source_id")) == 1
    rows = last_per_tick(bends).withColumn("live", live).filter("live").join(ranges.select("source_id", "bend_range"), "source_id", "left")
    far = F.abs(scalars.bend_to_semitones(F.col("value"), F.col("bend_range"))) > 6 + 1e-9
    issue = F.when(F.coalesce(F.col("bend_range") <= 0, F.lit(True)), "bends without a range").when(far, "bend beyond six semitones")
    value = F.when(issue.isNull(), scalars.scale_bend(F.col("value"), F.col("bend_range")))
    return rows.select("source_id", "tick", value.alias("value"), issue.alias("issue"))


def normalized(notes: DataFrame, bends: DataFrame, ranges: DataFrame, cell: int | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes from tick 0 on, their wheel, and (source_id, reason) of sources that must go.

    notes are those of chosen tracks. The wheel value at the first onset is carried to tick 0.
    With a cell, onsets and lengths go to its grid; two notes that then are one are a reason.
    stage is called on what several steps read.
    """
    lead = notes.groupBy("source_id").agg(F.min("onset_tick").alias("lead"))
    moved = notes.join(lead, "source_id").withColumn("source_tick", F.col("onset_tick")).withColumn("source_end", F.col("end_tick"))
    moved = moved.withColumn("onset_tick", F.col("onset_tick") - F.col("lead")).withColumn("end_tick", F.col("end_tick") - F.col("lead")).drop("lead")
    if cell:
        steps = lambda x: F.floor(x / cell + F.lit(0.5)).cast("long")
        onset, length = steps(F.col("onset_tick")) * cell, F.greatest(steps(F.col("end_tick") - F.col("onset_tick")), F.lit(1)) * cell
        moved = moved.withColumn("length", length).withColumn("onset_tick", onset).withColumn("end_tick", F.col("onset_tick") + F.col("length")).drop("length")
    clash = moved.groupBy("source_id", *NOTE).agg(F.count("*").alias("n")).filter("n > 1").select("source_id", F.lit("notes meet on the grid").alias("reason"))
    wheel = stage(scaled_wheel(bends, ranges))
    bad = wheel.filter("issue IS NOT NULL").join(lead, "source_id", "left_semi").groupBy("source_id").agg(F.min("issue").alias("reason"))
    gone = stage(bad.union(clash).groupBy("source_id").agg(F.min("reason").alias("reason")))
    at = wheel.filter("issue IS NULL").join(lead, "source_id").withColumn("tick", F.col("tick") - F.col("lead"))
    # of the values up to the first onset the last one counts, and a zero there says nothing
    place = F.greatest("tick", F.lit(0))
    curve = at.groupBy("source_id", place.alias("tick")).agg(F.max_by("value", at["tick"]).alias("value"), F.max(at["tick"]).alias("own")).filter("value <> 0 OR own >= 0").drop("own")
    keep = lambda df: df.join(gone, "source_id", "left_anti")
    return keep(moved), keep(curve), gone


def phrases_of(notes: DataFrame, least: int, width: int = PHRASE) -> DataFrame:
    """Notes by phrase with note_index in the order of onset, pitch, end and velocity; phrases of fewer than `least` notes go."""
    cut = phrase_window(notes, width)
    order = Window.partitionBy("source_id", "phrase_index").orderBy("onset_tick", "pitch", "end_tick", "velocity", "seq")
    counted = cut.withColumn("note_index", F.row_number().over(order) - 1).withColumn("num_notes", F.count("*").over(Window.partitionBy("source_id", "phrase_index")))
    return counted.filter(F.col("num_notes") >= least)


def coverage_label(sources: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(source_id, coverage): COMPLETE where a sidecar exists, even an empty one; else UNLABELED, which is no negative example."""
    held = sidecars.select("source_id").distinct().withColumn("held", F.lit(True))
    return sources.select("source_id").distinct().join(held, "source_id", "left").select("source_id", F.when(F.col("held"), "COMPLETE").otherwise("UNLABELED").alias("coverage"))


def phrase_labels(phrases: DataFrame, annotations: DataFrame, ranges: DataFrame, coverage: DataFrame, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(source_id, phrase_index, note_index, type, target_pitch) of the notes of labelled sources.

    Annotations meet notes by their place in the source (source_tick, source_end, pitch,
    velocity). Muted notes give PALM_MUTE_ON and OFF where the state changes in note order,
    each phrase beginning unmuted. stage is called on the notes of labelled sources, which
    several steps read.
    """
    known = stage(phrases.join(coverage.filter("coverage = 'COMPLETE'").select("source_id"), "source_id", "left_semi"))
    at = known.withColumn("onset_tick", F.col("source_tick")).withColumn("end_tick", F.col("source_end"))
    own = annotations.select("source_id", *NOTE, "type", "target_pitch").distinct()
    told = at.join(own, ["source_id", *NOTE]).select("source_id", "phrase_index", "note_index", "type", "target_pitch")
    hits = in_ranges(at, ranges).withColumn("hit", F.lit(True))
    order = Window.partitionBy("source_id", "phrase_index").orderBy("note_index")
    before = F.coalesce(F.lag("muted").over(order), F.lit(False))
    state = known.select("source_id", "phrase_index", "note_index", "seq").join(hits, ["source_id", "seq"], "left").withColumn("muted", F.coalesce("hit", F.lit(False)))
    state = state.withColumn("before", before).filter("muted <> before")
    toggles = state.select("source_id", "phrase_index", "note_index", F.when(F.col("muted"), "PALM_MUTE_ON").otherwise("PALM_MUTE_OFF").alias("type"), F.lit(None).cast("int").alias("target_pitch"))
    return told.union(toggles)


def rank_of(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TECHNIQUES)), label)


def fragments(phrases: DataFrame, wheel: DataFrame, labels: DataFrame, splits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row a variant: FRAGMENT, split, track, counts, wheel flags and techniques (type, note_index).

    Augmented splits have every offset, others 0 alone. A variant goes if one of its notes or
    a target of its slides leaves the pitches. bend_range is six where the wheel moves.
    """
    by = phrases.groupBy("source_id", "phrase_index").agg(
        F.first("instrument_index").alias("instrument_index"), F.count("*").alias("num_notes"), F.min("pitch").alias("lo"), F.max("pitch").alias("hi"), F.max("end_tick").alias("last_end"),
    )
    curves = sliced_bends(wheel, by.select("source_id", "phrase_index"))
    moves = F.size(F.filter("events", lambda x: x["value"] != 0))
    curves = curves.select("source_id", "phrase_index", F.size("events").alias("num_bends"), moves.alias("num_expressive"), "synthetic_initial", "synthetic_reset")
    slide = F.col("type").startswith("SLIDE")
    kept = F.transform(F.array_sort(F.collect_list(F.struct("note_index", rank_of(F.col("type")).alias("rank"), "type"))), lambda x: F.struct(x["type"].alias("type"), x["note_index"].alias("note_index")))
    told = labels.groupBy("source_id", "phrase_index").agg(kept.alias("techniques"), F.min(F.when(slide, F.col("target_pitch"))).alias("slide_lo"), F.max(F.when(slide, F.col("target_pitch"))).alias("slide_hi"))
    keys = ["source_id", "phrase_index"]
    whole = by.join(curves, keys, "left").join(told, keys, "left").join(splits.select("source_id", "split"), "source_id")
    offset = F.explode(F.when(F.col("split").isin(*limits.augmented), F.sequence(F.lit(limits.low), F.lit(limits.high))).otherwise(F.array(F.lit(0))))
    moved = whole.withColumn("semitones", offset)
    inside = (F.least("lo", "slide_lo") + F.col("semitones") >= limits.pitch_low) & (F.greatest("hi", "slide_hi") + F.col("semitones") <= limits.pitch_high)
    zero, no = lambda c: F.coalesce(c, F.lit(0)).alias(c), lambda c: F.coalesce(c, F.lit(False)).alias(c)
    none = F.array().cast("array<struct<type:string,note_index:int>>")
    return moved.filter(inside).select(
        *FRAGMENT, "split", "instrument_index", "num_notes", zero("num_bends"), zero("num_expressive"), F.when(F.col("num_expressive") > 0, 6).alias("bend_range"),
        no("synthetic_initial"), no("synthetic_reset"), F.coalesce("techniques", none).alias("techniques"), "last_end",
    )


def wheel_of_tracks(bends: DataFrame, found: Inspection) -> tuple[DataFrame, DataFrame]:
    """The wheel of each source's chosen track, and (source_id, bend_range) of that track."""
    own = found.sources.filter("instrument_index IS NOT NULL").select("source_id", "instrument_index")
    return bends.join(own, ["source_id", "instrument_index"]).drop("instrument_index"), found.tracks.join(own, ["source_id", "instrument_index"]).select("source_id", "bend_range")


class Preprocessed(NamedTuple):
    """sources: a row an inspected file, with its track or the reason to discard it; phrases, wheel and labels: what fragments are made of; inspected: the files as the inspection told them, written once."""

    sources: DataFrame
    fragments: DataFrame
    phrases: DataFrame
    wheel: DataFrame
    labels: DataFrame
    inspected: DataFrame


def preprocess(notes: DataFrame, bends: DataFrame, found: Inspection, splits: DataFrame, coverage: DataFrame, annotations: DataFrame, mutes: DataFrame, limits: Limits = Limits(), stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> Preprocessed:
    """The whole stage.

    Tables are those of the operators above; found comes from inspection.inspect, and only
    compatible sources go on. Every inspected source is in the first table once. stage is called
    on tables that several steps read; writing them to a shared folder there keeps plans short.
    """
    found = found._replace(sources=stage(found.sources))
    chosen, splits, coverage = found.sources.select("source_id", "instrument_index", "reason"), stage(splits), stage(coverage)
    wheel, ranges = wheel_of_tracks(bends, found)
    clean, wheel, gone = normalized(stage(notes_of_tracks(notes, chosen)), wheel, ranges, limits.cell, stage)
    wheel, phrases = stage(wheel), stage(phrases_of(clean, limits.least_notes))
    labels = stage(phrase_labels(phrases, annotations, mutes, coverage, stage))
    made = fragments(phrases, wheel, labels, splits, limits).join(coverage, "source_id", "left").fillna("UNLABELED", ["coverage"])
    made = stage(made)
    counts = phrases.groupBy("source_id").agg(F.count_distinct("phrase_index").alias("num_base_fragments"))
    total = made.groupBy("source_id").agg(F.count("*").alias("num_fragments"))
    rows = chosen.join(gone.withColumnRenamed("reason", "later"), "source_id", "left").join(counts, "source_id", "left").join(total, "source_id", "left").fillna(0, ["num_base_fragments", "num_fragments"])
    why = F.coalesce("reason", "later", F.when(F.col("num_base_fragments") == 0, "no phrase of enough notes"), F.when(F.col("num_fragments") == 0, "no variant inside the pitches"))
    sources = rows.join(splits.select("source_id", "split"), "source_id", "left").select("source_id", "split", "instrument_index", why.isNull().alias("compatible"), why.alias("reason"), "num_base_fragments", "num_fragments")
    return Preprocessed(sources, made, phrases, wheel, labels, found.sources)


def label_summary(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(dimension, name, n) of fragments: labels by type, coverage, wheel totals, tonic, mode and method; every given name is there, with 0 too."""
    one = lambda d, name, n: F.struct(F.lit(d).alias("dimension"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    told = F.transform("techniques", lambda x: one("technique", x["type"], F.lit(1)))
    own = [one(d, F.col(d), F.lit(1)) for d in ("coverage", "tonic", "mode", "method")]
    own += [one("bends", F.lit("total"), F.col("num_bends")), one("bends", F.lit("sequences"), (F.col("num_bends") > 0).cast("int"))]
    counts = rows.select(F.inline(F.concat(told, F.array(*own)))).groupBy("dimension", "name").agg(F.sum("n").alias("n"))
    listed = rows.sparkSession.createDataFrame([(d, n) for d, some in names.items() for n in some], "dimension string, name string")
    return F.broadcast(listed).join(counts, ["dimension", "name"], "left").fillna(0, ["n"])


def run_totals(rows: DataFrame) -> DataFrame:
    """Samples, notes, wheel values and labels by split."""
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return rows.groupBy("split").agg(F.count("*").alias("samples"), total("num_notes", "notes"), total("num_bends", "bends"), total(F.size("techniques"), "techniques"))
