"""Event streams: pairing, profiles, rules, windows, and states over ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "track", "pitch"]
NOTE = ["onset_tick", "end_tick", "pitch", "velocity"]
PHRASE = 7680


def absolute_ticks(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tick", F.sum("delta").over(Window.partitionBy("source_id", "track").orderBy("ord")))


def pair_notes(messages: DataFrame) -> DataFrame:
    """Note-ons with the first free note-off of their key, in order; end_tick is null without one.

    With S the running sum of ons less offs, an off finds nothing active exactly where S goes
    below zero and below its running minimum; the others match ons by rank.
    """
    order = Window.partitionBy(*KEY).orderBy("ord")
    signed = absolute_ticks(messages).withColumn("s", F.sum(F.when(F.col("on_flag") == 1, 1).otherwise(-1)).over(order))
    low = F.least(F.lit(0), F.coalesce(F.min("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = signed.withColumn("low", low).filter("on_flag = 1 OR s >= low")
    ranked = used.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY, "on_flag").orderBy("ord")))
    # the on and the off of one rank meet in the partition where they were ranked
    of = lambda flag, c, name: F.max(F.when(F.col("on_flag") == flag, F.col(c))).alias(name)
    pairs = ranked.groupBy(*KEY, "rn").agg(of(1, "ord", "on_ord"), of(1, "tick", "onset_tick"), of(1, "velocity", "velocity"), of(0, "ord", "off_ord"), of(0, "tick", "end_tick"))
    return pairs.filter("on_ord IS NOT NULL").select(*KEY, "on_ord", "onset_tick", "velocity", "off_ord", "end_tick")


def overlap_violations(messages: DataFrame) -> DataFrame:
    """Note-ons while another of their key is active, unless it began at once and as loud."""
    order = Window.partitionBy(*KEY).orderBy("on_ord")
    active = F.coalesce(F.lag("off_ord").over(order), F.when(F.row_number().over(order) > 1, F.lit(2**62)), F.lit(-1)) > F.col("on_ord")
    other = (F.lag("onset_tick").over(order) != F.col("onset_tick")) | (F.lag("velocity").over(order) != F.col("velocity"))
    return pair_notes(messages).withColumn("bad", active & other).filter("bad").select(*KEY, "on_ord", "onset_tick")


def duplicate_end_mismatch(pairs: DataFrame) -> DataFrame:
    same = pairs.filter("end_tick IS NOT NULL").groupBy(*KEY, "onset_tick", "velocity")
    return same.agg(F.count("*").alias("n"), F.count_distinct("end_tick").alias("n_ends")).filter("n > 1 AND n_ends > 1")


def dedupe_counts(notes: DataFrame) -> DataFrame:
    once = notes.groupBy("source_id", "instrument_index", *NOTE).agg(F.count("*").alias("n"))
    return once.groupBy("source_id", "instrument_index").agg(F.sum("n").alias("raw"), F.count("*").alias("unique_notes"), (F.sum("n") - F.count("*")).alias("collapsed"))


def constant_tempo(tempi: DataFrame, tolerance: float, sources: DataFrame | None = None, default: float = 120.0) -> DataFrame:
    """First tempo, number of events, and whether any is off it or not a positive number; given sources without events have the default."""
    if sources is not None:
        found = constant_tempo(tempi, tolerance)
        return sources.select("source_id").distinct().join(found, "source_id", "left").fillna(default, ["first_bpm"]).fillna(0, ["n_events"]).fillna(False, ["varies"])
    first = tempi.groupBy("source_id").agg(F.min_by("bpm", "seq").alias("first_bpm"))
    off = (F.abs(F.col("bpm") - F.col("first_bpm")) > tolerance) | (F.col("bpm") <= 0) | F.isnan("bpm")
    return tempi.join(first, "source_id").groupBy("source_id", "first_bpm").agg(F.count("*").alias("n_events"), F.bool_or(off).alias("varies"))


def meter_check(meters: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Distinct meters other than 4/4 by number, and all meters; given sources without one have it implied."""
    text = lambda x: F.concat_ws("/", x["numerator"], x["denominator"])
    pair = F.struct("numerator", "denominator")
    said = lambda pairs: F.array_join(F.transform(F.array_sort(pairs), text), ", ")
    odd = F.when(~((F.col("numerator") == 4) & (F.col("denominator") == 4)), pair)
    by = meters.groupBy("source_id").agg(said(F.collect_set(odd)).alias("unsupported"), said(F.collect_set(pair)).alias("meters"))
    if sources is None:
        return by
    return sources.select("source_id").distinct().join(by, "source_id", "left").fillna("", ["unsupported"]).fillna("4/4 (implicit)", ["meters"])


def invalid_events(notes: DataFrame, bends: DataFrame) -> DataFrame:
    bad_notes = notes.groupBy("source_id").agg(F.count_if((F.col("onset_tick") < 0) | (F.col("end_tick") <= F.col("onset_tick"))).alias("bad_notes"))
    bad_bends = bends.groupBy("source_id").agg(F.count_if(~F.col("value").between(-8192, 8191) | (F.col("tick") < 0)).alias("bad_bends"))
    return bad_notes.join(bad_bends, "source_id", "full_outer").fillna(0)


def last_per_tick(bends: DataFrame) -> DataFrame:
    return bends.groupBy("source_id", "tick").agg(F.max_by("value", "seq").alias("value"))


def asof_state(points: DataFrame, bends: DataFrame) -> DataFrame:
    """Points (source_id, tick, id) with the wheel value at or before their tick, 0 without one."""
    state = last_per_tick(bends).select("source_id", "tick", F.lit(0).alias("side"), "value", F.lit(None).cast("long").alias("id"))
    asked = points.select("source_id", "tick", F.lit(1).alias("side"), F.lit(None).cast("int").alias("value"), "id")
    order = Window.partitionBy("source_id").orderBy("tick", "side").rowsBetween(Window.unboundedPreceding, 0)
    return state.union(asked).withColumn("state", F.coalesce(F.last("value", True).over(order), F.lit(0))).filter("side = 1").select("source_id", "id", "tick", "state")


def strip_lead_in(notes: DataFrame) -> DataFrame:
    first = notes.groupBy("source_id").agg(F.min("onset_tick").alias("lead"))
    return notes.join(first, "source_id").select("source_id", "seq", (F.col("onset_tick") - F.col("lead")).alias("onset_tick"), (F.col("end_tick") - F.col("lead")).alias("end_tick"))


def quantize(notes: DataFrame, step: int) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / step + F.lit(0.5)).cast("long")
    onset = cell("onset_tick")
    length = F.greatest(F.floor((F.col("end_tick") - F.col("onset_tick")) / step + F.lit(0.5)).cast("long"), F.lit(1))
    return notes.select("source_id", "instrument_index", "seq", "pitch", "velocity", (onset * step).alias("onset_tick"), ((onset + length) * step).alias("end_tick"))


def collisions(quantized: DataFrame) -> DataFrame:
    return quantized.groupBy("source_id", "instrument_index", *NOTE).agg(F.count("*").alias("n")).filter("n > 1").select("source_id").distinct()


def phrase_window(notes: DataFrame, width: int = PHRASE) -> DataFrame:
    """Notes by half-open windows of their onset, ends cut at the window's; ticks are relative to it."""
    index = F.floor(F.col("onset_tick") / width).cast("long")
    end = F.least(F.col("end_tick"), (F.col("phrase_index") + 1) * width)
    cut = notes.withColumn("phrase_index", index).withColumn("end_tick", end).filter("end_tick > onset_tick")
    base = F.col("phrase_index") * width
    return cut.withColumn("onset_tick", F.col("onset_tick") - base).withColumn("end_tick", F.col("end_tick") - base)


def phrase_counts(notes: DataFrame, width: int = PHRASE, durations: DataFrame | None = None, partial: bool = True) -> DataFrame:
    """(source_id, n_phrases): windows that a source with notes fills, a rest of one counted whole if partial.

    durations is (source_id, duration), structural ends in ticks: the later of it and the last end of a note
    counts, so closing rests are phrases too. A rest of up to 1e-9 of a window is none. A duration that is
    null, negative or not finite says nothing.
    """
    ends = notes.groupBy("source_id").agg(F.max("end_tick").cast("double").alias("until"))
    if durations is not None:
        told = durations.groupBy("source_id").agg(F.max(F.when((F.col("duration") >= 0) & (F.col("duration") < float("inf")), F.col("duration").cast("double"))).alias("told"))
        ends = ends.join(told, "source_id", "left").withColumn("until", F.greatest("until", "told"))
    full = F.floor((F.col("until") + width * 1e-9) / width)
    rest = F.when(F.lit(partial) & (F.col("until") - full * width > width * 1e-9), 1).otherwise(0)
    return ends.select("source_id", (full + rest).cast("long").alias("n_phrases"))


def structural_ends(messages: DataFrame) -> DataFrame:
    """(source_id, duration): the tick of the last message of any track, whatever it says."""
    return messages.groupBy("source_id", "track").agg(F.sum("delta").alias("ticks")).groupBy("source_id").agg(F.max("ticks").alias("duration"))


def counted_phrases(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of phrases that their source's count holds; notes behind it are dropped, and so are sources without a count."""
    held = phrases.join(counts.select("source_id", "n_phrases"), "source_id")
    return held.filter(F.col("phrase_index").between(0, F.col("n_phrases") - 1)).drop("n_phrases")


def full_phrases(phrases: DataFrame, least: int) -> DataFrame:
    """(source_id, phrase_index, num_notes) of phrases of `least` notes or more; indexes keep their gaps."""
    return phrases.groupBy("source_id", "phrase_index").agg(F.count("*").alias("num_notes")).filter(F.col("num_notes") >= least)


def early_bends(controls: DataFrame, bends: DataFrame) -> DataFrame:
    """(source_id, first_bend, first_range, early): does a wheel move before its range is set."""
    bend = bends.filter("value <> 0").groupBy("source_id").agg(F.min("tick").alias("first_bend"))
    rows = bend.join(controls.filter("number = 6").groupBy("source_id").agg(F.min("tick").alias("first_range")), "source_id")
    return rows.withColumn("early", F.col("first_bend") < F.col("first_range"))


def durations(messages: DataFrame) -> DataFrame:
    """(source_id, track, duration) in ticks; a last message of one tick is an exporter's end mark and does not count."""
    last = messages.groupBy("source_id", "track").agg(F.sum("delta").alias("whole"), F.max_by("delta", "ord").alias("tail"))
    return last.select("source_id", "track", (F.col("whole") - F.when(F.col("tail") <= 1, F.col("tail")).otherwise(0)).alias("duration"))


def sliced_bends(wheel: DataFrame, windows: DataFrame, width: int = PHRASE) -> DataFrame:
    """(source_id, phrase_index, events, synthetic_initial, synthetic_reset) of windows whose wheel moves.

    wheel holds one value a tick. events are (tick, value, synthetic), ticks relative to the
    window: its own values, before them the state carried in where that is not zero and no
    value is at the start, and after them a reset where the state at the end is not zero.
    Values and starts of windows are ordered once, by source; all else follows in its partition.
    """
    starts = windows.select("source_id", (F.col("phrase_index") * width).alias("tick"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("value"))
    rows = starts.unionByName(wheel.select("source_id", "tick", F.lit(1).alias("kind"), F.col("value").cast("int").alias("value")))
    before = Window.partitionBy("source_id").orderBy("tick", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("state", F.coalesce(F.last("value", True).over(before), F.lit(0))).withColumn("phrase_index", F.floor(F.col("tick") / width).cast("long"))
    own = F.array_sort(F.collect_list(F.struct((F.col("tick") - F.col("phrase_index") * width).alias("tick"), "kind", "value", "state")))
    by = rows.groupBy("source_id", "phrase_index").agg(own.alias("x")).filter(F.exists("x", lambda x: x["kind"] == 0))
    carried = F.get("x", F.lit(0))["state"]
    event = lambda tick, value, made: F.struct(tick.cast("long").alias("tick"), value.cast("int").alias("value"), F.lit(made).alias("synthetic"))
    by = by.withColumn("carried", carried).withColumn("own", F.transform(F.filter("x", lambda x: x["kind"] == 1), lambda x: event(x["tick"], x["value"], False)))
    first, last = F.get("own", F.lit(0)), F.get("own", F.size("own") - 1)
    initial = (F.col("carried") != 0) & ~F.coalesce(first["tick"] == 0, F.lit(False))
    reset = F.coalesce(last["value"], F.col("carried")) != 0
    none = F.array().cast("array<struct<tick:bigint,value:int,synthetic:boolean>>")
    head = F.when(F.col("synthetic_initial"), F.array(event(F.lit(0), F.col("carried"), True))).otherwise(none)
    tail = F.when(F.col("synthetic_reset"), F.array(event(F.lit(width), F.lit(0), True))).otherwise(none)
    by = by.withColumn("synthetic_initial", initial).withColumn("synthetic_reset", reset).withColumn("events", F.concat(head, "own", tail))
    return by.filter(F.exists("events", lambda x: x["value"] != 0)).select("source_id", "phrase_index", "events", "synthetic_initial", "synthetic_reset")


def slice_bends(bends: DataFrame, width: int = PHRASE) -> DataFrame:
    """The events of sliced_bends, one a row, for every window from a source's first event to its last."""
    events = last_per_tick(bends)
    index = F.floor(F.col("tick") / width).cast("long")
    bounds = events.groupBy("source_id").agg(F.min(index).alias("a"), F.max(index).alias("b"))
    windows = bounds.select("source_id", F.explode(F.sequence("a", "b")).alias("phrase_index"))
    return sliced_bends(events, windows, width).select("source_id", "phrase_index", F.inline("events"))


def transposed(phrases: DataFrame, low: int, high: int, pitch_low: int, pitch_high: int) -> DataFrame:
    """Phrases (source_id, phrase_index) moved by each offset; a variant goes if any note leaves the range."""
    bounds = phrases.groupBy("source_id", "phrase_index").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"), F.count("*").alias("num_notes"))
    moved = bounds.withColumn("semitones", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return moved.filter((F.col("lo") + F.col("semitones") >= pitch_low) & (F.col("hi") + F.col("semitones") <= pitch_high)).select("source_id", "phrase_index", "semitones", "num_notes")


def attach_annotations(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    types = annotations.groupBy("source_id", *NOTE).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return notes.select("source_id", "seq", *NOTE).join(types, ["source_id", *NOTE], "left").fillna("", ["types"])


def in_ranges(notes: DataFrame, ranges: DataFrame, cell: int = 1440) -> DataFrame:
    """(source_id, seq) of notes whose onset lies in a range of their source, each once; ranges go to each cell of ticks they touch."""
    cells = F.explode(F.sequence(F.floor(F.col("start_tick") / cell), F.floor((F.col("end_tick") - 1) / cell)))
    dealt = ranges.select("source_id", "start_tick", "end_tick", cells.alias("cell"))
    asked = notes.select("source_id", "seq", "onset_tick", F.floor(F.col("onset_tick") / cell).alias("cell"))
    return asked.join(dealt, ["source_id", "cell"]).filter("start_tick <= onset_tick AND onset_tick < end_tick").select("source_id", "seq").distinct()


def range_label(notes: DataFrame, ranges: DataFrame, cell: int = 1440) -> DataFrame:
    """Notes with muted: does their onset lie in a range of their source."""
    hits = in_ranges(notes, ranges, cell).withColumn("muted", F.lit(True))
    return notes.select("source_id", "seq", "onset_tick").join(hits, ["source_id", "seq"], "left").select("source_id", "seq", "onset_tick", F.coalesce("muted", F.lit(False)).alias("muted"))


def state_transitions(labelled: DataFrame, width: int = PHRASE) -> DataFrame:
    """ON and OFF where the muted flag changes along a phrase, off at its start."""
    phrase = F.floor(F.col("onset_tick") / width).cast("long")
    order = Window.partitionBy("source_id", "phrase_index").orderBy("onset_tick", "seq")
    changed = F.col("muted") != F.coalesce(F.lag("muted").over(order), F.lit(False))
    return labelled.withColumn("phrase_index", phrase).withColumn("changed", changed).filter("changed").select("source_id", "phrase_index", "seq", F.when(F.col("muted"), "ON").otherwise("OFF").alias("toggle"))


def merge_check(ranges: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("start_tick", "end_tick")
    seen = ranges.withColumn("before", F.lag("end_tick").over(order))
    kind = F.when(F.col("start_tick") < F.col("before"), "overlap").when(F.col("start_tick") == F.col("before"), "adjacent")
    return seen.select("source_id", "start_tick", "end_tick", kind.alias("kind")).filter("kind IS NOT NULL")


def toggle_alternation(toggles: DataFrame) -> DataFrame:
    before = F.lag("toggle").over(Window.partitionBy("sequence_id").orderBy("pos"))
    bad = ((F.col("toggle") == "ON") & (F.coalesce("before", F.lit("OFF")) != "OFF")) | ((F.col("toggle") == "OFF") & (F.coalesce("before", F.lit("OFF")) != "ON"))
    return toggles.withColumn("before", before).filter(bad).select("sequence_id", "pos", "toggle")


def exclusive_labels(annotations: DataFrame) -> DataFrame:
    """Notes whose labels contradict each other or whose slide is out of bounds."""
    is_ = lambda t: F.bool_or(F.col("type") == t)
    step = F.when(F.col("type") == "SLIDE_UP", F.col("target_pitch") - F.col("pitch")).when(F.col("type") == "SLIDE_DOWN", F.col("pitch") - F.col("target_pitch"))
    by = annotations.withColumn("step", step).groupBy("source_id", *NOTE).agg(
        is_("DEAD_NOTE").alias("dead"), is_("VIBRATO").alias("vibrato"), F.count_if(F.col("type").startswith("SLIDE")).alias("slides"), F.coalesce(F.bool_or(~F.col("step").between(1, 24)), F.lit(False)).alias("far"),
    )
    by = by.withColumn("dead_and_more", F.col("dead") & (F.col("vibrato") | (F.col("slides") > 0))).withColumn("many_slides", F.col("slides") > 1)
    return by.filter("dead_and_more OR many_slides OR far").select("source_id", *NOTE, "dead_and_more", "many_slides", F.col("far").alias("slide_out_of_bounds"))


def same_pitch_overlap(notes: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id", "instrument_index", "pitch").orderBy("onset_tick", "end_tick", "velocity", "seq")
    return notes.withColumn("before", F.lag("end_tick").over(order)).filter("onset_tick < before").select("source_id", "instrument_index", "pitch", "seq")


def repeated_identities(notes: DataFrame) -> DataFrame:
    """Notes of a source that are there twice or more, by onset, end, pitch and velocity."""
    return notes.groupBy("source_id", *NOTE).agg(F.count("*").alias("n")).filter("n > 1")


def note_index(notes: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("onset_tick", "pitch", "end_tick", "velocity", "seq")
    return notes.select("source_id", "seq", (F.row_number().over(order) - 1).alias("note_index"))


def pitch_class_profile(notes: DataFrame) -> DataFrame:
    """Weights 1 + min(duration / upper median, 2) / 4 by pitch class."""
    duration = F.greatest(F.col("end_tick") - F.col("onset_tick"), F.lit(0)).cast("double")
    timed = notes.select("source_id", "pitch", "seq", F.greatest(duration, F.lit(1e-9)).alias("duration"))
    order = Window.partitionBy("source_id").orderBy("duration", "seq")
    ranked = timed.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("source_id")))
    typical = ranked.filter("rn = floor(n / 2) + 1").select("source_id", F.col("duration").alias("typical"))
    weight = 1 + 0.25 * F.least(F.col("duration") / F.col("typical"), F.lit(2.0))
    return timed.join(typical, "source_id").groupBy("source_id", (F.col("pitch") % 12).alias("pitch_class")).agg(F.round(F.sum(weight), 6).alias("weight"))


def bass_profile(notes: DataFrame) -> DataFrame:
    lowest = notes.groupBy("source_id", "onset_tick").agg((F.min("pitch") % 12).alias("bass"))
    ends = lowest.groupBy("source_id").agg(F.min_by("bass", "onset_tick").alias("first_bass"), F.max_by("bass", "onset_tick").alias("last_bass"))
    votes = lowest.groupBy("source_id", "bass").agg(F.count("*").alias("votes"))
    return votes.join(ends, "source_id")


def with_zeros(counts: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Counts by name, with a zero for names that do not occur."""
    spark = counts.sparkSession
    return F.broadcast(spark.createDataFrame([(n,) for n in names], f"{column} string")).join(counts, column, "left").fillna(0)


def early_stopping(history: DataFrame, min_delta: float, patience: int) -> DataFrame:
    """The fold of each run in epoch order; a run holds its epochs alone."""
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "validation_loss")))
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("without"), F.lit(None).cast("int").alias("stopped"))

    def step(a: Column, x: Column) -> Column:
        better = a["best"].isNull() | (x["validation_loss"] < a["best"] - min_delta)
        now = F.when(better, 0).otherwise(a["without"] + 1)
        new = F.struct(F.when(better, x["validation_loss"]).otherwise(a["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(a["best_epoch"]).alias("best_epoch"), now.alias("without"), F.when(now >= patience, x["epoch"]).alias("stopped"))
        return F.when(a["stopped"].isNotNull(), a).otherwise(new)

    return history.groupBy("run_id").agg(F.aggregate(ordered, zero, step).alias("f")).select("run_id", F.col("f.best").alias("best_loss"), "f.best_epoch", F.col("f.without").alias("epochs_without"), F.col("f.stopped").alias("stopped_epoch"))
