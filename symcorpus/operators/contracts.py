"""Contracts of fragments, sequences, labels, files and samples: a row for each rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import NOTE
from .rules import broken_rules
from .stages import FRAGMENT, rank_of
from .tokens import MODES, PHRASE, TECHNIQUES, TONICS, families, id_of

SPLITS = ("train", "validation", "test")
COVERAGE = ("COMPLETE", "UNLABELED")


def header_issues(headers: DataFrame, meta: DataFrame) -> DataFrame:
    """(source_id, reason) of sources whose file header or global events break a rule, the first rule that does.

    headers holds (source_id, file_type, ppq, n_tracks), meta (source_id, track, kind).
    """
    kinds = ["set_tempo", "time_signature"]
    strays = meta.filter(F.col("kind").isin(kinds) & (F.col("track") > 0)).groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("strays"))
    rows = headers.join(strays, "source_id", "left")
    reason = (
        F.when(F.col("file_type") == 2, "asynchronous file type 2")
        .when(F.col("ppq") <= 0, "ticks per beat not positive")
        .when((F.col("file_type") == 0) & (F.col("n_tracks") != 1), "file type 0 with more than one track")
        .when((F.col("file_type") == 1) & F.col("strays").isNotNull(), F.concat(F.lit("global events outside track 0: "), F.col("strays")))
    )
    return rows.select("source_id", reason.alias("reason")).filter("reason IS NOT NULL")


def fragments_with_sources(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Fragments with what their compatible source says: known, source_split and source_track."""
    held = sources.filter("compatible").select("source_id", F.col("split").alias("source_split"), F.col("instrument_index").alias("source_track"), F.lit(True).alias("known"))
    return fragments.join(held, "source_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def source_of_fragment(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """(FRAGMENT, known, same_split, same_track): has a fragment a compatible source, and does it agree with it; null where there is none."""
    rows = fragments_with_sources(fragments, sources)
    same = lambda a, b: F.when(F.col("known"), F.col(a).eqNullSafe(F.col(b)))
    return rows.select(*FRAGMENT, "known", same("split", "source_split").alias("same_split"), same("instrument_index", "source_track").alias("same_track"))


#: What a fragment's record must hold; bend_range alone may be null.
FIELDS = (
    "split", "track_number", "instrument_index", "phrase_index", "semitones", "output_file", "num_notes", "num_bends", "num_expressive", "synthetic_initial",
    "synthetic_reset", "output_sha256", "output_size_bytes", "coverage", "techniques", "nominal_duration", "actual_duration", "tonic", "mode",
)


def fragment_issues(fragments: DataFrame, sources: DataFrame, run: str) -> DataFrame:
    """(FRAGMENT, rule) for each rule that a declared fragment breaks; run is the folder that its file must lie in."""
    c = F.col
    folder = F.concat(F.lit(f"{run}/"), c("split"), F.lit("/"))
    moves = c("num_expressive") > 0
    rules: list[tuple[Column, str]] = [
        (~c("known"), "absent or incompatible source"),
        (c("known") & (c("split") != c("source_split")), "split differs from its source"),
        (~c("split").isin(*SPLITS), "unknown split"),
        (c("track_number") != c("instrument_index"), "track and instrument differ"),
        (c("known") & (c("instrument_index") != c("source_track")), "instrument differs from its source"),
        (c("phrase_index") < 0, "phrase index below zero"),
        (c("num_notes") <= 0, "no notes"),
        ((c("num_bends") < 0) | (c("num_expressive") < 0), "bend count below zero"),
        (c("num_expressive") > c("num_bends"), "more expressive bends than bends"),
        (moves & ~c("bend_range").eqNullSafe(F.lit(6)), "bend range is not six"),
        (~moves & c("bend_range").isNotNull(), "bend range without expressive bends"),
        (~c("output_sha256").rlike("^[0-9a-f]{64}$"), "malformed hash"),
        (c("output_size_bytes") <= 0, "empty file"),
        (~c("coverage").isin(*COVERAGE), "unknown coverage"),
        ((c("coverage") == "UNLABELED") & (F.size("techniques") > 0), "labels without coverage"),
        (F.exists("techniques", lambda x: ~x["type"].isin(TECHNIQUES)), "unknown label"),
        (F.exists("techniques", lambda x: (x["note_index"] < 0) | (x["note_index"] >= c("num_notes"))), "label outside the notes"),
        ((c("nominal_duration") <= 0) | (c("actual_duration") <= 0), "duration not positive"),
        (~c("output_file").startswith(f"{run}/") | c("output_file").contains("/../"), "file outside the run"),
        (c("output_file").startswith(f"{run}/") & ~c("output_file").startswith(folder), "file outside the folder of its split"),
        (~F.lower("output_file").rlike(r"\.midi?$"), "no MIDI file"),
        (~c("tonic").isin(*TONICS, "UNKNOWN") | ~c("mode").isin(*MODES, "UNKNOWN"), "unknown tonality"),
        ((c("tonic") == "UNKNOWN") & (c("mode") != "UNKNOWN"), "mode without tonic"),
    ]
    missing = [(c(f).isNull(), f"missing {f}") for f in FIELDS]
    return broken_rules(fragments_with_sources(fragments, sources), rules + missing).select(*FRAGMENT, "rule")


def label_issues(labels: DataFrame, records: DataFrame) -> DataFrame:
    """(key, rule) for label lists (key, at, type, note_index) of records (key, coverage, num_notes); `at` is the place in the list."""
    rows = labels.join(records, "key")
    note, order = Window.partitionBy("key", "note_index"), Window.partitionBy("key").orderBy("at")
    twice = F.count("*").over(Window.partitionBy("key", "type", "note_index")) > 1
    both = lambda a, b: F.array_contains(F.collect_set("type").over(note), a) & F.array_contains(F.collect_set("type").over(note), b)
    place = F.struct("note_index", rank_of(F.col("type")).alias("rank"))
    rules = [
        (~F.col("type").isin(TECHNIQUES), "unknown label"),
        ((F.col("note_index") < 0) | (F.col("note_index") >= F.col("num_notes")), "label outside the notes"),
        (F.col("coverage") == "UNLABELED", "labels without coverage"),
        (F.col("twice"), "label twice"),
        (F.col("disordered"), "labels out of order"),
        (F.col("slides"), "slide up and down"),
        (F.col("mutes"), "mute on and off"),
    ]
    marked = rows.withColumn("twice", twice).withColumn("slides", both("SLIDE_UP", "SLIDE_DOWN")).withColumn("mutes", both("PALM_MUTE_ON", "PALM_MUTE_OFF"))
    marked = marked.withColumn("place", place).withColumn("disordered", F.lag("place").over(order) > F.col("place"))
    return broken_rules(marked, rules).groupBy("key", "rule").agg(F.count("*").alias("n"))


def sequence_issues(sequences: DataFrame, limit: int, keys: list[str] = PHRASE) -> DataFrame:
    """(keys, rule) of wrapped sequences: keys, ids, and what their record declares.

    Declared are length, n_notes, n_bends, n_labels, tonic and mode; each is counted again
    from the ids. Ids are those of the vocabulary of tokens.families.
    """
    size = sum(n for _, n in families())
    width = dict(families())
    inner = F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 2, F.lit(0)))
    within = lambda x, name: x.between(id_of(name), id_of(name, width[name] - 1))
    count = lambda name: F.size(F.filter("ids", lambda x: within(x, name)))
    at = lambda k: F.get("ids", F.lit(k))
    said = lambda names, column: F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int") - 1
    no = lambda x: ~F.coalesce(x, F.lit(False))
    rules = [
        (no(at(0) == id_of("BOS")), "no BOS first"), (no(F.element_at("ids", -1) == id_of("EOS")), "no EOS last"),
        (F.array_contains(inner, id_of("BOS")) | F.array_contains(inner, id_of("EOS")), "BOS or EOS inside"), (F.array_contains("ids", id_of("PAD")), "PAD"),
        (F.exists("ids", lambda x: x.isNull() | (x < 0) | (x >= size)), "id outside the vocabulary"), (F.size("ids") < 5, "too short"), (F.size("ids") > limit, "too long"),
        (no(within(at(1), "Tonic")) | (count("Tonic") != 1), "tonic not once in its place"), (no(within(at(2), "Mode")) | (count("Mode") != 1), "mode not once in its place"),
        (no(at(3) == id_of("Bar")), "no bar after the prefix"),
        (within(at(1), "Tonic") & (at(1) - id_of("Tonic") != said([*TONICS, "UNKNOWN"], "tonic")), "tonic differs from the label"),
        (within(at(2), "Mode") & (at(2) - id_of("Mode") != said([*MODES, "UNKNOWN"], "mode")), "mode differs from the label"),
        (F.size("ids") != F.col("length"), "length differs"), (count("Pitch") != F.col("n_notes"), "note count differs"), (count("Duration") != F.col("n_notes"), "duration count differs"),
        (count("PitchBend") != F.col("n_bends"), "bend count differs"), (count("Technique") != F.col("n_labels"), "label count differs"),
    ]
    return broken_rules(sequences, rules).select(*keys, "rule")


def token_rules(typed: DataFrame, most: int, least_tokens: int) -> DataFrame:
    """(PHRASE, rule, n): steps of typed token streams (tokens.typed) that sampling would not have allowed.

    Positions rise inside a bar, a place has no pitch twice and `most` notes at most, a note has
    no label twice, no slide up and down, no dead note with a slide or vibrato; palm mute goes
    on and off in turn, beginning off; an EOS follows a bar, after least_tokens tokens.
    """
    order = Window.partitionBy(*PHRASE).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda name: F.col("type") == name
    note = F.last(F.when(is_("Pitch"), F.col("pos")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = Window.partitionBy(*PHRASE, "bar", "position", "type").orderBy("pos")
    on_note = Window.partitionBy(*PHRASE, "note").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    mute = F.last(F.when(is_("Technique") & F.col("value").startswith("PALM_MUTE"), F.col("value")), True).over(so_far)
    rows = typed.withColumn("note", note).withColumn("muted", F.coalesce(mute == "PALM_MUTE_ON", F.lit(False))).withColumn("before", F.lag("type").over(order))
    rows = rows.withColumn("fall", F.col("position") <= F.lag("position").over(Window.partitionBy(*PHRASE, "bar", "type").orderBy("pos")))
    rows = rows.withColumn("heard", F.collect_set("value").over(place.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nth", F.row_number().over(place))
    rows = rows.withColumn("held", F.collect_set(F.when(is_("Technique"), F.col("value"))).over(on_note)).withColumn("step", F.row_number().over(order))
    has = lambda *names: F.arrays_overlap("held", F.array(*map(F.lit, names)))
    label, value = is_("Technique"), F.col("value")
    dead = ("SLIDE_UP", "SLIDE_DOWN", "VIBRATO")
    rules = [
        (is_("Position") & F.col("fall"), "position falls"), (is_("Pitch") & F.array_contains("heard", value), "pitch twice at a place"), (is_("Pitch") & (F.col("nth") > most), "too many notes at a place"),
        (label & F.array_contains("held", value), "label twice"), (label & ((value == "SLIDE_UP") & has("SLIDE_DOWN") | (value == "SLIDE_DOWN") & has("SLIDE_UP")), "slide up and down"),
        (label & ((value == "DEAD_NOTE") & has(*dead) | value.isin(*dead) & has("DEAD_NOTE")), "dead note with another label"),
        (label & ((value == "PALM_MUTE_ON") & F.col("muted") | (value == "PALM_MUTE_OFF") & ~F.col("muted")), "mute does not alternate"),
        (is_("EOS") & ~F.coalesce(F.col("before") == "Bar", F.lit(False)), "EOS does not follow a bar"), (is_("EOS") & (F.col("step") <= least_tokens), "EOS too early"),
    ]
    return broken_rules(rows, rules).groupBy(*PHRASE, "rule").agg(F.count("*").alias("n"))


def unmatched_annotations(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations whose note does not exist."""
    return annotations.join(notes, ["source_id", *NOTE], "left_anti")


def limit_issues(annotations: DataFrame, notes: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
    """(source_id, declared, expanded): sources with over `limit` annotations, as declared or with each note of a muted range counted."""
    own = annotations.groupBy("source_id").agg(F.count("*").alias("declared"))
    muted = notes.filter("muted").groupBy("source_id").agg(F.count("*").alias("n_muted"))
    both = own.join(ranges.groupBy("source_id").agg(F.count("*").alias("n_ranges")), "source_id", "full_outer").join(muted, "source_id", "left").fillna(0)
    rows = both.select("source_id", (F.col("declared") + F.col("n_ranges")).alias("declared"), (F.col("declared") + F.col("n_muted")).alias("expanded"))
    return rows.filter((F.col("declared") > limit) | (F.col("expanded") > limit))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Values of the keys that several rows share, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
