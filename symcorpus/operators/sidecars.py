"""Sidecar files of JSON beside sources: labels of notes, muted ranges and tonalities, read as VARIANT and judged rule by rule.

A sidecar is taken whole or not at all: the first rule that it breaks is its reason, and only
sidecars without one give rows. Null and empty texts are no JSON. Repeated sidecars of one source
and one kind are an issue of each of them, as their rows could not be told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TONICS
from .events import NOTE
from .tonality import MODES

# fixed values of the file format
VERSION = 1
SUFFIXES = {"techniques": ".techniques.json", "tonality": ".tonality.json"}
MOST_BYTES = {"techniques": 1_048_576, "tonality": 65_536}
MOST_ANNOTATIONS = 10_000
MOST_SLIDE = 24
KEYS = {
    "techniques": ["schema_version", "source_midi", "source_sha256", "ticks_per_quarter", "instrument_index", "coverage", "note_techniques", "palm_mute_ranges"],
    "tonality": ["schema_version", "source_midi", "source_sha256", "instrument_index", "tonic", "mode"],
}


class Sidecars(NamedTuple):
    """What sidecars hold: issues (source_id, kind, reason), labels of notes, ranges, and tonalities of those without an issue."""

    issues: DataFrame
    annotations: DataFrame
    ranges: DataFrame
    tonalities: DataFrame


def strict_json(text: Column) -> Column:
    """Text as VARIANT; null where it is not one JSON value from end to end with no key twice.

    Spark's parser stops behind the first value. What follows it breaks the text inside brackets or
    inside an object, whichever it does not close itself.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    alone = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & (F.size(F.map_keys(F.try_variant_get(named, "$", "map<string,variant>"))) == 1)
    return F.when(alone, F.try_parse_json(text))


def kind_of(value: Column) -> Column:
    """The type of a VARIANT without its parts: OBJECT, ARRAY, STRING, BIGINT and so on; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def has_keys(value: Column, keys: list[str]) -> Column:
    held = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    return F.coalesce((kind_of(value) == "OBJECT") & (held == F.array(*map(F.lit, sorted(keys)))), F.lit(False))


def _part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def whole(value: Column, name: str, low: int, high: int | None = None) -> Column:
    """An integer field within bounds; null where it is none, so neither 1.0 nor true."""
    got = F.try_variant_get(value, f"$.{name}", "long")
    return F.when((kind_of(_part(value, name)) == "BIGINT") & (got >= low) & (got <= high if high is not None else F.lit(True)), got)


def string(value: Column, name: str) -> Column:
    """A string field that is not empty, else null."""
    got = F.try_variant_get(value, f"$.{name}", "string")
    return F.when((kind_of(_part(value, name)) == "STRING") & (got != ""), got)


def listing(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "array<variant>")


def first_broken(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that does not hold; a rule that is null does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for holds, name in rules])


def heads(sidecars: DataFrame, sources: DataFrame) -> DataFrame:
    """Sidecars (source_id, kind, text) and the first rule that their outermost fields break, `reason`.

    sources is (source_id, name, sha256, ppq, instrument_index, n_tracks): what a sidecar has to
    agree with. Sidecars of other sources are left out; orphans() tells them.
    """
    most = F.when(F.col("kind") == "techniques", MOST_BYTES["techniques"]).otherwise(MOST_BYTES["tonality"])
    rows = sidecars.join(sources, "source_id").withColumn("copies", F.count("*").over(Window.partitionBy("source_id", "kind")))
    rows = rows.withColumn("doc", F.when(F.octet_length("text") <= most, strict_json(F.col("text"))))
    doc, labels = F.col("doc"), F.col("kind") == "techniques"
    index = whole(doc, "instrument_index", 0)
    rules = [
        (F.col("copies") == 1, "several sidecars of a kind"),
        (~(F.octet_length("text") > most) | F.col("text").isNull(), "too large"),
        (doc.isNotNull(), "no strict JSON"),
        (kind_of(doc) == "OBJECT", "no object"),
        (F.when(labels, has_keys(doc, KEYS["techniques"])).otherwise(has_keys(doc, KEYS["tonality"])), "fields"),
        (whole(doc, "schema_version", VERSION, VERSION).isNotNull(), "schema_version"),
        (string(doc, "source_midi") == F.col("name"), "source_midi"),
        (string(doc, "source_sha256") == F.col("sha256"), "source_sha256"),
        (~labels | (whole(doc, "ticks_per_quarter", 1) == F.col("ppq")), "ticks_per_quarter"),
        ((index == F.col("instrument_index")) & (index < F.col("n_tracks")), "instrument_index"),
        (~labels | (string(doc, "coverage") == "COMPLETE"), "coverage"),
        (labels | string(doc, "tonic").isin(*TONICS, "UNKNOWN"), "tonic"),
        (labels | string(doc, "mode").isin(*MODES, "UNKNOWN"), "mode"),
        (labels | (string(doc, "tonic") != "UNKNOWN") | (string(doc, "mode") == "UNKNOWN"), "mode without tonic"),
        (~labels | (kind_of(_part(doc, "note_techniques")) == "ARRAY"), "note_techniques"),
        (~labels | (F.size(listing(doc, "note_techniques")) <= MOST_ANNOTATIONS), "too many annotations"),
    ]
    return rows.select("source_id", "kind", "text", first_broken(rules).alias("reason"))


def parsed(read: DataFrame) -> DataFrame:
    """Judged heads with `doc`, the JSON of those that hold."""
    return read.withColumn("doc", F.when(F.col("reason").isNull(), F.try_parse_json("text"))).drop("text")


def _technique_issue(x: Column, pitch: Column) -> Column:
    kind, way = string(x, "type"), string(x, "direction")
    target = whole(x, "target_pitch", 0, 127)
    step = F.when(way == "UP", target - pitch).otherwise(pitch - target)
    slide = kind == "SLIDE"
    return first_broken([
        (kind_of(x) == "OBJECT", "technique is no object"),
        (kind.isin("DEAD_NOTE", "VIBRATO", "SLIDE"), "technique type"),
        (F.when(slide, has_keys(x, ["type", "direction", "target_pitch"])).otherwise(has_keys(x, ["type"])), "technique fields"),
        (~slide | way.isin("UP", "DOWN"), "slide direction"),
        (~slide | target.isNotNull(), "slide target"),
        (~slide | step.between(1, MOST_SLIDE), "slide distance"),
    ])


def entries(read: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each labelled note of sidecars whose heads hold, with the first rule that it breaks.

    notes is (source_id, note columns) of the chosen tracks, without repeats. Rows are dealt by
    source once; a sidecar has no more entries than its size allows.
    """
    rows = read.filter("kind = 'techniques' AND reason IS NULL").select("source_id", F.posexplode(listing(F.col("doc"), "note_techniques")).alias("at", "entry"))
    entry = F.col("entry")
    low = {"onset_tick": 0, "end_tick": 1, "pitch": 0, "velocity": 1}
    high = {"pitch": 127, "velocity": 127}
    rows = rows.withColumn("note", _part(entry, "note")).withColumn("listed", listing(entry, "techniques"))
    rows = rows.select("*", *[whole(F.col("note"), c, low[c], high.get(c)).alias(c) for c in NOTE])
    kinds = F.transform("listed", lambda x: F.when(string(x, "type") == "SLIDE", F.concat(F.lit("SLIDE_"), string(x, "direction"))).otherwise(string(x, "type")))
    rows = rows.withColumn("kinds", kinds).withColumn("broken", F.get(F.filter(F.transform("listed", lambda x: _technique_issue(x, F.col("pitch"))), lambda x: x.isNotNull()), F.lit(0)))
    known = notes.select("source_id", *NOTE).withColumn("known", F.lit(True))
    rows = rows.join(known, ["source_id", *NOTE], "left")
    again = F.row_number().over(Window.partitionBy("source_id", *NOTE).orderBy("at"))
    total = F.sum(F.greatest(F.size("listed"), F.lit(0))).over(Window.partitionBy("source_id").orderBy("at"))
    has = lambda k: F.array_contains("kinds", k)
    slides = has("SLIDE_UP") | has("SLIDE_DOWN")
    reason = first_broken([
        (kind_of(entry) == "OBJECT", "entry is no object"),
        (has_keys(entry, ["note", "techniques"]), "entry fields"),
        (kind_of(F.col("note")) == "OBJECT", "note is no object"),
        (has_keys(F.col("note"), list(low)), "note fields"),
        *[(F.col(c).isNotNull(), f"note {c}") for c in ("onset_tick", "end_tick", "pitch", "velocity")],
        (F.col("end_tick") > F.col("onset_tick"), "note ends before it starts"),
        (F.col("known"), "no such note"),
        (F.col("again") == 1, "note twice"),
        (kind_of(_part(entry, "techniques")) == "ARRAY", "techniques are no list"),
        (F.size("listed") > 0, "no techniques"),
        (F.col("total") <= MOST_ANNOTATIONS, "too many annotations"),
        (F.col("broken").isNull(), "technique"),
        (F.size(F.array_distinct("kinds")) == F.size("kinds"), "technique twice"),
        (~(has("SLIDE_UP") & has("SLIDE_DOWN")), "slide up and down"),
        (~(has("DEAD_NOTE") & (slides | has("VIBRATO"))), "dead note with another"),
    ])
    rows = rows.withColumn("again", again).withColumn("total", total).withColumn("reason", reason)
    told = F.when(F.col("reason") == "technique", F.col("broken")).otherwise(F.col("reason"))
    targets = F.transform("listed", lambda x: F.try_variant_get(x, "$.target_pitch", "int"))
    return rows.select("source_id", "at", *NOTE, F.arrays_zip(F.col("kinds").alias("type"), targets.alias("target_pitch")).alias("techniques"), told.alias("reason"))


def muted_ranges(read: DataFrame, notes: DataFrame, durations: DataFrame, cell: int = 1440) -> DataFrame:
    """A row for each muted range of sidecars whose heads hold, with the first rule that it breaks.

    durations is (source_id, fin): the structural end of a source. Ranges meet onsets by cells of ticks,
    only where they lie within their source.
    """
    held = read.filter("kind = 'techniques' AND reason IS NULL").select("source_id", F.posexplode(listing(F.col("doc"), "palm_mute_ranges")).alias("at", "range"))
    value = F.col("range")
    rows = held.select("source_id", "at", "range", whole(value, "start_tick", 0).alias("start_tick"), whole(value, "end_tick", 1).alias("end_tick")).join(durations.select("source_id", "fin"), "source_id", "left")
    sound = rows.filter("start_tick < end_tick AND end_tick <= fin").select("source_id", "at", "start_tick", "end_tick")
    dealt = sound.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_tick") / cell), F.floor((F.col("end_tick") - 1) / cell))))
    onsets = notes.select("source_id", "onset_tick", F.floor(F.col("onset_tick") / cell).alias("cell")).distinct()
    hit = dealt.join(onsets, ["source_id", "cell"]).filter("start_tick <= onset_tick AND onset_tick < end_tick").select("source_id", "at").distinct().withColumn("hit", F.lit(True))
    order = Window.partitionBy("source_id").orderBy("start_tick", "end_tick", "at")
    rows = rows.join(hit, ["source_id", "at"], "left").withColumn("before", F.lag("end_tick").over(order))
    alone = first_broken([
        (kind_of(value) == "OBJECT", "range is no object"),
        (has_keys(value, ["start_tick", "end_tick"]), "range fields"),
        (F.col("start_tick").isNotNull(), "range start_tick"),
        (F.col("end_tick").isNotNull(), "range end_tick"),
        (F.col("end_tick") > F.col("start_tick"), "range ends before it starts"),
        (F.col("end_tick") <= F.col("fin"), "range beyond the source"),
        (F.col("hit"), "range without a note"),
    ])
    both = F.when(F.col("start_tick") < F.col("before"), "ranges overlap").when(F.col("start_tick") == F.col("before"), "ranges touch")
    return rows.select("source_id", "at", "start_tick", "end_tick", alone.alias("reason"), both.alias("between"))


def read_sidecars(sidecars: DataFrame, sources: DataFrame, notes: DataFrame, durations: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Sidecars:
    """Sidecars (source_id, kind, text) judged against sources, notes of their chosen tracks and structural ends.

    Reasons come in the order in which the fields are read: the head, labelled notes one by one,
    ranges one by one, ranges beside each other, and the number of all annotations. annotations
    are (source_id, note, type, target_pitch), a PALM_MUTE for each note of a range among them.
    keep may write rows and read them back, so that heads are judged once for all four tables. It is
    given texts and no VARIANT: Parquet files hold the integers of a field as decimals where one of
    them has a fraction such as .0, and 12 would no longer differ from 12.0.
    """
    known = keep(notes.select("source_id", *NOTE).distinct())
    read = parsed(keep(heads(sidecars, sources)))
    marks, muted = keep(entries(read, known)), keep(muted_ranges(read, known, durations))
    first = lambda rows, c, stage: rows.filter(F.col(c).isNotNull()).groupBy("source_id").agg(F.min(F.struct(F.lit(stage).alias("stage"), "at", F.col(c).alias("reason"))).alias("x"))
    listless = read.filter("kind = 'techniques' AND reason IS NULL").select("source_id", F.size(listing(F.col("doc"), "palm_mute_ranges")).alias("n_ranges"), kind_of(_part(F.col("doc"), "palm_mute_ranges")).alias("is"))
    wrong_list = first_broken([(F.col("is") == "ARRAY", "palm_mute_ranges"), (F.col("n_ranges") <= MOST_ANNOTATIONS, "too many annotations")])
    wide = listless.select("source_id", F.lit(-1).alias("at"), wrong_list.alias("reason"))
    labels = marks.select("source_id", *NOTE, F.explode("techniques").alias("x")).select("source_id", *NOTE, "x.type", "x.target_pitch")
    cell = 1440
    dealt = muted.filter("reason IS NULL AND between IS NULL").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_tick") / cell), F.floor((F.col("end_tick") - 1) / cell))))
    under = known.withColumn("cell", F.floor(F.col("onset_tick") / cell)).join(dealt.select("source_id", "cell", "start_tick", F.col("end_tick").alias("stop")), ["source_id", "cell"]).filter("start_tick <= onset_tick AND onset_tick < stop")
    palm = under.select("source_id", *NOTE, F.lit("PALM_MUTE").alias("type"), F.lit(None).cast("int").alias("target_pitch")).distinct()
    whole_rows = labels.unionByName(palm)
    declared = labels.select("source_id").unionByName(muted.select("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    expanded = whole_rows.groupBy("source_id").agg(F.count("*").alias("n"))
    many = declared.unionByName(expanded).filter(F.col("n") > MOST_ANNOTATIONS).select("source_id", F.lit(0).alias("at"), F.lit("too many annotations").alias("reason")).distinct()
    told = first(marks, "reason", 1).unionByName(first(wide, "reason", 2)).unionByName(first(muted, "reason", 3)).unionByName(first(muted, "between", 4)).unionByName(first(many, "reason", 5))
    # dealt anew, as the parts are dealt by source already and their partitions are not the same rows
    later = told.repartition("source_id").groupBy("source_id").agg(F.min("x").alias("x")).select("source_id", F.lit("techniques").alias("kind"), F.col("x.reason").alias("later"))
    judged = read.join(later, ["source_id", "kind"], "left").select("source_id", "kind", "doc", F.coalesce("reason", "later").alias("reason"))
    good = judged.filter("reason IS NULL")
    labelled = good.filter("kind = 'techniques'").select("source_id")
    tonalities = good.filter("kind = 'tonality'").select("source_id", string(F.col("doc"), "tonic").alias("tonic"), string(F.col("doc"), "mode").alias("mode"))
    issues = judged.filter("reason IS NOT NULL").select("source_id", "kind", "reason")
    return Sidecars(issues, whole_rows.join(labelled, "source_id", "left_semi"), muted.join(labelled, "source_id", "left_semi").select("source_id", "start_tick", "end_tick"), tonalities)


def orphans(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, kind) of sidecar files, of either kind, whose source is not among the paths of sources."""
    kind = F.coalesce(*[F.when(F.col("path").endswith(suffix), F.lit(name)) for name, suffix in SUFFIXES.items()])
    owner = F.coalesce(*[F.when(F.col("path").endswith(suffix), F.expr(f"left(path, length(path) - {len(suffix)})")) for suffix in SUFFIXES.values()])
    asked = files.select("path", kind.alias("kind"), owner.alias("owner")).filter("kind IS NOT NULL")
    return asked.join(sources.select(F.col("path").alias("owner")).distinct(), "owner", "left_anti").select("path", "kind")
