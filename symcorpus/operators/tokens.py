"""Token streams of phrases: vocabulary, encoding, labels after notes, wrapping, decoding and audits.

A phrase is (source_id, phrase_index). One tick is 1/480 beat, a grid cell 1/24 beat, a bar four beats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TONICS
from .tonality import MODES

PHRASE = ["source_id", "phrase_index"]
CELL, BAR = 20, 96  # ticks a cell, cells a bar
# fixed values: labels in the order in which they follow a note
TECHNIQUES = ["DEAD_NOTE", "PALM_MUTE_ON", "PALM_MUTE_OFF", "SLIDE_UP", "SLIDE_DOWN", "VIBRATO"]
# fixed values: what may follow each type
GRAPH = {
    "Bar": ["Bar", "Position"],
    "Position": ["Tempo", "PitchBend", "Pitch"],
    "Tempo": ["PitchBend", "Pitch", "Position", "Bar"],
    "PitchBend": ["Pitch", "Position", "Bar"],
    "Pitch": ["Duration"],
    "Duration": ["Pitch", "Position", "Bar", "Technique"],
    "Technique": ["Technique", "Pitch", "Position", "Bar"],
}


def bend_text(value: Column) -> Column:
    """The nearest of 65 wheel values from -8191 to 8191."""
    step = F.floor((value + 8191) / 255.96875 + F.lit(0.5))
    return (step * 255.96875 - 8191).cast("int").cast("string")


def tempo_text(bpm: Column) -> Column:
    """The nearest of 32 tempi from 40 to 250."""
    step = F.least(F.greatest(F.floor((bpm - 40) * 31 / 210 + F.lit(0.5)), F.lit(0)), F.lit(31))
    return F.format_string("%.2f", step * 210 / 31.0 + 40)


def grid(length: Column) -> Column:
    """Length on the grid in ticks: 24 steps a beat below four beats, then 4 a beat up to 16."""
    fine = F.greatest(F.floor(length / CELL + F.lit(0.5)), F.lit(1))
    coarse = F.least(F.greatest(F.floor(length / 120 + F.lit(0.5)), F.lit(16)), F.lit(64))
    return F.when(fine < BAR, fine * CELL).otherwise(coarse * 120).cast("long")


def duration_text(ticks: Column) -> Column:
    """beats.steps.resolution of a length on the grid."""
    fine = F.format_string("%d.%d.24", F.floor(ticks / 480), F.floor(ticks % 480 / CELL).cast("long"))
    return F.when(ticks < 1920, fine).otherwise(F.format_string("%d.%d.4", F.floor(ticks / 480), F.floor(ticks % 480 / 120).cast("long")))


def families() -> list[tuple[str, int]]:
    return [("PAD", 1), ("BOS", 1), ("EOS", 1), ("Bar", 1), ("Pitch", 88), ("Position", BAR), ("Duration", 144), ("Tempo", 32), ("PitchBend", 65), ("Technique", len(TECHNIQUES)), ("Tonic", 13), ("Mode", len(MODES) + 1)]


def vocabulary(spark: SparkSession) -> DataFrame:
    """(id, token, type): families in order, each by its own rule; some 460 rows."""
    named = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    ticks = lambda i: F.when(i < 95, (i + 1) * CELL).otherwise((i - 79) * 120)
    value = {
        "Pitch": lambda i: (i + 21).cast("string"), "Position": lambda i: i.cast("string"), "Duration": lambda i: duration_text(ticks(i)),
        "Tempo": lambda i: F.format_string("%.2f", i * 210 / 31.0 + 40), "PitchBend": lambda i: (i * 255.96875 - 8191).cast("int").cast("string"),
        "Technique": lambda i: named(TECHNIQUES, i), "Tonic": lambda i: named([*TONICS, "UNKNOWN"], i), "Mode": lambda i: named([*MODES, "UNKNOWN"], i),
    }
    kind = text = F.lit(None).cast("string")
    start = 0
    for name, n in families():
        inside = F.col("id").between(start, start + n - 1)
        kind = F.when(inside, name).otherwise(kind)
        text = F.when(inside, value.get(name, lambda i: F.lit("None"))(F.col("id") - start)).otherwise(text)
        start += n
    rows = spark.range(sum(n for _, n in families()), numPartitions=1)
    return rows.select(F.col("id").cast("int").alias("id"), F.concat_ws("_", kind, text).alias("token"), kind.alias("type"))


def encode(notes: DataFrame, bends: DataFrame, bpm: Column, labels: DataFrame | None = None) -> DataFrame:
    """(phrase, pos, token) of notes and wheel values of phrases that hold a note.

    Bars, positions and closing bars follow from neighbours in one window over the phrase, so
    events are shuffled once by phrase and never joined with a list of bars. bpm may be a column
    of the notes, one value a phrase. Without labels, notes may carry their own, in order.
    """
    cell = lambda c: F.floor(F.col(c) / CELL + F.lit(0.5)).cast("long")
    if labels is None:
        notes = notes if "labels" in notes.columns else notes.withColumn("labels", F.array().cast("array<string>"))
    else:
        order = F.array(*map(F.lit, TECHNIQUES))
        held = labels.groupBy("source_id", "seq").agg(F.collect_set("type").alias("held"))
        own = F.filter(order, lambda t: F.array_contains("held", t))
        notes = notes.join(held, ["source_id", "seq"], "left").withColumn("labels", F.coalesce(own, F.array().cast("array<string>")))
    ticks = grid(F.col("end_tick") - F.col("onset_tick"))
    tokens = F.concat(F.array(F.concat(F.lit("Pitch_"), F.col("pitch")), F.concat(F.lit("Duration_"), duration_text(ticks))), F.transform("labels", lambda x: F.concat(F.lit("Technique_"), x)))
    at = notes.withColumn("cell", cell("onset_tick")).withColumn("ticks", ticks)
    last = F.greatest(F.floor(F.col("cell") / BAR), F.floor((F.col("cell") * CELL + F.col("ticks") - 1) / (BAR * CELL))).cast("long")
    sounds = at.select(*PHRASE, "cell", F.lit(3).alias("kind"), F.col("pitch").cast("long").alias("a"), F.col("ticks").alias("b"), F.col("seq").alias("c"), last.alias("last"), tokens.alias("own"))
    none = [F.lit(0).cast("long").alias(x) for x in "abc"]
    head = notes.select(*PHRASE, bpm.alias("bpm")).distinct()
    tempo = head.select(*PHRASE, F.lit(0).cast("long").alias("cell"), F.lit(1).alias("kind"), *none, F.lit(0).cast("long").alias("last"), F.array(F.concat(F.lit("Tempo_"), tempo_text(F.col("bpm")))).alias("own"))
    wheel = bends.withColumn("cell", cell("tick")).groupBy(*PHRASE, "cell").agg(F.max_by("value", "tick").alias("value")).join(head, PHRASE, "left_semi")
    wheel = wheel.select(*PHRASE, "cell", F.lit(2).alias("kind"), *none, F.floor(F.col("cell") / BAR).cast("long").alias("last"), F.array(F.concat(F.lit("PitchBend_"), bend_text(F.col("value")))).alias("own"))

    over = Window.partitionBy(*PHRASE).orderBy("cell", "kind", "a", "b", "c")
    bar = F.floor(F.col("cell") / BAR).cast("int")
    before = F.coalesce(F.floor(F.lag("cell").over(over) / BAR).cast("int"), F.lit(-1))
    rows = sounds.unionByName(tempo).unionByName(wheel).select(
        *PHRASE, "cell", "kind", "a", "b", "c", "own", (bar - before).alias("bars"), (~F.lag("cell").over(over).eqNullSafe(F.col("cell"))).alias("moved"),
        F.when(F.lead("cell").over(over).isNull(), F.max("last").over(Window.partitionBy(*PHRASE)).cast("int") - bar).otherwise(0).alias("closing"),
    )
    bars = lambda c: F.array_repeat(F.lit("Bar_None"), F.col(c))
    position = F.when(F.col("moved"), F.array(F.concat(F.lit("Position_"), F.col("cell") % BAR))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("tokens", F.concat(bars("bars"), position, F.col("own"), bars("closing")))
    base = F.coalesce(F.sum(F.size("tokens")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("base", base).select(*PHRASE, "base", F.posexplode("tokens").alias("at", "token")).select(*PHRASE, (F.col("base") + F.col("at")).alias("pos"), "token")


def typed(tokens: DataFrame) -> DataFrame:
    """Tokens with type, value, bar and position so far."""
    over = Window.partitionBy(*PHRASE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("type", F.substring_index("token", "_", 1)).withColumn("value", F.expr("substring(token, instr(token, '_') + 1)"))
    bar = F.count_if(F.col("type") == "Bar").over(over) - 1
    position = F.last(F.when(F.col("type") == "Position", F.col("value").cast("int")), True).over(over)
    return rows.withColumn("bar", bar).withColumn("position", position)


def decode(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and wheel values of token streams, in ticks of the grid."""
    over = Window.partitionBy(*PHRASE).orderBy("pos")
    rows = typed(tokens).withColumn("next", F.lead("value").over(over)).withColumn("tick", (F.col("bar") * BAR + F.col("position")) * CELL)
    parts = F.transform(F.split("next", r"\."), lambda x: x.cast("long"))
    length = (F.get(parts, F.lit(0)) * F.get(parts, F.lit(2)) + F.get(parts, F.lit(1))) * 480 / F.get(parts, F.lit(2))
    notes = rows.filter("type = 'Pitch'").select(*PHRASE, F.col("pos").alias("seq"), F.col("tick").alias("onset_tick"), (F.col("tick") + length.cast("long")).alias("end_tick"), F.col("value").cast("int").alias("pitch"))
    bends = rows.filter("type = 'PitchBend'").select(*PHRASE, "tick", F.col("value").cast("int").alias("value"))
    return notes, bends


def extract_labels(tokens: DataFrame) -> DataFrame:
    """Labels with the pitch token of the note before them; a label that follows neither length nor label is misplaced."""
    over = Window.partitionBy(*PHRASE).orderBy("pos")
    rows = typed(tokens)
    note = F.last(F.when(F.col("type") == "Pitch", F.col("pos")), True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    placed = F.coalesce(F.lag("type").over(over).isin("Duration", "Technique"), F.lit(False))
    return rows.withColumn("note_pos", note).withColumn("placed", placed).filter("type = 'Technique'").select(*PHRASE, "note_pos", F.col("value").alias("technique"), "placed")


def wrapped(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """(phrase, ids): BOS, tonic, mode, the stream and EOS as ids; a phrase is one short row."""
    body = tokens.groupBy(*PHRASE).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    rows = body.join(labels.select("source_id", "tonic", "mode"), "source_id")
    ends = lambda *x: F.array(*x)
    whole = F.concat(ends(F.lit("BOS_None"), F.concat(F.lit("Tonic_"), "tonic"), F.concat(F.lit("Mode_"), "mode")), F.transform("t", lambda x: x["token"]), ends(F.lit("EOS_None")))
    known = F.broadcast(vocabulary(tokens.sparkSession).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("known")))
    # the vocabulary is one row of fixed size
    return rows.select(*PHRASE, whole.alias("tokens")).crossJoin(known).select(*PHRASE, F.transform("tokens", lambda x: F.try_element_at("known", x)).alias("ids"))


def id_of(name: str, offset: int = 0) -> int:
    at = 0
    for family, n in families():
        if family == name:
            return at + offset
        at += n
    raise KeyError(name)


def split_prefix(sequences: DataFrame) -> DataFrame:
    """Tonic and mode of wrapped sequences, and the body without prefix and ends; valid says whether the frame is right."""
    a, b = F.get("ids", F.lit(1)), F.get("ids", F.lit(2))
    inside = lambda x, name, n: x.between(id_of(name), id_of(name, n - 1))
    valid = (F.get("ids", F.lit(0)) == id_of("BOS")) & (F.element_at("ids", -1) == id_of("EOS")) & inside(a, "Tonic", 13) & inside(b, "Mode", len(MODES) + 1)
    tonic = F.get(F.array(*map(F.lit, [*TONICS, "UNKNOWN"])), a - id_of("Tonic"))
    mode = F.get(F.array(*map(F.lit, [*MODES, "UNKNOWN"])), b - id_of("Mode"))
    return sequences.select(*PHRASE, tonic.alias("tonic"), mode.alias("mode"), F.slice("ids", F.lit(4), F.size("ids") - 4).alias("body"), valid.alias("valid"))


def contract(sequences: DataFrame, limit: int = 64) -> DataFrame:
    """The rules that each wrapped sequence breaks, a row for each; over `limit` ids is too long."""
    inner = F.slice("ids", F.lit(2), F.size("ids") - 2)
    has = lambda name: F.array_contains(inner, id_of(name))
    rules = {
        "no BOS first": F.get("ids", F.lit(0)) != id_of("BOS"), "no EOS last": F.element_at("ids", -1) != id_of("EOS"), "BOS or EOS inside": has("BOS") | has("EOS"),
        "PAD": F.array_contains("ids", id_of("PAD")), "no bar after the prefix": F.get("ids", F.lit(3)) != id_of("Bar"), "unknown token": F.exists("ids", lambda x: x.isNull()),
        "too short": F.size("ids") < 5, "second prefix": F.exists(F.slice("ids", F.lit(4), F.size("ids")), lambda x: x >= id_of("Tonic")),
        "too long": F.size("ids") > limit,
    }
    broken = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return sequences.select(*PHRASE, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def transitions(tokens: DataFrame) -> DataFrame:
    """Pairs of neighbouring types with their number, and whether the graph has them."""
    over = Window.partitionBy(*PHRASE).orderBy("pos")
    pairs = typed(tokens).withColumn("next", F.lead("type").over(over)).filter("next IS NOT NULL").groupBy("type", "next").agg(F.count("*").alias("n"))
    legal = F.concat_ws(">", "type", "next").isin([f"{a}>{b}" for a, then in GRAPH.items() for b in then])
    return pairs.withColumn("legal", legal)


def state_audit(tokens: DataFrame, most: int) -> DataFrame:
    """By phrase: positions that do not rise in their bar, pitches repeated at a place, places with over `most` notes."""
    rows = typed(tokens)
    before = F.lag("position").over(Window.partitionBy(*PHRASE, "bar", "type").orderBy("pos"))
    falls = rows.withColumn("fall", (F.col("type") == "Position") & (F.col("position") <= before))
    falls = falls.groupBy(*PHRASE).agg(F.count_if("fall").alias("falls"))
    places = rows.filter("type = 'Pitch'").groupBy(*PHRASE, "bar", "position").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"))
    crowded = places.groupBy(*PHRASE).agg(F.sum(F.col("n") - F.col("d")).alias("repeated"), F.count_if(F.col("n") > most).alias("crowded"))
    return falls.join(crowded, PHRASE, "left").fillna(0)


def without_closing_bars(tokens: DataFrame) -> DataFrame:
    """Streams without the bars after their last other token."""
    last = F.max(F.when(F.col("token") != "Bar_None", F.col("pos"))).over(Window.partitionBy(*PHRASE))
    return tokens.withColumn("last", last).filter("pos <= last").drop("last")


def tokenized(tokens: DataFrame, labels: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """The second stage: wrapped sequences that keep the contract, and (PHRASE, rules) of those that break it.

    A caller that wants all or nothing raises where the second table has a row. keep may write the
    sequences and read them back; without it each reader of the two tables encodes them again.
    """
    sequences = keep(wrapped(tokens, labels))
    failures = contract(sequences, limit).groupBy(*PHRASE).agg(F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("rules"))
    return sequences.join(failures, PHRASE, "left_anti"), failures


def tokenize_summary(sequences: DataFrame, failures: DataFrame, splits: DataFrame) -> DataFrame:
    """Sequences, their tokens and the failures by split and over all (split null)."""
    rows = sequences.select("source_id", F.size("ids").cast("long").alias("n_tokens")).unionByName(failures.select("source_id"), allowMissingColumns=True).join(splits, "source_id")
    n = F.col("n_tokens")
    return rows.groupingSets([["split"], []], "split").agg(
        F.count(n).alias("sequences"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"),
        F.count_if(n.isNull()).alias("failures"),
    )


def audit_samples(tokens: DataFrame, labels: DataFrame, asked: DataFrame, known: DataFrame, most: int, least_tokens: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(PHRASE, reasons) of generated streams: all that speaks against a stream, joined; empty where nothing does.

    A stream keeps the tonic and mode that were asked for, comes from a known source, decodes to
    notes of which none overlaps one of its pitch, breaks no rule of sampling (token_rules) and
    does not end in bars. keep may write rows and read them back: the parts are all dealt by
    phrase, and without it one task would hold the sorts of all of them at once.
    """
    from .contracts import token_rules

    tokens = keep(tokens)
    end = keep(tokens.groupBy(*PHRASE).agg((F.max("pos") + 1).alias("pos"), F.max_by("token", "pos").alias("last")))
    whole = tokens.unionByName(end.select(*PHRASE, "pos", F.lit("EOS_None").alias("token")))
    rules = token_rules(keep(typed(whole)), most, least_tokens).select(*PHRASE, F.col("rule").alias("reason"))
    notes = keep(decode(tokens)[0])
    over = Window.partitionBy(*PHRASE, "pitch").orderBy("onset_tick", "end_tick", "seq")
    overlaps = notes.withColumn("before", F.lag("end_tick").over(over)).filter("onset_tick < before").select(*PHRASE, F.lit("overlap of one pitch").alias("reason"))
    told = split_prefix(keep(wrapped(tokens, labels))).select(*PHRASE, F.col("tonic").alias("own_tonic"), F.col("mode").alias("own_mode"), "valid").join(asked, "source_id", "left")
    kept = F.coalesce(F.col("valid") & (F.col("own_tonic") == F.col("tonic")) & (F.col("own_mode") == F.col("mode")), F.lit(False))
    prefix = told.filter(~kept).select(*PHRASE, F.lit("prefix not kept").alias("reason"))
    stray = end.join(known.select("source_id").distinct(), "source_id", "left_anti").select(*PHRASE, F.lit("source unknown").alias("reason"))
    silent = end.join(notes.select(*PHRASE).distinct(), PHRASE, "left_anti").select(*PHRASE, F.lit("no notes").alias("reason"))
    bars = end.filter("last = 'Bar_None'").select(*PHRASE, F.lit("closing bars").alias("reason"))
    all_ = keep(rules).union(keep(overlaps)).union(prefix).union(stray).union(silent).union(bars).groupBy(*PHRASE).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return end.select(*PHRASE).join(all_, PHRASE, "left").fillna("", ["reasons"])
