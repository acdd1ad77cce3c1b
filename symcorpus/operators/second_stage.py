"""The second stage: published fragments, gated by their contract, become sequences of ids.

A phrase is encoded once. Its variants are made in token space: pitch ids move by the semitones
of the variant, and the prefix holds the variant's own tonic and mode.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TONICS
from .contracts import fragment_issues, repeated_keys, sequence_issues
from .events import sliced_bends
from .stages import FRAGMENT, rank_of
from .tokens import CELL, PHRASE, encode, families, id_of, vocabulary
from .tonality import MODES


class Sequences(NamedTuple):
    """rows: FRAGMENT, split and ids of fragments that keep every rule; failures: FRAGMENT and rules of the others."""

    rows: DataFrame
    failures: DataFrame


def phrase_contents(phrases: DataFrame, wheel: DataFrame, labels: DataFrame, tempi: DataFrame) -> DataFrame:
    """(PHRASE, tempo_bpm, notes, events): what phrases hold, a row a phrase, as the first stage publishes it.

    phrases, wheel and labels are those of stages; tempi holds (source_id, tempo_bpm). A note has its
    distinct labels in their order, events are (tick, value) inside the phrase. A phrase is four
    bars of one track, so a row stays small.
    """
    names = F.transform(F.array_sort(F.collect_set(F.struct(rank_of(F.col("type")).alias("rank"), "type"))), lambda x: x["type"])
    told = labels.groupBy(*PHRASE, "note_index").agg(names.alias("labels"))
    none = F.array().cast("array<string>")
    held = phrases.join(told, [*PHRASE, "note_index"], "left").withColumn("labels", F.coalesce("labels", none))
    note = F.struct(*[F.col(c).cast("long").alias(c) for c in ("note_index", "onset_tick", "end_tick", "pitch", "velocity")], "labels")
    by = held.groupBy(*PHRASE).agg(F.array_sort(F.collect_list(note)).alias("notes"))
    curves = sliced_bends(wheel, by.select(*PHRASE)).select(*PHRASE, F.transform("events", lambda x: F.struct(x["tick"].alias("tick"), x["value"].alias("value"))).alias("events"))
    silent = F.array().cast("array<struct<tick:bigint,value:int>>")
    return by.join(curves, PHRASE, "left").join(tempi.select("source_id", "tempo_bpm"), "source_id").select(*PHRASE, "tempo_bpm", "notes", F.coalesce("events", silent).alias("events"))


def bodies(contents: DataFrame) -> DataFrame:
    """(PHRASE, body, n_notes, n_bends, n_labels): ids of each phrase without a frame, and what must be found in them, counted from the contents."""
    notes = contents.select(*PHRASE, "tempo_bpm", F.inline("notes")).withColumnRenamed("note_index", "seq")
    bends = contents.select(*PHRASE, F.inline("events"))
    tokens = encode(notes, bends, F.col("tempo_bpm")).join(F.broadcast(vocabulary(contents.sparkSession).select("id", "token")), "token", "left")
    body = tokens.groupBy(*PHRASE).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("body"))
    cells = F.array_distinct(F.transform("events", lambda x: F.floor(x["tick"] / CELL + F.lit(0.5))))
    labels = F.aggregate("notes", F.lit(0), lambda n, x: n + F.size(x["labels"]))
    return contents.select(*PHRASE, F.size("notes").alias("n_notes"), F.size(cells).alias("n_bends"), labels.alias("n_labels")).join(body, PHRASE, "left")


def _named(family: str, names: list[str], value: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, names)), value).cast("int")
    return F.when(at > 0, at - 1 + id_of(family))


def moved(body: Column, semitones: Column) -> Column:
    """Ids with each pitch moved; a pitch that leaves the vocabulary's pitches gives null."""
    low, high = id_of("Pitch"), id_of("Pitch", dict(families())["Pitch"] - 1)
    inside = lambda x: x.between(low, high)
    return F.transform(body, lambda x: F.when(~F.coalesce(inside(x), F.lit(False)), x).otherwise(F.when(inside(x + semitones), x + semitones)))


def framed(fragments: DataFrame, phrase_bodies: DataFrame) -> DataFrame:
    """Fragments with ids (BOS, tonic, mode, the moved body, EOS) and their length; ids are null where a phrase has no contents.

    fragments hold FRAGMENT, tonic and mode of the variant. An unknown name gives a null id.
    """
    prefix = F.array(F.lit(id_of("BOS")), _named("Tonic", [*TONICS, "UNKNOWN"], F.col("tonic")), _named("Mode", [*MODES, "UNKNOWN"], F.col("mode")))
    rows = fragments.join(phrase_bodies, PHRASE, "left")
    ids = F.concat(prefix, moved(F.col("body"), F.col("semitones").cast("int")), F.array(F.lit(id_of("EOS"))))
    return rows.withColumn("ids", ids).withColumn("length", F.size("ids")).drop("body")


def without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose fragment is not among the others; null parts of a key count as equal."""
    keys = others.select(*[F.col(k).alias(f"other_{k}") for k in FRAGMENT]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in FRAGMENT]
    return rows.join(keys, same, "left_anti")


def tokenized_fragments(fragments: DataFrame, sources: DataFrame, contents: DataFrame, run: str, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sequences:
    """Sequences of declared fragments, and every rule that the others break, in one text each.

    Fragments that break their contract are not encoded. Sequences are checked against what
    the contents and the fragment's record declare; over `limit` ids is too long and never cut.
    keep may write rows and read them back: what the gate stops, the encoded fragments and the
    failures are read by several steps, and without it each of them would encode all phrases again.
    """
    twice = repeated_keys(fragments, *FRAGMENT).select(*FRAGMENT, F.lit("declared twice").alias("rule"))
    gate = keep(fragment_issues(fragments, sources, run).unionByName(twice))
    made = keep(framed(without(fragments, gate), bodies(contents)))
    empty = made.filter("ids IS NULL").select(*FRAGMENT, F.lit("phrase without contents").alias("rule"))
    full = made.filter("ids IS NOT NULL")
    odd = full.filter(F.col("num_notes") != F.col("n_notes")).select(*FRAGMENT, F.lit("declared notes differ").alias("rule"))
    broken = gate.unionByName(empty).unionByName(odd).unionByName(sequence_issues(full, limit, FRAGMENT))
    failures = keep(broken.groupBy(*FRAGMENT).agg(F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("rules")))
    return Sequences(without(full, failures).select(*FRAGMENT, "split", "ids"), failures)


def sequence_summary(made: Sequences, splits: DataFrame) -> DataFrame:
    """Sequences, distinct phrases, tokens, their extremes and failures by split and variant, by split, and over all.

    Failures of sources without a split count under split null; of rows over all splits
    or variants, every_split and every_variant are true.
    """
    rows = made.rows.select(*FRAGMENT, F.size("ids").cast("long").alias("n")).unionByName(made.failures.select(*FRAGMENT), allowMissingColumns=True)
    rows = rows.join(splits.select("source_id", "split"), "source_id", "left")
    sounds = F.when(F.col("n").isNotNull(), F.struct("source_id", "phrase_index"))
    return rows.groupingSets([["split", "semitones"], ["split"], []], "split", "semitones").agg(
        F.grouping("split").cast("boolean").alias("every_split"), F.grouping("semitones").cast("boolean").alias("every_variant"), F.count("n").alias("sequences"), F.count_distinct(sounds).alias("phrases"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.count_if(F.col("n").isNull()).alias("failures"),
    )
