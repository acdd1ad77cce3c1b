"""Tonic and mode of a source: every candidate scored on its pitch-class and bass profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TONICS
from .events import bass_profile, pitch_class_profile

# fixed values: the modes in order, with their steps above the tonic
MODES = {
    "MAJOR": [0, 2, 4, 5, 7, 9, 11],
    "MINOR": [0, 2, 3, 5, 7, 8, 10],
    "DORIAN": [0, 2, 3, 5, 7, 9, 10],
    "PHRYGIAN": [0, 1, 3, 5, 7, 8, 10],
    "LYDIAN": [0, 2, 4, 6, 7, 9, 11],
    "MIXOLYDIAN": [0, 2, 4, 5, 7, 9, 10],
    "LOCRIAN": [0, 1, 3, 5, 6, 8, 10],
    "HARMONIC_MINOR": [0, 2, 3, 5, 7, 8, 11],
    "PHRYGIAN_DOMINANT": [0, 1, 4, 5, 7, 8, 10],
    "BLUES": [0, 3, 5, 6, 7, 10],
}
# fixed values: weight of each term of a candidate's score
WEIGHTS = {"coverage": 5.0, "outside": -3.0, "tonic": 1.5, "bass": 1.0, "fifth": 0.35, "first": 0.5, "final": 0.75, "completeness": 0.25}


def _dense(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """An array of twelve values by source, zero where a pitch class is absent."""
    held = F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("int"), F.col(value).cast("double"))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at(F.col("held"), i), F.lit(0.0)))
    return rows.groupBy("source_id").agg(held.alias("held")).select("source_id", dense.alias(name))


def scores(notes: DataFrame) -> DataFrame:
    """(source_id, scores): 120 rounded scores in order of tonic, then mode; one row a source, no candidate rows."""
    bass = bass_profile(notes)
    ends = bass.groupBy("source_id").agg(F.first("first_bass").alias("first_bass"), F.first("last_bass").alias("last_bass"))
    rows = _dense(pitch_class_profile(notes), "pitch_class", "weight", "weights").join(_dense(bass, "bass", "votes", "votes"), "source_id").join(ends, "source_id")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("all_weight", total("weights")).withColumn("all_votes", total("votes"))

    modes = "array(" + ", ".join(f"array({', '.join(map(str, steps))})" for steps in MODES.values()) + ")"
    n = len(MODES)
    candidate = F.expr(f"transform(sequence(0, {12 * n - 1}), k -> named_struct('tonic', k div {n}, 'steps', get({modes}, k % {n})))")

    def score(c: Column) -> Column:
        weight = lambda k: F.get("weights", k.cast("int"))
        at = lambda step: (c["tonic"] + step) % 12
        terms = {
            "coverage": c["coverage"], "outside": 1 - c["coverage"], "tonic": weight(c["tonic"]) / F.col("all_weight"), "bass": F.get("votes", c["tonic"].cast("int")) / F.col("all_votes"),
            "fifth": weight(at(7)) / F.col("all_weight"), "first": (F.col("first_bass") == c["tonic"]).cast("int"), "final": (F.col("last_bass") == c["tonic"]).cast("int"),
            "completeness": F.size(F.filter(c["steps"], lambda step: weight(at(step)) > 0)) / F.size(c["steps"]),
        }
        return F.round(reduce(lambda a, b: a + b, [w * terms[t] for t, w in WEIGHTS.items()]), 9)

    def covered(c: Column) -> Column:
        inside = F.aggregate(c["steps"], F.lit(0.0), lambda a, step: a + F.get("weights", ((c["tonic"] + step) % 12).cast("int")))
        return c.withField("coverage", inside / F.col("all_weight"))

    return rows.select("source_id", F.transform(F.transform(candidate, covered), score).alias("scores"))


def _confidence(best: Column, second: Column) -> Column:
    margin = F.greatest(best - second, F.lit(0.0))
    return F.round(margin / (1 + margin), 6)


def infer(notes: DataFrame) -> DataFrame:
    """The best candidate of each source; ties go to the lower pitch class, then the earlier mode."""
    n = len(MODES)
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    rows = scores(notes).withColumn("best", best).withColumn("tonic_id", F.floor(F.col("best") / n).cast("int"))
    by_tonic = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: F.array_max(F.slice("scores", t * n + 1, n))), False)
    of_winner = F.sort_array(F.slice("scores", F.col("tonic_id") * n + 1, n), False)
    names, modes = F.array(*map(F.lit, TONICS)), F.array(*map(F.lit, MODES))
    return rows.select(
        "source_id", F.get(names, "tonic_id").alias("tonic"), F.get(modes, F.col("best") % n).alias("mode"),
        _confidence(F.get(by_tonic, F.lit(0)), F.get(by_tonic, F.lit(1))).alias("tonic_confidence"),
        _confidence(F.get(of_winner, F.lit(0)), F.get(of_winner, F.lit(1))).alias("mode_confidence"),
    )


def resolve(sources: DataFrame, manual: DataFrame, inferred: DataFrame, policy: str) -> DataFrame:
    """A manual label wins; else the inferred one under infer_source; else UNKNOWN. Manual and unknown have no confidence."""
    rows = sources.join(manual.select("source_id", F.struct("tonic", "mode", F.lit("MANUAL").alias("method"), F.lit(None).cast("double").alias("tonic_confidence"), F.lit(None).cast("double").alias("mode_confidence")).alias("manual")), "source_id", "left")
    rows = rows.join(inferred.select("source_id", F.struct("tonic", "mode", F.lit("AUTO_SOURCE").alias("method"), "tonic_confidence", "mode_confidence").alias("auto")), "source_id", "left")
    unknown = F.struct(F.lit("UNKNOWN").alias("tonic"), F.lit("UNKNOWN").alias("mode"), F.lit("UNKNOWN").alias("method"), F.lit(None).cast("double").alias("tonic_confidence"), F.lit(None).cast("double").alias("mode_confidence"))
    chosen = F.coalesce("manual", "auto", unknown) if policy == "infer_source" else F.coalesce("manual", unknown)
    return rows.select("source_id", chosen.alias("label")).select("source_id", "label.*")


def label_issues(labels: DataFrame) -> DataFrame:
    """Labels with the rules they break, joined in order."""
    auto = F.col("method").startswith("AUTO")
    both = F.col("tonic_confidence").isNotNull() & F.col("mode_confidence").isNotNull()
    none = F.col("tonic_confidence").isNull() & F.col("mode_confidence").isNull()
    inside = F.coalesce(F.col("tonic_confidence").between(0, 1) & F.col("mode_confidence").between(0, 1), F.lit(False))
    rules = [
        ((F.col("tonic") == "UNKNOWN") & (F.col("mode") != "UNKNOWN"), "mode without tonic"),
        (auto & ~(both & inside), "confidence missing"),
        (~auto & ~none, "confidence not allowed"),
    ]
    issues = F.concat_ws("; ", *[F.when(bad, F.lit(text)) for bad, text in rules])
    return labels.select("source_id", issues.alias("issues")).filter("issues <> ''")


def review(labels: DataFrame, top: int) -> DataFrame:
    """The labels least sure of themselves; a missing confidence counts as 1 and shows as a dash."""
    shown = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("-"))
    sure = lambda c: F.coalesce(c, F.lit(1.0))
    ordered = labels.orderBy(sure(F.col("mode_confidence")), sure(F.col("tonic_confidence")), "source_id").limit(top)
    hidden = lambda c: F.when(F.col(c).isNull(), "-").otherwise(shown(F.col(c)))
    return ordered.select("source_id", "tonic", "mode", hidden("tonic_confidence").alias("tonic_confidence"), hidden("mode_confidence").alias("mode_confidence"))
