"""Grids of lengths that a table of settings defines: their check, their values and the nearest value.

A setting is a row (grid_id, ord, start_beat, end_beat, resolution): from one beat to another, so
many steps a beat. Ranges follow each other from beat 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import broken_rules

# fixed values: bounds of a setting
MOST_BEATS, MOST_STEPS = 64, 64


def grid_issues(settings: DataFrame) -> DataFrame:
    """(grid_id, ord, rule) for each rule that a range of a grid breaks; a grid without a row here is sound.

    A null field breaks the rule on its bounds.
    """
    own = Window.partitionBy("grid_id").orderBy("ord")
    rows = settings.withColumn("before", F.lag("end_beat").over(own)).withColumn("first", F.row_number().over(own) == 1)
    start, end, steps = F.col("start_beat"), F.col("end_beat"), F.col("resolution")
    not_true = lambda c: ~F.coalesce(c, F.lit(False))
    return broken_rules(rows, [
        (not_true((start >= 0) & (start < end) & (end <= MOST_BEATS)), "range of beats"),
        (not_true(steps.between(1, MOST_STEPS)), "resolution"),
        (F.col("first") & not_true(start == 0), "does not start at beat 0"),
        (~F.col("first") & not_true(start == F.col("before")), "does not follow the range before"),
    ]).select("grid_id", "ord", "rule")


def grid_values(settings: DataFrame, ticks_per_beat: int) -> DataFrame:
    """(grid_id, lengths): all lengths of each sound grid in ticks, in order, from the first step up to the last beat.

    Steps that are no whole number of ticks are rounded down. A grid has at most 64 x 64 lengths.
    """
    sound = settings.join(grid_issues(settings).select("grid_id").distinct(), "grid_id", "left_anti")
    step = F.explode(F.sequence(F.lit(1), ((F.col("end_beat") - F.col("start_beat")) * F.col("resolution")).cast("int")))
    rows = sound.withColumn("k", step)
    ticks = (F.col("start_beat") * ticks_per_beat + F.floor(F.col("k") * ticks_per_beat / F.col("resolution"))).cast("long")
    return rows.select("grid_id", ticks.alias("x")).groupBy("grid_id").agg(F.array_sort(F.collect_set("x")).alias("lengths"))


def nearest(value: Column, lengths: Column, most: int = MOST_BEATS * MOST_STEPS) -> Column:
    """The entry of a sorted array that is nearest to value, the greater of two as near; null for an empty array and for a null value.

    Found by halving: the number of steps follows from the most entries that an array has.
    """
    steps = F.array_repeat(F.lit(0), math.ceil(math.log2(most + 1)))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.size(lengths).alias("hi"))  # the first entry that is not below lies in lo..hi
    below = lambda s: (s["lo"] < s["hi"]) & (F.get(lengths, middle(s)) < value)
    halve = lambda s, _: F.struct(F.when(below(s), middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(below(s) | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle(s)).alias("hi"))
    at = F.aggregate(steps, start, halve, lambda s: s["lo"])
    pick = F.struct(F.get(lengths, at - 1).alias("a"), F.get(lengths, at).alias("b"))
    return F.aggregate(F.array(pick), F.lit(None).cast("long"), lambda _, p: F.when(value.isNull(), None).when(p["a"].isNull(), p["b"]).when(p["b"].isNull(), p["a"]).when(value - p["a"] < p["b"] - value, p["a"]).otherwise(p["b"]))


def on_grids(rows: DataFrame, value: str, settings: DataFrame, ticks_per_beat: int, name: str = "length") -> DataFrame:
    """rows with the length nearest to a value on the grid that grid_id names; null where that grid is unknown or not sound.

    Grids are settings, written by hand: they are broadcast, some kilobytes each.
    """
    known = F.broadcast(grid_values(settings, ticks_per_beat))
    return rows.join(known, "grid_id", "left").withColumn(name, nearest(F.col(value), F.col("lengths"))).drop("lengths")
