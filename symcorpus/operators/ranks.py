"""Ranks over whole tables, and look-ups by keys of any frequency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]


def global_rank(rows: DataFrame, order: list[str], keep: Keep, name: str = "rank") -> DataFrame:
    """rows with their rank from 0 in the order of columns, nulls first; ties by a hash of the row.

    Spark samples the order and deals rows into as many ranges as a shuffle has parts; the parts are
    kept (written and read back), as a second evaluation would sample other bounds. They
    are counted, and a row's rank is its place in its part behind all earlier parts, so a task
    holds about one part, whatever prefixes or keys the rows share. Rows that agree in every
    column lie in one part; which of them comes first says nothing.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "_tie"]
    dealt = keep(rows.withColumn("_tie", F.xxhash64(*sorted(rows.columns))).repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))  # a row a part
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    ranked = dealt.withColumn("_place", place).join(F.broadcast(bases), "_part")
    return ranked.select(*rows.columns, (F.col("_base") + F.col("_place") - 1).alias(name))


def frequent(counts: DataFrame, number: str, most: int) -> DataFrame:
    """Rows of counts whose number is at least the least power of two that leaves `most` rows at most.

    The driver holds a number for each power of two, and no task sorts. As twice a number that is left
    out would leave over `most` rows, such a number is below 2 in `most` of the sum.
    """
    scale = F.floor(F.log2(number))
    sizes = counts.filter(F.col(number) > 0).groupBy(scale.alias("scale")).agg(F.count("*").alias("n")).orderBy(F.desc("scale")).collect()
    held, least = 0, None
    for r in sizes:
        held += r["n"]
        if held > most:
            break
        least = r["scale"]
    return counts.limit(0) if least is None else counts.filter(F.col(number) >= 2**least)


def looked_up(rows: DataFrame, table: DataFrame, key: str, keep: Keep, most: int = 4096, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with a table of unique keys; rows whose key it lacks have nulls.

    Frequent keys of rows, `most` at most, are kept and broadcast with their entries; any other key
    has below 2 in `most` rows and is joined by a shuffle. counts (key, _n) says how often each key
    occurs; without it rows are read once more, and the counts added up before they are shuffled. Null
    keys find nothing and are not shuffled.
    """
    if counts is None:
        counts = keep(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")))
    often = frequent(counts.filter(F.col(key).isNotNull()), "_n", most).select(key)
    heavy = keep(often.join(table, key, "left").withColumn("_often", F.lit(True)))
    marked = rows.join(F.broadcast(heavy), key, "left")
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    settled = marked.filter(F.col("_often") | F.col(key).isNull()).select(*columns)
    rest = marked.filter(F.col("_often").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return settled.unionByName(rest.join(table, key, "left").select(*columns))
