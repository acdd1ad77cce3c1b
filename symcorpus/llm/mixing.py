"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words_of, text_of

CYCLE = (1, 2, 3)
MOST = 3
#: Parts that rows of one source and size are dealt to, so that no run of ties is one task.
PARTS = 256
SEED = "mix-1"


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A fixed random number in [0, 1) for a source."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(source, F.lit("\0null"))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Shares are by weight; a source at most times its size is full, and what it cannot take
    goes to the others by weight. With sources in the order of size / weight the full ones
    come first, so one pass over running sums finds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("rank"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.col("rank") - 1) % len(cycle) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    total, weights = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    level = ranked.withColumn("left", total - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("open", weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = level.withColumn("full", F.col("most") * F.col("open") <= F.col("left") * F.col("weight"))
    # the first source that is not full sets the level for itself and all after it
    place = F.struct((F.col("most") / F.col("weight")).alias("ratio"), "rank")
    at = F.min_by(F.struct("left", "open"), F.when(~F.col("full"), place)).over(Window.partitionBy())
    share = F.col("weight").cast("double") * at["left"].cast("double") / at["open"].cast("double")
    return level.select("source", "source_size", "weight", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, text: str = "text", cycle: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs(doc_id, source, text) as (doc_id, source, size, source_size, target, copies, taken).

    Within a source rows are in the order of size, part_of doc_id and doc_id. Each is
    expected target / source_size times; a copy comes out for every whole number that the
    running sum of expected copies, begun at the source's offset, crosses. Close sizes are
    neighbours, so the words taken come near the target. Runs agree, as nothing depends on
    how rows are dealt. Null texts have size 0; sources of no words have target 0 and take
    no copy; a null source is a source of its own; null doc_ids come first. Repeated rows are
    rows of their own, an empty table gives none, other columns of docs are not read.
    """
    sized = docs.select("doc_id", "source", n_words_of(text_of(text)).alias("size"))
    return mix_sizes(sized, cycle, most, seed)


def mixed(docs: DataFrame, text: str = "text", cycle: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns, whatever their names.

    Copies are settled on (doc_id, source, size) and a hash of the text, which parts rows of
    equal doc_id and size alike in every run; whole rows move once, to meet their number.
    """
    k = F.xxhash64(F.md5(text_of(text)), F.col(text).isNull())
    sized = docs.select("doc_id", "source", n_words_of(text_of(text)).alias("size"), k.alias("k"))
    taken = mix_sizes(sized, cycle, most, seed, ("k",)).groupBy("doc_id", "source", "k").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    # null or not, as plain keys, so that equal rows are in one partition after the join
    keys = ["__id", "__no_id", "__source", "__no_source", "__k"]
    plain = lambda d, s, k: [F.coalesce(d, F.lit(0)).alias("__id"), d.isNull().alias("__no_id"), F.coalesce(s, F.lit("")).alias("__source"), s.isNull().alias("__no_source"), k.alias("__k")]
    counts = taken.filter("copies > 0").select(*plain(F.col("doc_id"), F.col("source"), F.col("k")), "copies", "n")
    rows = docs.select(F.struct("*").alias("row"), *plain(F.col("doc_id"), F.col("source"), k)).join(counts, keys)
    each = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select("row.*")
    alone = each(rows.filter("n = 1"), F.col("copies"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
    several = rows.filter("n > 1").withColumn("own", F.floor(F.col("copies") / F.col("n")) + (nth <= F.col("copies") % F.col("n")).cast("long"))
    return alone.union(each(several.filter("own > 0"), F.col("own")))


def part_of(doc_id: Column) -> Column:
    """One of PARTS parts of a document, by a hash of its doc_id; -1 without one."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long") % PARTS, F.lit(-1))


def mix_sizes(sized: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """As mix, from rows (doc_id, source, size); columns named in more are kept and order rows of equal doc_id."""
    rows = sized.select("doc_id", "source", "size", part_of(F.col("doc_id")).alias("part"), *more)
    counts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    # running counts in two steps: over (size, part) within a band of close sizes, then over bands
    band = F.floor(8 * F.log2(F.col("size") + 1)).cast("int")
    counts = counts.withColumn("band", band)
    inside = Window.partitionBy("source", "band").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    bands = counts.groupBy("source", "band").agg(F.sum("n").alias("n"))
    below = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(F.col("source").alias("s"), F.col("band").alias("b"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("under"))
    placed = counts.join(bands, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes, cycle, most).select(F.col("source").alias("s2"), "source_size", "target")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("s2")))
    placed = placed.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), (F.col("under") + F.col("lower")).alias("before"), "source_size", "target")
    joined = rows.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id", *more))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    ready = joined.withColumn("rank", rank.cast("double")).withColumn("each", each).withColumn("u", offset_of(F.col("source"), seed))
    copies = F.floor(F.col("rank") * F.col("each") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("each") + F.col("u"))
    ready = ready.withColumn("copies", copies.cast("long"))
    return ready.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)
