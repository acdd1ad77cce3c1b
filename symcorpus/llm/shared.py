"""What the operators of this subpackage share: reading, cutting lineage, keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that part words: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, as in tests, a folder in the warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps survive lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order; an empty array where there is none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def n_words_of(text: Column) -> Column:
    """The number of words, without an array of them where the text has none."""
    return F.size(words_of(text)).cast("long")


def content_keys(text: Column) -> list[Column]:
    """Two longs (128 bits of MD5) that stand for a whole text."""
    digest = F.md5(text)
    return [
        F.xxhash64(F.substring(digest, 1, 16)).alias("k1"),
        F.xxhash64(F.substring(digest, 17, 16)).alias("k2"),
    ]


#: Keys of a list that is broadcast, at most.
HEAVY = 2_000
#: Rows that a heavy key has, at least.
LEAST_ROWS = 256
#: Rows of the sample that finds frequent keys, about. It only spreads work: results do not depend on it.
SAMPLE_ROWS = 200_000


def heaviest(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The HEAVY keys of the largest counts above LEAST_ROWS; any other key has at most 1 in HEAVY of all rows."""
    return counts.filter(F.col(n) > LEAST_ROWS).orderBy(F.desc(n), *keys).limit(HEAVY).select(*keys)


def frequent(rows: DataFrame, keys: list[str], least: int = 2, part: float | None = None) -> DataFrame:
    """At most HEAVY keys that about `least` rows have, and two surely; found in a sample of SAMPLE_ROWS rows.

    Where rows are a sample already, part says of how much.
    """
    if part is None:
        part = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
        rows = rows if part == 1 else rows.sample(part, 7)
    some = rows.select(*keys)
    counts = some.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= max(2, round(least * part)))
    return saved(counts.orderBy(F.desc("__n"), *keys).limit(HEAVY).select(*keys), "frequent")


def repeated_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys another row has too. Those of frequent keys are known to, and meet in no task."""
    hot = F.broadcast(frequent(rows, keys).withColumn("__hot", F.lit(True)))
    tagged = rows.join(hot, keys, "left")
    rest = tagged.filter("__hot IS NULL").withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n > 1")
    return tagged.filter("__hot").select(*rows.columns).unionByName(rest.select(*rows.columns))


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """left with `found`, a struct of the other columns of the row of right that has its keys; null where none has.

    right holds keys once, the first of them a long. Rows of heavy keys (a bounded list) find
    theirs in a broadcast table and are dealt out evenly, so that no task gets all of a key.
    """
    more = F.struct(*[c for c in right.columns if c not in keys])
    hot = right.join(F.broadcast(heavy), keys, "left_semi").select(*keys, more.alias("__hot"))
    light = right.select(*[F.col(k).alias(f"__{k}") for k in keys], more.alias("__light"))
    spread = F.when(F.col("__hot").isNull(), F.col(keys[0])).otherwise(F.monotonically_increasing_id())
    tagged = left.join(F.broadcast(hot), keys, "left").withColumn("__first", spread)
    same = (F.col("__first") == F.col(f"__{keys[0]}")) & F.col("__hot").isNull()
    for k in keys[1:]:
        same &= F.col(k) == F.col(f"__{k}")
    return tagged.join(light, same, "left").select(*left.columns, F.coalesce("__hot", "__light").alias("found"))


def largest(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of the largest sizes, `most` at most; sizes within an eighth of a doubling go together.

    Rows are counted by steps of size (some hundreds at most, which the driver reads), so no
    task and no list of each task's own largest is sorted. Sizes below 1 are left out.
    """
    step = F.floor(F.log2(size.cast("double")) * 8)
    kept = rows.filter(size >= 1)
    total, low = 0, None
    for at, n in kept.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += n
        if total > most:
            break
        low = at
    return kept.filter(step >= low) if low is not None else kept.limit(0)


def among(rows: DataFrame, keys: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """rows without those whose key is surely not in keys; some others may stay. Saves moving rows that a join would drop.

    keys are hashed to 2 ** bits bits, held as longs in a broadcast table: 2 ** (bits - 6)
    rows at most, however many keys there are.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    one = F.expr("shiftleft(1L, CAST(__at & 63 AS INT))")
    held = keys.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    asked = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6))
    return asked.join(F.broadcast(held), "__word").filter(F.col("__bits").bitwiseAND(one) != 0).drop("__word", "__bits", "__at")


def freed(*frames: DataFrame) -> None:
    """Empties the folders of saved tables that nothing reads any more."""
    for df in frames:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.saved_at)
