"""Content groups and leakage-free splits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def fingerprint(sources: DataFrame, content: str = "content") -> DataFrame:
    return sources.withColumn("sha256", F.sha2(content, 256)).withColumn("size_bytes", F.octet_length(content).cast("long"))


def content_groups(sources: DataFrame) -> DataFrame:
    """Every source with the number of sources of equal content; counted before it is joined back."""
    return sources.join(sources.groupBy("sha256").agg(F.count("*").alias("group_size")), "sha256")


def allocate_splits(n: int, ratios: tuple[float, ...] = (0.8, 0.1, 0.1)) -> list[int]:
    """Counts by largest remainder; every split with a positive ratio gets one where n allows.

    The j-th unit of a split is worth its exact share less j, and the n units of most worth are
    taken. Where a split gets none, it takes the unit of least worth of the others, that of
    the larger split where two are worth as much.
    """
    wanted = [k for k, r in enumerate(ratios) if r > 0]
    if n < len(wanted):
        return [int(k in wanted[:n]) for k in range(len(ratios))]
    exact = [n * r / sum(ratios) for r in ratios]
    sure = [max(0, int(x) - len(wanted)) if x > 0 else 0 for x in exact]  # units that no rule can take away
    units = [(exact[k] - j, k, j) for k in wanted for j in range(sure[k], int(exact[k]) + 2)]
    taken = sorted(units, key=lambda u: (-u[0], u[1]))[: n - sum(sure)]
    counts = [sure[k] + sum(u[1] == k for u in taken) for k in range(len(ratios))]
    without = [k for k in wanted if not counts[k]]
    spare = sorted((u for u in taken if u[2]), key=lambda u: (u[0], -counts[u[1]], u[1]))[: len(without)]
    moved = [k for _, k, _ in spare]
    return [c - moved.count(k) + (k in without) for k, c in enumerate(counts)]


def assign_splits(sources: DataFrame, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), seed: str = "0") -> DataFrame:
    """Every source with a split, the same for equal content and for any input order.

    Groups are ranked by a seeded hash, so a split is a range of hashes. The sizes of the 4,096
    prefixes of hashes say in which prefix a split ends, and the hashes of that prefix alone are
    ordered. The driver holds these sizes and the two ends; each row compares its own hash with
    the ends, so no row is shuffled. A source without a hash has no split, and its group, the last, counts.
    """
    mark = F.sha2(F.concat(F.lit(seed), "sha256"), 256)
    groups = sources.select("sha256").distinct().withColumn("mark", mark).withColumn("prefix", F.substring("mark", 1, 3))
    sizes = {r["prefix"]: r["n"] for r in groups.groupBy("prefix").agg(F.count("*").alias("n")).collect()}
    counts = allocate_splits(sum(sizes.values()), ratios)
    places = [_place(sizes, sum(counts[: k + 1])) for k in range(2)]
    ends = [None, None]
    if any(places):
        held = groups.filter(F.col("prefix").isin([p[0] for p in places if p]))
        nth = lambda prefix, k: F.get(F.sort_array(F.collect_list(F.when(F.col("prefix") == prefix, F.col("mark")))), F.lit(k))
        ends = list(held.agg(*[nth(*p).alias(f"end_{k}") if p else F.lit(None).alias(f"end_{k}") for k, p in enumerate(places)]).first())
    split = F.when(mark <= F.lit(ends[0] or ""), SPLITS[0]).when(mark <= F.lit(ends[1] or ""), SPLITS[1]).otherwise(SPLITS[2])
    return sources.filter("sha256 IS NOT NULL").select("sha256", *[c for c in sources.columns if c != "sha256"], split.alias("split"))


def _place(sizes: dict[str | None, int], rank: int) -> tuple[str, int] | None:
    """The prefix that holds the group of a rank, counted from 1, and its place there, counted from 0; a rank past the last is the last, none is before the first."""
    known = sorted(p for p in sizes if p is not None)
    rank = min(rank, sum(sizes[p] for p in known))
    for p in known if rank > 0 else []:
        if rank <= sizes[p]:
            return p, rank - 1
        rank -= sizes[p]
    return None


def split_leakage(sources: DataFrame) -> DataFrame:
    return sources.groupBy("sha256").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def corpus_summary(sequences: DataFrame) -> DataFrame:
    """Counts and lengths by split and over all (split null), from rows (split, n_tokens)."""
    measured = sequences.groupingSets([["split"], []], "split").agg(
        F.count("*").alias("sequences"), F.sum("n_tokens").alias("total_tokens"), F.min("n_tokens").alias("min_tokens"),
        F.max("n_tokens").alias("max_tokens"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"),
    )
    return measured


def run_id(sources: DataFrame, label: str = "path", sha: str = "sha256") -> DataFrame:
    """Twenty hex digits that stand for all (label, hash) rows in any order; hashed by prefix, then over prefixes."""
    row = F.sha2(F.to_json(F.struct(F.col(label).alias("label"), F.col(sha).alias("sha256"))), 256)
    rows = sources.select(row.alias("h")).withColumn("prefix", F.substring("h", 1, 3))
    parts = rows.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "d"))), lambda x: x["d"]), ""), 256), 1, 20).alias("run_id"))


def canonical_run_id(sources: DataFrame, configuration: dict) -> DataFrame:
    """Twenty hex digits of a configuration and of all (path, sha256, sidecar hash) rows in any order.

    The configuration (settings, schema and tool versions) counts as JSON with sorted keys and
    no blanks. Rows are hashed by prefix and then over prefixes, as in run_id.
    """
    row = F.to_json(F.struct(F.col("path").alias("label"), "sha256", F.coalesce("sidecar", F.lit("null")).alias("sidecar")))
    rows = sources.select(F.sha2(row, 256).alias("h")).withColumn("prefix", F.substring("h", 1, 3))
    parts = rows.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "d"))), lambda x: x["d"]), ""), 256)
    told = json.dumps(configuration, sort_keys=True, separators=(",", ":"))
    return parts.agg(F.substring(F.sha2(F.concat(F.lit(told), whole), 256), 1, 20).alias("run_id"))


def snapshot_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that were added, removed or changed between two tables (key, sha256)."""
    a, b = before.select("key", F.col("sha256").alias("was")), after.select("key", F.col("sha256").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, "key", "full_outer").select("key", status.alias("status")).filter("status IS NOT NULL")
