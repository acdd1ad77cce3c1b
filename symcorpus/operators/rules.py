"""Contracts, comparisons and chains over sources, fragments and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import next_token_pairs, pairs_of

SPLITS = ("train", "validation", "test")


def key_set_diff(rows: DataFrame, column: str, required: list[str]) -> DataFrame:
    """Keys that a JSON object lacks and keys that it should not have, both sorted; no object lacks them all."""
    held = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, required))
    return rows.withColumn("missing", F.array_sort(F.array_except(wanted, held))).withColumn("unknown", F.array_sort(F.array_except(held, wanted)))


def read_annotations(rows: DataFrame, column: str, schema: str, limit: int) -> DataFrame:
    """JSON as a record; valid says that it is within the size limit and holds exactly the fields, none of them null."""
    names = [field.split()[0] for field in schema.split(",")]
    parsed = rows.withColumn("record", F.from_json(column, schema))
    exact = F.array_sort(F.json_object_keys(column)) == F.array(*map(F.lit, sorted(names)))
    whole = reduce(lambda a, b: a & b, [F.col(f"record.{n}").isNotNull() for n in names])
    return parsed.withColumn("valid", F.coalesce(exact & whole & (F.octet_length(column) <= limit), F.lit(False)))


def broken_rules(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """A row for each rule that a row breaks."""
    names = F.array(*[F.when(bad, F.lit(name)) for bad, name in rules])
    return rows.withColumn("rule", F.explode(F.filter(names, lambda x: x.isNotNull())))


def variants(fragments: DataFrame, low: int, high: int) -> DataFrame:
    return fragments.withColumn("semitones", F.explode(F.sequence(F.lit(low), F.lit(high))))


def empty_ranges(notes: DataFrame, ranges: DataFrame, durations: DataFrame, cell: int = 1440) -> DataFrame:
    """Ranges that no onset hits, or that end after their source; joined by cells of ticks."""
    once = ranges.select("source_id", "start_tick", "end_tick").distinct()
    cells = F.explode(F.sequence(F.floor(F.col("start_tick") / cell), F.floor((F.col("end_tick") - 1) / cell)))
    onsets = notes.select("source_id", "onset_tick", F.floor(F.col("onset_tick") / cell).alias("cell"))
    hit = once.withColumn("cell", cells).join(onsets, ["source_id", "cell"]).filter("start_tick <= onset_tick AND onset_tick < end_tick").select("source_id", "start_tick", "end_tick").distinct()
    marked = once.join(hit.withColumn("hit", F.lit(True)), ["source_id", "start_tick", "end_tick"], "left").join(durations, "source_id")
    return marked.select("source_id", "start_tick", "end_tick", F.col("hit").isNull().alias("empty"), (F.col("end_tick") > F.col("fin")).alias("beyond"))


def map_notes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Notes before and after a change of timing, paired by rank within their pitch; a missing partner is null."""
    rank = F.row_number().over(Window.partitionBy("source_id", "pitch").orderBy("onset_tick", "end_tick", "velocity", "seq"))
    ranked = lambda d, name: d.select("source_id", "pitch", rank.alias("rank"), F.col("seq").alias(name))
    return ranked(before, "before_seq").join(ranked(after, "after_seq"), ["source_id", "pitch", "rank"], "full_outer").select("source_id", "before_seq", "after_seq")


def compare_summary(declared: DataFrame, own: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Every measure of two summaries side by side; a measure that one lacks is not equal."""
    names = [c for c in declared.columns if c != key]
    flat = lambda d, value: d.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([key], names, "metric", value)
    both = flat(declared, "a").join(flat(own, "b"), [key, "metric"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return both.select(key, "metric", same.alias("equal"))


def provenance(sources: DataFrame) -> DataFrame:
    """One row that stands for a table of sources in any order."""
    mark = lambda c: F.sum(F.xxhash64("source_id", c).cast("decimal(38,0)")).cast("string")
    return sources.agg(F.count("*").cast("string").alias("sources"), mark("path").alias("paths"), mark("sha256").alias("hashes"))


def provenance_match(one: DataFrame, other: DataFrame) -> DataFrame:
    flat = lambda d, value: d.unpivot([], d.columns, "field", value)
    return flat(one, "a").join(flat(other, "b"), "field").select("field", F.col("a").eqNullSafe(F.col("b")).alias("equal"))


def ordered_check(records: DataFrame) -> DataFrame:
    """Records (source_id, key) whose key is below that of the record before; numbers are joined, so no task sorts all."""
    before = records.select((F.col("source_id") + 1).alias("source_id"), F.col("key").alias("before"))
    return records.join(before, "source_id").filter("key < before").select("source_id")


def objective_rows(predictions: DataFrame, pad: int, prompt: list[int]) -> DataFrame:
    """Rows that count in measures: neither padding nor prompt targets."""
    return predictions.filter(~F.col("target").isin(pad, *prompt))


def objective_issues(predictions: DataFrame, pad: int, prompt: list[int], size: int) -> DataFrame:
    """(row_id, rule): rows that no measure may take: unknown set on padding or prompt targets, targets that are no id."""
    rules = [
        (F.col("unknown") & (F.col("target") == pad), "unknown padding"),
        (F.col("unknown") & F.col("target").isin(prompt), "unknown prompt"),
        (~F.coalesce(F.col("target").between(0, size - 1), F.lit(False)), "target outside the vocabulary"),
    ]
    return broken_rules(predictions, rules).select("row_id", "rule")


def history_audit(history: DataFrame) -> DataFrame:
    """By run: are epochs 1..n without gaps, are losses usable, the best epoch and the epochs since."""
    best = F.min(F.struct("validation_loss", "epoch"))
    finite = F.bool_and((F.col("validation_loss") >= 0) & ~F.isnan("validation_loss") & (F.col("validation_loss") < float("inf")))
    by = history.groupBy("run_id").agg(best.alias("best"), finite.alias("finite"), F.count("*").alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    return by.select("run_id", ((F.col("n") == F.col("last")) & (F.col("first") == 1)).alias("contiguous"), "finite", F.col("best.validation_loss").alias("best_loss"), F.col("best.epoch").alias("best_epoch"), (F.col("last") - F.col("best.epoch")).alias("without"))


def history_issues(history: DataFrame, declared: DataFrame, types: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(run_id, rule) of what a run declares and its history does not bear out.

    declared holds (run_id, best_epoch, best_loss, without); types holds (run_id, epoch, type,
    n, loss), whose counts must add up to the epoch's tokens and whose mean loss must agree
    with the epoch's within the tolerance.
    """
    audit = history_audit(history)
    parts = types.groupBy("run_id", "epoch").agg(F.sum("n").alias("n"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = history.join(parts, ["run_id", "epoch"], "left")
    off = rows.groupBy("run_id").agg(F.bool_or(~F.col("n").eqNullSafe(F.col("tokens"))).alias("counts"), F.bool_or(~F.coalesce(F.abs(F.col("mean") - F.col("validation_loss")) <= tolerance, F.lit(False))).alias("losses"))
    told = declared.select("run_id", F.col("best_epoch").alias("said_epoch"), F.col("best_loss").alias("said_loss"), F.col("without").alias("said_without"))
    rules = [
        (~F.col("contiguous"), "epochs with gaps"), (~F.col("finite"), "loss not finite"), (~F.col("said_epoch").eqNullSafe(F.col("best_epoch")), "best epoch differs"),
        (~F.coalesce(F.abs(F.col("said_loss") - F.col("best_loss")) <= 1e-12, F.lit(False)), "best loss differs"), (~F.col("said_without").eqNullSafe(F.col("without")), "epochs without differ"),
        (F.col("counts"), "type counts do not add up"), (F.col("losses"), "losses of types disagree"),
    ]
    return broken_rules(audit.join(off, "run_id").join(told, "run_id", "left"), rules).select("run_id", "rule")


def metric_scalars(report: DataFrame, phase: str, names: list[str]) -> DataFrame:
    """(tag, epoch, value) of a report; nulls go."""
    flat = report.select("epoch", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["epoch"], names, "name", "value")
    return flat.select(F.concat_ws("/", F.lit("metrics"), F.lit(phase), F.lit("all"), "name").alias("tag"), "epoch", "value").filter("value IS NOT NULL")


def evaluate_trained(words: DataFrame, splits: DataFrame, alpha: float = 1.0, pad: str = "", prompt: tuple[str, ...] = ()) -> DataFrame:
    """As evaluate_pairs, from one row a token (sequence_id, pos, token) and (sequence_id, split)."""
    pairs = next_token_pairs(words).join(splits, "sequence_id")
    return evaluate_pairs(pairs, words, alpha, pad, prompt)


def evaluate(sequences: DataFrame, alpha: float = 1.0, pad: str = "", prompt: tuple[str, ...] = ()) -> DataFrame:
    """As evaluate_pairs, from (split, tokens) with a sequence's tokens as an array; no token is shuffled alone."""
    own = sequences.withColumn("sequence_id", F.struct("split"))
    pairs = pairs_of(own).select(F.col("sequence_id.split").alias("split"), "input", "target")
    return evaluate_pairs(pairs, sequences.select(F.explode("tokens").alias("token")), alpha, pad, prompt)


def evaluate_pairs(pairs: DataFrame, words: DataFrame, alpha: float = 1.0, pad: str = "", prompt: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of next tokens by split under bigrams counted in the train split alone.

    Only objective rows are counted and scored. A pair that train lacks has the smoothed value;
    where train lacks the token before, all tokens are equal and the least one is the guess. Pairs are
    dealt once, to be counted; what follows a token is then added up where it lies.
    """
    pairs = objective_rows(pairs, pad, list(prompt))
    count = lambda name: F.count(F.when(F.col("split") == name, 1)).alias(name)
    counted = pairs.groupBy(F.col("input").alias("prev"), F.col("target").alias("next")).agg(*[count(x) for x in SPLITS])
    size = words.select("token").distinct().agg(F.count("token").alias("v"), F.min("token").alias("least"))
    # of a pair's loss ln(total + alpha v) - ln(train + alpha), the first part is the same for all that follow a token
    own = lambda x: F.sum(F.col(x) * F.ln(F.col("train") + alpha))
    sums = [f.alias(f"{kind}_{x}") for x in SPLITS for kind, f in (("n", F.sum(x)), ("own", own(x)), ("least", F.sum(F.when(F.col("next") == F.col("least"), F.col(x)))))]
    if alpha <= 0:  # pairs that train lacks have no loss then
        sums += [F.sum(F.when(F.col("train") > 0, F.col(x))).alias(f"known_{x}") for x in SPLITS]
    best = F.min(F.when(F.col("train") > 0, F.struct((-F.col("train")).alias("order"), "next", *SPLITS)))
    followed = counted.crossJoin(F.broadcast(size)).groupBy("prev", "v").agg(best.alias("best"), *sums)  # size is one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    loss = lambda x: zero(F.col(f"{'known' if alpha <= 0 else 'n'}_{x}") * F.ln(F.col("n_train") + alpha * F.col("v")) - F.col(f"own_{x}"))
    hits = lambda x: zero(F.when(F.col("best").isNull(), F.col(f"least_{x}")).otherwise(F.col(f"best.{x}")))
    by = F.inline(F.array(*[F.struct(F.lit(x).alias("split"), F.col(f"n_{x}").alias("n"), loss(x).cast("double").alias("nll"), hits(x).alias("top1")) for x in SPLITS]))
    rows = followed.select(by).filter("n > 0")
    mean = lambda c: F.sum(c) / F.sum("n")
    return rows.groupBy("split").agg(F.lit(1).alias("epoch"), F.sum("n").alias("tokens"), F.round(mean("nll"), 4).alias("nll"), F.round(F.exp(F.least(mean("nll"), F.lit(50.0))), 2).alias("perplexity"), F.round(mean("top1"), 6).alias("top1"))
