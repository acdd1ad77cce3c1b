"""A next-token model that is fitted in epochs: interpolation weights by expectation maximisation, stopped early.

The model mixes a bigram, a unigram and a uniform distribution. Counts come from one part of the
train split, weights are fitted on its other part and scored on the validation split after each
epoch. Pairs are counted once and written to the shared folder; an epoch is two aggregates over
them, and its state is three numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import pairs_of

PARTS = ["uniform", "unigram", "bigram"]
HISTORY = "epoch int, phase string, loss double, tokens long, uniform double, unigram double, bigram double"


class Settings(NamedTuple):
    epochs: int = 50
    min_delta: float = 1e-4
    patience: int = 8


def pair_table(sequences: DataFrame, tuning: Column, train: str = "train", validation: str = "validation", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(n_tune, n_valid, uniform, unigram, bigram) of each distinct pair that is tuned or validated on.

    sequences holds (split, tokens) and what tuning asks; train sequences for which tuning is
    true are kept from the counts. uniform is 1 over the number of tokens that follow another
    anywhere. A pair or token that the counts lack has 0 there. keep may write the counted pairs and read
    them back, as totals and pairs ask for different counts and would each deal all pairs again.
    """
    part = F.when((F.col("split") == train) & tuning, "tune").when(F.col("split") == train, "count").when(F.col("split") == validation, "valid")
    rows = pairs_of(sequences.withColumn("sequence_id", part).filter("sequence_id IS NOT NULL"))
    of = lambda name: F.count_if(F.col("sequence_id") == name).alias(f"n_{name}")
    counted = keep(rows.groupBy(F.col("input").alias("prev"), F.col("target").alias("next")).agg(of("count"), of("tune"), of("valid")))
    before = counted.groupBy("prev").agg(F.sum("n_count").alias("n_prev"))
    after = counted.groupBy("next").agg(F.sum("n_count").alias("n_next"))
    size = after.agg(F.sum("n_next").alias("n_all"), F.count("*").alias("n_tokens"))
    asked = counted.filter("n_tune + n_valid > 0").join(before, "prev").join(after, "next").crossJoin(F.broadcast(size))  # size is one row
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return asked.select("n_tune", "n_valid", (1.0 / F.col("n_tokens")).alias("uniform"), share("n_next", "n_all").alias("unigram"), share("n_count", "n_prev").alias("bigram"))


def _mixed(weights: list[float]) -> Column:
    return sum((F.col(p) * w for p, w in zip(PARTS, weights, strict=True)), F.lit(0.0))


def epoch_of(table: DataFrame, weights: list[float]) -> tuple[list[float], float | None, int]:
    """The weights after one epoch, and the loss and tokens of the tuning part under those before it."""
    mixed = _mixed(weights)
    shares = [F.sum(F.col("n_tune") * F.col(p) * w / mixed) for p, w in zip(PARTS, weights, strict=True)]
    *got, loss, n = table.agg(*shares, F.sum(-F.ln(mixed) * F.col("n_tune")), F.sum("n_tune")).first()
    return ([x / n for x in got], loss / n, n) if n else (weights, None, 0)


def validation_of(table: DataFrame, weights: list[float]) -> tuple[float | None, int]:
    loss, n = table.agg(F.sum(-F.ln(_mixed(weights)) * F.col("n_valid")), F.sum("n_valid")).first()
    return (loss / n if n else None), n or 0


def fit(spark: SparkSession, table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """HISTORY of a fit on a pair_table: a train and a validation row an epoch, with the weights after it.

    It stops after settings.epochs, or once `patience` epochs in a row are not better than the
    best one by more than min_delta. Without tokens to tune or to validate on there are no epochs.
    """
    weights, best, without, rows = [1 / 3] * 3, None, 0, []
    for epoch in range(1, settings.epochs + 1):
        weights, loss, n = epoch_of(table, weights)
        found, m = validation_of(table, weights)
        if loss is None or found is None:
            break
        rows += [(epoch, "train", loss, n, *weights), (epoch, "validation", found, m, *weights)]
        better = best is None or found < best - settings.min_delta
        best, without = (found, 0) if better else (best, without + 1)
        if without >= settings.patience:
            break
    return spark.createDataFrame(rows, HISTORY)


def fitted(sequences: DataFrame, tuning: Column, settings: Settings = Settings(), stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """HISTORY of sequences (split, tokens); stage writes the pairs to the shared folder, so epochs don't count again."""
    return fit(sequences.sparkSession, stage(pair_table(sequences, tuning, keep=stage)), settings)


def phase_losses(history: DataFrame) -> DataFrame:
    """(run_id, epoch, validation_loss, tokens) of a history's validation rows, as early_stopping and history_audit take it."""
    return history.filter("phase = 'validation'").select(F.lit(1).alias("run_id"), "epoch", F.col("loss").alias("validation_loss"), "tokens")


def history_scalars(history: DataFrame) -> DataFrame:
    """(tag, epoch, value): loss and perplexity by phase, and the weights once an epoch."""
    told = history.withColumn("perplexity", F.exp(F.least("loss", F.lit(50.0)))).unpivot(["epoch", "phase"], ["loss", "perplexity", *PARTS], "name", "value")
    tag = F.when(F.col("name").isin(*PARTS), F.concat_ws("/", F.lit("weights"), "name")).otherwise(F.concat_ws("/", "name", "phase"))
    return told.filter(~F.col("name").isin(*PARTS) | (F.col("phase") == "train")).select(tag.alias("tag"), "epoch", "value").filter("value IS NOT NULL")
