"""Token sequences: vocabulary, pairs, batches, bigram scores and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .ranks import Keep, frequent, global_rank, looked_up

#: Entries of a look-up that are broadcast, a few MB.
MOST = 65_536


def vocabulary(words: DataFrame, keep: Keep) -> DataFrame:
    """(token, id): the rank of each distinct token in binary order."""
    return global_rank(words.select("token").distinct(), ["token"], keep, "id")


def token_counts(words: DataFrame) -> DataFrame:
    """(token, _n): how often each token occurs, which vocabulary, ids_of and texts_of can share."""
    return words.groupBy("token").agg(F.count("*").alias("_n"))


def ids_of(words: DataFrame, tokens: DataFrame, keep: Keep, counts: DataFrame | None = None) -> DataFrame:
    """words with the id of each token in (token, id), null where it is unknown; frequent tokens are not shuffled."""
    return looked_up(words, tokens, "token", keep, MOST, counts)


def texts_of(ids: DataFrame, tokens: DataFrame, keep: Keep, counts: DataFrame | None = None) -> DataFrame:
    """Rows of ids with their tokens, the way back of ids_of."""
    return looked_up(ids, tokens, "id", keep, MOST, counts)


def pairs_of(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(sequence_id, pos, input, target) of neighbours in arrays of tokens; nothing is shuffled."""
    rows = sequences.select("sequence_id", F.posexplode(F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))).alias("input"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("target"))).alias("pos", "x"))
    return rows.select("sequence_id", F.col("pos").cast("long").alias("pos"), "x.input", "x.target")


def next_token_pairs(words: DataFrame) -> DataFrame:
    """As pairs_of, from one row a token; these are dealt by sequence."""
    target = F.lead("token").over(Window.partitionBy("sequence_id").orderBy("pos"))
    return words.select("sequence_id", "pos", F.col("token").alias("input"), target.alias("target")).filter("target IS NOT NULL")


def bigram_counts(pairs: DataFrame) -> DataFrame:
    """(prev, next, n) of pairs, added up before they are shuffled."""
    return pairs.groupBy(F.col("input").alias("prev"), F.col("target").alias("next")).agg(F.count("*").alias("n"))


def bigram_scores(sequences: DataFrame, alpha: float = 1.0, tokens: str = "tokens", keep: Keep = lambda df: df) -> DataFrame:
    """ln((c + alpha) / (n + alpha V)) of every bigram that occurs in arrays of tokens.

    Tokens are counted first: how many there are, and how often each is followed by another. Bigrams of
    the most followed tokens, whose totals are broadcast, are dealt by both tokens and others by their
    first one, so totals of these are added up where they lie, no part holds a frequent
    token, and bigrams are dealt once. keep may write the counts of tokens and read them back.
    """
    at = sequences.select(F.posexplode(tokens).alias("pos", "token"), F.size(tokens).alias("size"))
    followed = keep(at.groupBy("token").agg(F.count_if(F.col("pos") < F.col("size") - 1).alias("total")))
    often = keep(frequent(followed.filter("token IS NOT NULL"), "total", 4096).select(F.col("token").alias("input"), "total"))
    size = followed.agg(F.count("token").alias("v"))
    pairs = pairs_of(sequences, tokens).filter("input IS NOT NULL").join(F.broadcast(often), "input", "left")
    dealt = pairs.withColumn("own", F.when(F.col("total").isNotNull(), F.col("target"))).repartition("input", "own")
    counts = dealt.groupBy("input", "own", "target", "total").agg(F.count("*").alias("n"))
    total = F.coalesce("total", F.sum("n").over(Window.partitionBy("input", "own")))
    scored = counts.select(F.col("input").alias("prev"), F.col("target").alias("next"), "n", total.alias("total")).crossJoin(F.broadcast(size))  # size is one row
    return scored.select("prev", "next", "n", F.round(F.ln((F.col("n") + alpha) / (F.col("total") + alpha * F.col("v"))), 6).alias("log_p"))


def lengths(words: DataFrame) -> DataFrame:
    return words.groupBy("sequence_id").agg(F.count("*").alias("n_tokens"))


def overlong(words: DataFrame, limit: int) -> DataFrame:
    return lengths(words).filter(F.col("n_tokens") > limit).agg(F.count("*").alias("n_overlong"), F.min("sequence_id").alias("first_id"))


def batch_ranks(sequences: DataFrame, size: int, keep: Keep) -> DataFrame:
    """sequences with `batch` and `place`: `size` sequences a batch in the order of sequence_id.

    Repeated ids follow each other in the order of n_tokens.
    """
    ranked = global_rank(sequences, ["sequence_id", "n_tokens"], keep, "_rank")
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).withColumn("place", (F.col("_rank") % size).cast("int")).drop("_rank")


def batch_widths(sequences: DataFrame, size: int, keep: Keep) -> DataFrame:
    """(sequence_id, batch, n_tokens, padding) from (sequence_id, n_tokens)."""
    width = F.max("n_tokens").over(Window.partitionBy("batch"))
    return batch_ranks(sequences, size, keep).select("sequence_id", "batch", "n_tokens", (width - F.col("n_tokens")).alias("padding"))


def padded_batches(sequences: DataFrame, size: int, pad: int, unknown_inputs: list[int], keep: Keep) -> DataFrame:
    """A row a sequence of (sequence_id, ids, coverage), padded to the longest of its batch of `size`.

    input_ids and target_ids are next-token pairs with pad behind; attention_mask marks what is
    real, unknown_mask real inputs among unknown_inputs in UNLABELED sequences, whose targets
    stay. pad inside a sequence is an error.
    """
    n = F.size("ids") - 1
    rows = sequences.withColumn("n_tokens", n.cast("long"))
    rows = batch_ranks(rows, size, keep).withColumn("width", F.max("n_tokens").over(Window.partitionBy("batch")).cast("int"))
    tail = F.col("width") - F.col("n_tokens").cast("int")
    real = F.transform(F.sequence(F.lit(1), F.greatest("width", F.lit(1))), lambda k: k <= F.col("n_tokens"))
    cut = lambda at: F.concat(F.slice("ids", F.lit(at), F.col("n_tokens").cast("int")), F.array_repeat(F.lit(pad), tail))
    unknown = unknown_mask(F.slice("ids", F.lit(1), F.col("n_tokens").cast("int")), F.col("coverage"), unknown_inputs)
    whole = F.when(F.array_contains("ids", pad), F.raise_error(F.concat(F.lit("pad inside sequence "), F.col("sequence_id").cast("string"))).cast("array<int>")).otherwise(cut(1))
    return rows.select(
        "sequence_id", "batch", "place", F.col("n_tokens").alias("length"), whole.alias("input_ids"), cut(2).alias("target_ids"), F.slice(real, F.lit(1), F.col("width")).alias("attention_mask"),
        F.concat(unknown, F.array_repeat(F.lit(False), tail)).alias("unknown_mask"),
    )


def unknown_mask(inputs: Column, coverage: Column, unknown_inputs: list) -> Column:
    """Which inputs are among unknown_inputs, where the sequence is UNLABELED; none where it is not."""
    return F.transform(inputs, lambda x: (coverage == "UNLABELED") & x.isin(unknown_inputs))


def scored(predictions: DataFrame, excluded: list[int], types: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Per-row measures: full and objective loss, and hits in the top 1 and k.

    With types (id, type) of the vocabulary, also the target's type and whether the argmax has
    it; they are broadcast, a row for each logit at most. An id without a type has none that agrees.
    """
    logits = F.transform("logits", lambda x: x.cast("double"))
    rows = predictions.withColumn("logits", logits)
    best = scalars.argmax(F.col("logits"))
    measured = rows.select(
        "row_id", "target", "unknown", best.alias("best"),
        scalars.nll(F.col("logits"), F.col("target")).alias("full_nll"),
        scalars.restricted_nll(F.col("logits"), F.col("target"), F.col("unknown"), excluded).alias("objective_nll"),
        (best == F.col("target")).alias("top1"),
        scalars.topk_hit(F.col("logits"), F.col("target"), k).alias("topk"),
    )
    if types is None:
        return measured.drop("best")
    own = F.broadcast(types.select(F.col("id").alias("target"), "type"))
    other = F.broadcast(types.select(F.col("id").alias("best"), F.col("type").alias("best_type")))
    typed = measured.join(own, "target", "left").join(other, "best", "left")
    return typed.withColumn("type_top1", F.coalesce(F.col("best_type") == F.col("type"), F.lit(False))).drop("best", "best_type")


def _measures() -> list[Column]:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    full, own = F.avg("full_nll"), F.avg("objective_nll")
    return [
        F.count("row_id").alias("tokens"), F.round(full, 6).alias("full_nll"), F.round(own, 6).alias("objective_nll"),
        F.when(own.isNotNull(), F.round(scalars.perplexity(own), 4)).alias("perplexity"), rate("top1").alias("top1"), rate("topk").alias("top5"), rate("type_top1").alias("type_top1"),
    ]


def token_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Token-weighted measures of scored rows with types; nulls where there is no row."""
    return rows.groupBy(*by).agg(*_measures())


def metrics_by_type(rows: DataFrame, types: DataFrame) -> DataFrame:
    """(scope, type, measures): of all rows, of each type of the vocabulary, and of unknown positions.

    One pass with grouping sets; every type is there, and the unknown slice too, with no tokens
    and null measures where nothing falls on it.
    """
    slices = rows.select("row_id", "full_nll", "objective_nll", "top1", "topk", "type_top1", "type", F.when(F.col("unknown"), True).alias("unknown"))
    cube = slices.groupingSets([[F.col("type")], [F.col("unknown")], []], F.col("type"), F.col("unknown")).agg(F.grouping_id("type", "unknown").alias("level"), *_measures())
    scope = F.when(F.col("level") == 1, "type").when(F.col("level") == 2, "unknown").otherwise("all")
    kept = cube.filter("level = 3 OR (level = 1 AND type IS NOT NULL) OR (level = 2 AND unknown)").select(scope.alias("scope"), F.coalesce("type", F.lit("")).alias("type"), *[c for c in cube.columns if c not in ("type", "unknown", "level")])
    named = types.select(F.lit("type").alias("scope"), "type").distinct()
    every = named.union(rows.sparkSession.createDataFrame([("all", ""), ("unknown", "")], "scope string, type string"))
    # a row a type
    return kept.join(F.broadcast(every), ["scope", "type"], "right").fillna(0, ["tokens"])


def nucleus(logits: DataFrame, top_p: float) -> DataFrame:
    """Ids kept by top-p: in falling order, those before which the mass is below p. One pass over each row's array."""
    x = F.transform("logits", lambda v: v.cast("double"))
    mass = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v))
    # falling by value; of equal values the lower id first
    order = F.array_sort(F.transform("x", lambda v, i: F.struct((-v).alias("neg"), i.alias("id"))))
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("kept"), F.lit(0).cast("long").alias("n"))

    def step(a, s):
        p, inside = F.exp(-s["neg"]) / F.col("z"), a["before"] < top_p - 1e-9
        return F.struct((a["before"] + p).alias("before"), F.when(inside, a["kept"] + p).otherwise(a["kept"]).alias("kept"), (a["n"] + inside.cast("long")).alias("n"))

    rows = logits.withColumn("x", x).withColumn("z", mass).withColumn("f", F.aggregate(order, zero, step))
    return rows.select("row_id", F.col("f.n").alias("n_kept"), F.round("f.kept", 6).alias("mass"))


def epoch_loss(history: DataFrame) -> DataFrame:
    """(run_id, tokens, loss): the mean loss of a run's tokens."""
    return history.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("validation_loss") * F.col("tokens")) / F.sum("tokens")).alias("loss"))
