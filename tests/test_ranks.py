"""Ranks over whole tables and look-ups against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from symcorpus.operators import ranks, sequences
from symcorpus.sources import runs


def test_ranks_of_one_long_prefix(spark):
    names = ["common/root/of/every/file/in/the/corpus/" + str(random.Random(k).random()) for k in range(5000)]
    frame = spark.createDataFrame([(x,) for x in names], "path string")
    got = {r["path"]: r["rank"] for r in ranks.global_rank(frame, ["path"], runs.staged).collect()}
    assert got == {x: i for i, x in enumerate(sorted(names))}


def test_no_part_holds_a_prefix_or_a_frequent_key(spark):
    kept = []

    def keep(rows):
        kept.append(runs.staged(rows))
        return kept[-1]

    frame = spark.range(8000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("key"), "id")
    got = [r["rank"] for r in ranks.global_rank(frame, ["key"], keep).collect()]
    assert sorted(got) == list(range(8000))
    assert max(r["count"] for r in kept[0].groupBy("_part").count().collect()) < 8000 / 8 * 1.6  # a third of all rows share a key


def test_ranks_of_ties_nulls_and_nothing(spark):
    frame = spark.createDataFrame([("b",), (None,), ("a",), ("a",), (None,)], "x string")
    got = [(r["rank"], r["x"]) for r in ranks.global_rank(frame, ["x"], runs.staged).orderBy("rank").collect()]
    assert got == [(0, None), (1, None), (2, "a"), (3, "a"), (4, "b")]
    assert ranks.global_rank(frame.limit(0), ["x"], runs.staged).count() == 0


def test_look_ups_of_frequent_rare_and_unknown_keys(spark):
    tokens = [random.Random(k).choice(["the"] * 50 + ["of"] * 20 + [f"w{k % 90}", None, "unknown"]) for k in range(3000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "at int, token string")
    words = ["of", "the", *[f"w{k}" for k in range(90)]]
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, id long")
    wanted = Counter((k, t, words.index(t) if t in words else None) for k, t in enumerate(tokens))
    for most in (1, 3, 4096):
        assert Counter(map(tuple, ranks.looked_up(rows, table, "token", runs.staged, most).collect())) == wanted
    back = sequences.texts_of(sequences.ids_of(rows, table, runs.staged).select("at", "id"), table, runs.staged)
    assert {r["at"]: r["token"] for r in back.collect()} == {k: t if t in words else None for k, t in enumerate(tokens)}
    assert ranks.looked_up(rows.limit(0), table, "token", runs.staged).count() == 0


def test_vocabulary_is_in_binary_order(spark):
    words = ["é", "z", "Z", "", "aa", "a", "a", "日", "\U0001f600"]
    got = sequences.vocabulary(spark.createDataFrame([(w,) for w in words], "token string"), runs.staged).orderBy("id").collect()
    assert [r["token"] for r in got] == sorted(set(words), key=lambda w: w.encode())
    assert [r["id"] for r in got] == list(range(8))
