"""Parts that several readers share are written once, and give what they give unwritten."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from symcorpus.operators import fitting

@pytest.fixture()
def kept(spark, tmp_path):
    """A function that writes rows and reads them back, and the plans it was given."""
    plans = []

    def keep(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        place = str(tmp_path / uuid.uuid4().hex)
        rows.write.parquet(place)
        return spark.read.schema(rows.schema).parquet(place)

    return keep, plans


def nodes(plan, name):
    return len(re.findall(rf"^[\s:+|-]*{name}\b", plan, re.M))


def test_pairs_are_counted_once(spark, kept):
    keep, plans = kept
    texts = [(i, "validation" if i % 4 == 3 else "train", f"a b c a b {'abc'[i % 3]} d{i % 5}") for i in range(40)]
    frame = spark.createDataFrame(texts, "source_id long, split string, text string").select("source_id", "split", F.split("text", " ").alias("tokens"))
    plain, once = (fitting.pair_table(frame, F.col("source_id") % 5 == 0, **more) for more in ({}, {"keep": keep}))
    assert len(plans) == 1 and nodes(once._jdf.queryExecution().optimizedPlan().toString(), "Generate") == 0
    rows = sorted(map(tuple, once.collect()))
    assert rows and rows == sorted(map(tuple, plain.collect()))


def test_wheels_are_scaled_once(spark, kept):
    from symcorpus.operators import stages

    keep, plans = kept
    notes = spark.createDataFrame([(1, 0, 10, 20, 60, 90, 1), (1, 0, 30, 40, 62, 90, 2), (2, 0, 5, 9, 50, 80, 3)], "source_id long, instrument_index int, onset_tick long, end_tick long, pitch int, velocity int, seq long")
    bends = spark.createDataFrame([(1, 4, 100, 1), (1, 35, -50, 2), (2, 6, 8000, 3)], "source_id long, tick long, value int, seq long")
    ranges = spark.createDataFrame([(1, 2.0), (2, 12.0)], "source_id long, bend_range double")
    plain, once = (stages.normalized(notes, bends, ranges, **more) for more in ({}, {"stage": keep}))
    assert sum("Window" in p for p in plans) == 1
    assert not any(nodes(x._jdf.queryExecution().optimizedPlan().toString(), "Window") for x in once)
    for a, b in zip(plain, once):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []


def test_streams_are_wrapped_once(spark, kept):
    from symcorpus.operators import tokens

    keep, plans = kept
    rows = [(s, 0, k, x) for s in (1, 2) for k, x in enumerate(["Bar_None", "Position_0", "Pitch_60", "Duration_0.1.24", "Bar_None"][: 3 + s])]
    frame = spark.createDataFrame(rows, "source_id long, phrase_index long, pos long, token string")
    labels = spark.createDataFrame([(1, "C", "MAJOR"), (2, "D", "MINOR")], "source_id long, tonic string, mode string")
    plain, once = (tokens.tokenized(frame, labels, 8, *more) for more in ((), (keep,)))
    assert len(plans) == 1
    assert not any(nodes(x._jdf.queryExecution().optimizedPlan().toString(), "Join Inner") for x in once)
    for a, b in zip(plain, once):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
