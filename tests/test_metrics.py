"""Measures by type against a plain loop, with types that no target has."""

import math

import pytest

from symcorpus.operators import sequences

TYPES = [(0, "Special"), (1, "Bar"), (2, "Pitch"), (3, "Pitch"), (4, "Technique")]
ROWS = [(1, 1, False, [0.0, 2.0, 1.0, 0.0, 0.5]), (2, 2, True, [0.0, 0.0, 1.0, 3.0, 5.0]), (3, 3, False, [9.0, 0.0, 1.0, 2.0, 0.0]), (4, 2, True, [0.0, 0.0, 4.0, 1.0, 0.0])]


def frames(spark, rows=ROWS):
    return spark.createDataFrame(rows, "row_id long, target int, unknown boolean, logits array<float>"), spark.createDataFrame(TYPES, "id int, type string")


def test_measures_by_type_keep_zeros_and_the_unknown_slice(spark):
    predictions, types = frames(spark)
    got = {(r["scope"], r["type"]): r for r in sequences.metrics_by_type(sequences.scored(predictions, [4], types), types).collect()}
    nll = lambda x, t, out=(): math.log(sum(math.exp(v) for i, v in enumerate(x) if i not in out)) - x[t]
    assert {k: r["tokens"] for k, r in got.items()} == {("all", ""): 4, ("unknown", ""): 2, ("type", "Special"): 0, ("type", "Bar"): 1, ("type", "Pitch"): 3, ("type", "Technique"): 0}
    pitch = [(t, u, x) for _, t, u, x in ROWS if t in (2, 3)]
    assert got["type", "Pitch"]["full_nll"] == pytest.approx(sum(nll(x, t) for t, _, x in pitch) / 3, abs=1e-6)
    own = sum(nll(x, t, (4,) if u else ()) for t, u, x in pitch) / 3
    assert got["type", "Pitch"]["objective_nll"] == pytest.approx(own, abs=1e-6) and got["type", "Pitch"]["perplexity"] == pytest.approx(math.exp(own), abs=1e-4)
    assert got["type", "Pitch"]["type_top1"] == pytest.approx(1 / 3, abs=1e-6) and got["unknown", ""]["top1"] == 0.5
    assert got["type", "Special"]["full_nll"] is None and got["type", "Bar"]["top1"] == 1.0


def test_no_rows_have_every_scope(spark):
    predictions, types = frames(spark, [])
    rows = sequences.metrics_by_type(sequences.scored(predictions, [4], types), types).collect()
    assert len(rows) == 6 and {r["tokens"] for r in rows} == {0}
