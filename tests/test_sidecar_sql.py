"""Queries of sidecars against their SQL, where sources repeat notes or have no text."""

import shutil
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from symcorpus.plans import registry

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Every event of every third source again under an id that gives the same note, and every seventh text is null."""
    home = tmp_path_factory.mktemp("odd")
    for name in ("events", "documents"):
        shutil.copy(DATA / f"{name}.parquet", home / f"old_{name}.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{home}/old_events.parquet' UNION ALL SELECT * REPLACE (event_id + 49 * 127 * 1000 AS event_id) FROM '{home}/old_events.parquet' WHERE user_id % 3 = 0) TO '{home}/events.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 7 <> 0 THEN text END AS text) FROM '{home}/old_documents.parquet') TO '{home}/documents.parquet'")
    return home


@pytest.mark.parametrize("name", ["s10_sidecar_issues", "s10_sidecar_annotations", "s10_sidecar_ranges", "s10_sidecar_tonalities"])
def test_repeated_notes_and_null_texts_agree_with_sql(spark, odd, name):
    got = registry.QUERIES[name](spark, str(odd))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in ("events", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet'")
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(wanted) and rows
    if name == "s10_sidecar_issues":
        assert {"note twice", "no strict JSON"} <= {r[2] for r in rows}
