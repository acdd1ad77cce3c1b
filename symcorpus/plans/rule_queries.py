"""Queries of records, contracts, joins of provenance and whole chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import events as e
from ..operators import rules as r
from ..operators import sequences as q
from ..operators import splits as sp
from ..operators import tokens as t
from ..sources import runs
from ..views import view
from .registry import EXCLUDED, QUERIES, SCORE_SQL, SQL, query, types_of
from .token_queries import _encoded, step


SQL["u02_key_set_diff"] = "WITH k AS (SELECT event_id, json_keys(props::JSON) AS held FROM events) SELECT event_id, array_to_string(list_sort(list_filter(['k', 'v'], lambda x: NOT list_contains(held, x))), ',') AS missing, array_to_string(list_sort(list_filter(held, lambda x: NOT list_contains(['k', 'v'], x))), ',') AS unknown FROM k"
SQL["s10_read_annotations"] = "SELECT event_id, CAST(json_extract(props::JSON, '$.k') AS INT) AS k, json_extract(props::JSON, '$.k') IS NOT NULL AND len(json_keys(props::JSON)) = 1 AND strlen(props) <= 1048576 AS valid FROM events"
SQL["p17_run_stamp"] = "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || left(sha256(props), 10) AS stamp FROM events"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


QUERIES["u02_key_set_diff"] = lambda spark, sf_dir: r.key_set_diff(_table(spark, sf_dir, "events"), "props", ["k", "v"]).select("event_id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))
QUERIES["s10_read_annotations"] = lambda spark, sf_dir: r.read_annotations(_table(spark, sf_dir, "events"), "props", "k int", 1 << 20).select("event_id", "record.k", "valid")
QUERIES["p17_run_stamp"] = lambda spark, sf_dir: _table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.substring(F.sha2("props", 256), 1, 10)).alias("stamp"))


@query("u03_multiset_equal", "v_lead v_bends v_annot", step(x="t05_extract_postfix_labels") + ", y AS (SELECT type, count(*) AS n FROM (SELECT DISTINCT a.source_id, a.seq, type FROM v_annot a JOIN v_lead l ON l.source_id = a.source_id AND l.seq = a.seq) z GROUP BY 1), m AS (SELECT technique AS type, count(*) AS m FROM x GROUP BY 1) SELECT type, n AS annotated, coalesce(m, 0) AS encoded, n = coalesce(m, 0) AS equal FROM y LEFT JOIN m USING (type)")
def _(n, b, a):
    own = a.join(n, ["source_id", "seq"], "left_semi").select("source_id", "seq", "type").distinct().groupBy("type").agg(F.count("*").alias("annotated"))
    seen = t.extract_labels(_encoded(n, b, a)).groupBy(F.col("technique").alias("type")).agg(F.count("*").alias("encoded"))
    return own.join(seen, "type", "left").fillna(0, ["encoded"]).withColumn("equal", F.col("annotated") == F.col("encoded"))


@query("s11_orphan_annotations", "v_sidecars v_listed", "SELECT source_id FROM v_sidecars WHERE source_id NOT IN (SELECT source_id FROM v_listed)")
def _(side, d):
    return side.join(d, "source_id", "left_anti").select("source_id")


def _fragments(n: DataFrame) -> DataFrame:
    return e.transposed(e.phrase_window(n), -6, 6, 38, 90)


@query("s05_fragment_name", "v_notes", step(x="x02_transpose") + "SELECT source_id, phrase_index, semitones, 'src' || source_id || printf('_phrase-%04d_', phrase_index) || CASE WHEN semitones < 0 THEN printf('m%02d', -semitones) WHEN semitones > 0 THEN printf('p%02d', semitones) ELSE 'orig' END AS name FROM x")
def _(n):
    name = F.concat(F.format_string("src%d_phrase-%04d_", "source_id", "phrase_index"), s.variant_tag(F.col("semitones")))
    return _fragments(n).select("source_id", "phrase_index", "semitones", name.alias("name"))


@query("j10_variants", "v_notes", step(w="w03_phrase_window") + "SELECT source_id, phrase_index, CAST(k AS INT) AS semitones FROM (SELECT DISTINCT source_id, phrase_index FROM w) x, range(-6, 7) g(k)")
def _(n):
    return r.variants(e.phrase_window(n).select("source_id", "phrase_index").distinct(), -6, 6)


@query("j04_empty_ranges", "v_notes v_lead v_ranges", """
WITH d AS (SELECT source_id, max(end_tick) AS fin FROM v_notes GROUP BY 1), g AS (SELECT DISTINCT source_id, start_tick, end_tick FROM v_ranges)
SELECT g.source_id, start_tick, end_tick, NOT EXISTS (SELECT 1 FROM v_lead n WHERE n.source_id = g.source_id AND onset_tick >= start_tick AND onset_tick < g.end_tick) AS empty, end_tick > fin AS beyond FROM g JOIN d USING (source_id)""")  # fmt: skip
def _(n, lead, g):
    return r.empty_ranges(lead, g, n.groupBy("source_id").agg(F.max("end_tick").alias("fin")))


@query("j08_map_notes", "v_notes", step(y="w02_quantize") + """, a AS (SELECT source_id, seq, pitch, row_number() OVER (PARTITION BY source_id, pitch ORDER BY onset_tick, end_tick, velocity, seq) AS r FROM v_notes),
b AS (SELECT source_id, seq, pitch, row_number() OVER (PARTITION BY source_id, pitch ORDER BY onset_tick, end_tick, velocity, seq) AS r FROM y)
SELECT source_id, a.seq AS before_seq, b.seq AS after_seq FROM a FULL JOIN b USING (source_id, pitch, r)""")  # fmt: skip
def _(n):
    return r.map_notes(n, e.quantize(n, 120))


@query("j13_provenance_match", "v_sources", "SELECT 'paths' AS field, true AS equal UNION ALL SELECT 'sources', true UNION ALL SELECT 'hashes', count(*) FILTER (source_id % 50 = 1) = 0 FROM v_sources")
def _(d):
    other = d.withColumn("content", F.when(F.col("source_id") % 50 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return r.provenance_match(r.provenance(sp.fingerprint(d)), r.provenance(sp.fingerprint(other)))


@query("p04_drop_exporter_eot", "v_messages", "SELECT source_id, track, CAST(sum(CASE WHEN ord = last AND delta <= 1 THEN 0 ELSE delta END) AS BIGINT) AS duration FROM (SELECT *, max(ord) OVER (PARTITION BY source_id, track) AS last FROM v_messages) m GROUP BY 1, 2")
def _(d):
    return e.durations(d)


@query("p14_sequence_id", "v_sources v_cover", "SELECT source_id, left(lower(trim(regexp_replace(path, '[^A-Za-z0-9_-]+', '-', 'g'), '-_')), 64) || '-' || left(sha256(path || '|' || sha256(content) || '|' || coverage), 12) AS sequence_id FROM v_sources JOIN v_cover USING (source_id)")
def _(d, c):
    rows = d.join(c.select("source_id", "coverage"), "source_id")
    return rows.select("source_id", s.sequence_id(F.col("path"), F.sha2("content", 256), F.col("coverage")).alias("sequence_id"))


@query("p15_perplexity", "v_logits", SCORE_SQL + "SELECT row_id, round(exp(least(full_nll, 50)), 5) AS perplexity FROM r")
def _(d):
    return q.scored(d, EXCLUDED).select("row_id", F.round(s.perplexity(F.col("full_nll")), 5).alias("perplexity"))


@query("f08_bend_declared_before_use", "v_controls v_bends", "SELECT b.source_id, first_bend, first_range, first_bend < first_range AS early FROM (SELECT source_id, min(tick) AS first_bend FROM v_bends WHERE value <> 0 GROUP BY 1) b JOIN (SELECT source_id, min(tick) AS first_range FROM v_controls WHERE number = 6 GROUP BY 1) c USING (source_id)")
def _(c, b):
    return e.early_bends(c, b)


@query("f21_ordered_check", "v_sources", "SELECT b.source_id FROM v_sources a JOIN v_sources b ON b.source_id = a.source_id + 1 WHERE (b.lang, b.path) < (a.lang, a.path)")
def _(d):
    return r.ordered_check(d.select("source_id", F.struct("lang", "path").alias("key")))


@query("t11_draw", "v_logits", """
WITH f AS (SELECT row_id, u, i - 1 AS id, x[i] AS x FROM (SELECT row_id, (row_id * 7919 % 1000 + 0.5) / 1000.0 AS u, CAST(logits AS DOUBLE[]) AS x, unnest(range(1, len(logits) + 1)) AS i FROM v_logits) z),
p AS (SELECT row_id, u, id, sum(exp(x)) OVER (PARTITION BY row_id ORDER BY id) / sum(exp(x)) OVER (PARTITION BY row_id) AS c FROM f)
SELECT row_id, CAST(min(id) AS INT) AS id FROM p WHERE c >= u GROUP BY 1""")  # fmt: skip
def _(d):
    u = (F.col("row_id") * 7919 % 1000 + 0.5) / 1000.0
    return d.select("row_id", s.draw(F.transform("logits", lambda x: x.cast("double")), u).alias("id"))


@query("s13_metric_scalars", "v_logits", step(m="a12_token_metrics") + """SELECT 'metrics/validation/all/' || name AS tag, 1 AS epoch, round(value, 5) AS value FROM (UNPIVOT (SELECT full_nll::DOUBLE AS full_nll, objective_nll::DOUBLE AS objective_nll, perplexity::DOUBLE AS perplexity, top1::DOUBLE AS top1, top5::DOUBLE AS top5 FROM m) ON COLUMNS(*) INTO NAME name VALUE value) x""")
def _(d):
    report = q.token_metrics(q.scored(d, EXCLUDED, types_of(d))).withColumn("epoch", F.lit(1))
    return r.metric_scalars(report, "validation", ["full_nll", "objective_nll", "perplexity", "top1", "top5"]).withColumn("value", F.round("value", 5))
