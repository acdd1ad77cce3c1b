"""The canonical tables, bound to the given test tables by portable SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TICK = "CAST((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT)"
_K = "CAST(replace(replace(e.props, concat(chr(123), '\"k\": '), ''), chr(125), '') AS INT)"

VIEWS = {
    "v_notes": f"""
SELECT user_id AS source_id,
       CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS instrument_index,
       event_type = 'error' AS is_drum, event_id AS seq, {_TICK} AS onset_tick,
       {_TICK} + 1 + CAST(floor(value) AS BIGINT) AS end_tick,
       CAST(40 + event_id % 49 AS INT) AS pitch, CAST(1 + event_id % 127 AS INT) AS velocity
FROM events""",
    # the notes of each source's chosen track: no drums, ten notes or more, all of them from 41 to 87, most notes, lowest index
    "v_lead": """
SELECT n.source_id, n.instrument_index, n.is_drum, n.seq, n.onset_tick, n.end_tick, n.pitch, n.velocity FROM v_notes n
JOIN (SELECT source_id, instrument_index FROM (SELECT source_id, instrument_index, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, instrument_index) AS r FROM v_notes
      GROUP BY source_id, instrument_index HAVING count(*) >= 10 AND min(pitch) >= 41 AND max(pitch) <= 87 AND NOT bool_or(is_drum)) t WHERE r = 1) k ON k.source_id = n.source_id AND k.instrument_index = n.instrument_index""",
    "v_listed": "SELECT source_id, path, content, lang, n_chars FROM v_sources WHERE lang = 'en'",
    "v_notes_dup": """
SELECT source_id, instrument_index, is_drum, seq, onset_tick, end_tick, pitch, velocity FROM v_notes
UNION ALL
SELECT source_id, instrument_index, is_drum, seq + 1000000 AS seq, onset_tick, end_tick, pitch, velocity FROM v_notes WHERE seq % 41 = 0""",
    "v_bends": f"""
SELECT user_id AS source_id, event_id AS seq, {_TICK} AS tick,
       CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id * 37) % 16384 - 8192 END AS INT) AS value
FROM events WHERE event_type IN ('click', 'view')""",
    "v_ranges": f"""
SELECT user_id AS source_id, {_TICK} AS start_tick, {_TICK} + 240 AS end_tick FROM events WHERE event_type = 'purchase'""",
    "v_k": f"SELECT n.*, {_K} AS k FROM v_notes n JOIN events e ON e.event_id = n.seq",
    "v_annot": """
SELECT source_id, seq, onset_tick, end_tick, pitch, velocity,
       CASE k % 4 WHEN 0 THEN 'DEAD_NOTE' WHEN 1 THEN 'SLIDE_UP' WHEN 2 THEN 'SLIDE_DOWN' ELSE 'VIBRATO' END AS type,
       CASE k % 4 WHEN 1 THEN pitch + 1 + k % 26 WHEN 2 THEN pitch - 1 - k % 26 END AS target_pitch
FROM v_k WHERE k < 60
UNION ALL
SELECT source_id, seq, onset_tick, end_tick, pitch, velocity, 'VIBRATO' AS type, NULL AS target_pitch FROM v_k WHERE k < 60 AND k % 10 = 0""",
    "v_messages": """
SELECT source_id, instrument_index AS track,
       row_number() OVER (PARTITION BY source_id, instrument_index ORDER BY tick, on_flag, seq) AS ord,
       tick - coalesce(lag(tick) OVER (PARTITION BY source_id, instrument_index ORDER BY tick, on_flag, seq), 0) AS delta,
       on_flag, pitch, velocity
FROM (SELECT source_id, instrument_index, onset_tick AS tick, 1 AS on_flag, pitch % 4 AS pitch, velocity, seq FROM v_notes WHERE seq % 89 <> 0
      UNION ALL
      SELECT source_id, instrument_index, end_tick AS tick, 0 AS on_flag, pitch % 4 AS pitch, 0 AS velocity, seq FROM v_notes WHERE seq % 97 <> 0
      UNION ALL
      SELECT source_id, instrument_index, onset_tick + 7 * k * (end_tick - onset_tick) AS tick, 1 - k AS on_flag, pitch % 4 AS pitch, (1 - k) * velocity AS velocity, seq FROM v_notes CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t WHERE seq % 53 = 0) m""",
    # the first stage's files: most rules are broken by some of them, and some break none
    "v_file_messages": """
SELECT source_id, instrument_index AS track, row_number() OVER (PARTITION BY source_id, instrument_index ORDER BY tick, on_flag, seq, more) AS ord,
       tick - coalesce(lag(tick) OVER (PARTITION BY source_id, instrument_index ORDER BY tick, on_flag, seq, more), 0) AS delta, on_flag, pitch, velocity
FROM (SELECT source_id, instrument_index, CASE WHEN k = 1 THEN onset_tick ELSE end_tick + more END AS tick, k AS on_flag, CASE WHEN source_id % 19 = 5 THEN pitch % 4 ELSE pitch END AS pitch, k * velocity AS velocity, seq, more
      FROM v_notes CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) a CROSS JOIN (SELECT 0 AS more UNION ALL SELECT 1 AS more) b
      WHERE (more = 0 OR (source_id % 19 = 6 AND seq % 5 = 0)) AND NOT (source_id % 19 = 3 AND k = 0 AND seq % 7 = 0)) m""",
    "v_file_bends": f"""
SELECT user_id AS source_id, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS instrument_index, event_id AS seq, {_TICK} AS tick,
       CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN user_id % 29 = 7 AND event_id % 3 = 0 THEN 9000 ELSE (event_id * 37) % 16384 - 8192 END AS INT) AS value
FROM events WHERE event_type IN ('click', 'view')""",
    "v_file_controls": """
SELECT source_id, instrument_index, k AS seq, CASE WHEN x = 7 AND k = 2 THEN -5 WHEN x = 8 THEN 44000 WHEN k < 5 THEN 0 ELSE 100 END AS tick,
       CASE WHEN x = 3 AND k = 3 THEN 7 WHEN k IN (1, 5) THEN 101 WHEN k IN (2, 6) THEN 100 WHEN k IN (3, 7) THEN 6 ELSE 38 END AS number,
       CASE WHEN x = 2 AND k = 2 THEN 1 WHEN x = 4 AND k = 3 THEN 0 WHEN x = 1 AND k = 8 THEN 25 WHEN k IN (3, 7) THEN CASE WHEN source_id % 23 = 0 THEN 12 ELSE 2 + source_id % 4 END WHEN k IN (4, 8) THEN 50 ELSE 0 END AS value
FROM (SELECT source_id, instrument_index, k, source_id % 24 AS x FROM (SELECT DISTINCT source_id, instrument_index FROM v_notes WHERE instrument_index < 2) t
      CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) r) c
WHERE x <> 9 AND NOT (x = 5 AND k > 2) AND NOT (x = 6 AND k = 3) AND (k NOT IN (4, 8) OR source_id % 3 = 0 OR x IN (1, 6))""",
    "v_file_tempi": """
SELECT source_id, k AS seq, CAST(CASE WHEN source_id % 31 = 1 THEN -1 WHEN source_id % 10 = 1 AND k = 2 THEN 60 ELSE 92 + source_id % 100 END AS DOUBLE) AS bpm
FROM (SELECT DISTINCT source_id FROM v_notes) t CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) r WHERE source_id % 10 <> 4 AND (k = 1 OR source_id % 10 IN (1, 2))""",
    "v_file_meters": """
SELECT source_id, k AS seq, CASE WHEN source_id % 9 = 2 AND k = 1 THEN 10 WHEN source_id % 9 = 2 THEN 3 ELSE 4 END AS numerator, 4 AS denominator
FROM (SELECT DISTINCT source_id FROM v_notes) t CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) r WHERE source_id % 9 <> 1 AND (k = 1 OR source_id % 9 = 2)""",
    "v_file_headers": """
SELECT source_id, CASE WHEN source_id % 20 = 3 THEN 2 WHEN source_id % 20 = 7 THEN 0 ELSE 1 END AS file_type, CASE WHEN source_id % 17 = 5 THEN 0 ELSE 480 END AS ppq, count(DISTINCT track) AS n_tracks
FROM v_file_messages GROUP BY source_id""",
    "v_file_meta": "SELECT DISTINCT source_id, track, CASE WHEN source_id % 13 = 4 THEN 'set_tempo' WHEN source_id % 13 = 8 AND track = 2 THEN 'time_signature' ELSE 'text' END AS kind FROM v_file_messages",
    "v_controls": f"""
SELECT source_id, seq, tick,
       CASE WHEN source_id % 11 = 0 AND rn = 5 THEN 7 WHEN rn % 4 = 1 THEN 101 WHEN rn % 4 = 2 THEN 100 WHEN rn % 4 = 3 THEN 6 ELSE 38 END AS number,
       CASE WHEN rn % 4 <> 3 THEN 0 WHEN source_id % 7 = 0 THEN 0 WHEN source_id % 13 = 0 THEN 2 + CAST(rn % 3 AS INT) ELSE 2 + CAST(source_id % 5 AS INT) END AS value
FROM (SELECT user_id AS source_id, event_id AS seq, {_TICK} AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type = 'signup') c""",
    "v_tempi": "SELECT o_custkey AS source_id, o_orderkey AS seq, CASE WHEN o_custkey % 3 = 0 THEN 120.0 ELSE CAST(o_totalprice AS DOUBLE) END AS bpm FROM orders",
    "v_customers": "SELECT c_custkey AS source_id FROM customer",
    "v_meters": "SELECT p_brand AS source_id, p_partkey AS seq, CASE WHEN p_size % 10 = 0 THEN 3 ELSE 4 END AS numerator, 4 AS denominator FROM part",
    "v_sources": "SELECT doc_id AS source_id, concat('data/raw/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, text AS content, lang, n_chars FROM documents",
    "v_cover": "SELECT d.doc_id AS source_id, CASE WHEN l.doc_id IS NULL THEN 'UNLABELED' ELSE 'COMPLETE' END AS coverage, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "v_headers": """
SELECT source_id, CASE WHEN source_id % 10 = 3 THEN 2 WHEN source_id % 10 = 7 THEN 0 ELSE 1 END AS file_type, CASE WHEN source_id % 17 = 5 THEN 0 ELSE 480 END AS ppq, count(DISTINCT track) AS n_tracks
FROM v_messages GROUP BY source_id""",
    "v_meta": "SELECT source_id, track, CASE velocity WHEN 7 THEN 'set_tempo' WHEN 11 THEN 'time_signature' ELSE 'text' END AS kind FROM v_messages WHERE on_flag = 1",
    "v_sidecars": "SELECT doc_id AS source_id, quality, toxic FROM labels",
    "v_toggle": "SELECT conv_id AS sequence_id, turn AS pos, CASE role WHEN 'user' THEN 'ON' WHEN 'assistant' THEN 'OFF' END AS toggle FROM conversations WHERE role <> 'system' AND NOT (conv_id % 9 = 0 AND turn = 2)",
    "v_logits": "SELECT vec_id AS row_id, CAST(label AS INT) AS target, vec_id % 3 = 0 AS unknown, embedding AS logits FROM embeddings",
    "v_epoch_types": """
SELECT yr AS run_id, CAST(mo AS INT) AS epoch, status AS type, count(*) AS n, avg(price) / 1000.0 + CASE WHEN yr % 7 = 0 THEN 0.01 ELSE 0.0 END AS loss
FROM (SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders) o WHERE NOT (yr % 4 = 0 AND mo = 3 AND status = 'P') GROUP BY yr, mo, status""",
    "v_epochs": """
SELECT yr AS run_id, CAST(mo AS INT) AS epoch, round(avg(price) / 1000.0, 6) AS validation_loss, count(*) AS tokens
FROM (SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, CAST(o_totalprice AS DOUBLE) AS price FROM orders) o GROUP BY yr, mo""",
}

#: Sidecars of the chosen tracks; braces are < and > until the end, and listing, hash and order are said in each engine's words. A source without a text has sidecars without one (concat takes nulls differently in each engine).
_SIDE_SOURCES = """
SELECT k.source_id, concat(CAST(k.source_id AS VARCHAR(20)), '.txt') AS name, HASH(content) AS sha256, 480 AS ppq, k.instrument_index, 5 AS n_tracks, fin
FROM (SELECT source_id, min(instrument_index) AS instrument_index, max(end_tick) AS fin FROM v_lead GROUP BY source_id) k JOIN v_sources s ON s.source_id = k.source_id"""
_SIDE_TEXTS = """
SELECT source_id, 'techniques' AS kind, CASE WHEN sha256 IS NOT NULL THEN translate(concat('<"schema_version":', CASE x WHEN 1 THEN '2' WHEN 11 THEN '1.0' WHEN 8 THEN '1,"schema_version":1' ELSE '1' END, ',"source_midi":"', CASE WHEN x = 2 THEN 'other' ELSE name END, '","source_sha256":"', CASE WHEN x = 3 THEN upper(sha256) ELSE sha256 END,
  '","ticks_per_quarter":', CASE WHEN x = 4 THEN '240' ELSE '480' END, ',"instrument_index":', CAST(instrument_index + CASE WHEN x = 5 THEN 1 ELSE 0 END AS VARCHAR(20)), CASE x WHEN 9 THEN '' WHEN 6 THEN ',"coverage":"PARTIAL"' WHEN 10 THEN ',"coverage":"COMPLETE","more":[]' ELSE ',"coverage":"COMPLETE"' END,
  ',"note_techniques":', CASE WHEN x = 12 THEN '<>' ELSE concat('[', coalesce(marks, ''), ']') END, ',"palm_mute_ranges":', CASE WHEN x = 13 THEN 'null' ELSE concat('[', coalesce(spans, ''), ']') END, '>', CASE WHEN x = 7 THEN ' x' ELSE '' END), '<>', concat(chr(123), chr(125))) END AS text
FROM (SELECT source_id, name, sha256, instrument_index, source_id % 31 AS x FROM v_sidecar_sources) f
LEFT JOIN (SELECT source_id AS ms, LISTED(concat('<"note":<"onset_tick":', CAST(onset_tick AS VARCHAR(20)), ',"end_tick":', CAST(end_tick AS VARCHAR(20)), ',"pitch":', CAST(CASE WHEN source_id % 31 = 18 THEN pitch + 60 ELSE pitch END AS VARCHAR(20)), ',"velocity":', CASE WHEN source_id % 31 = 15 THEN '0' WHEN source_id % 31 = 19 THEN concat(CAST(velocity AS VARCHAR(20)), '.0') ELSE CAST(velocity AS VARCHAR(20)) END,
    '>,"techniques":[', CASE WHEN source_id % 31 = 16 THEN '' ELSE kinds END, ']>')) ORDERED(seq) AS marks
  FROM (SELECT source_id, seq, onset_tick, end_tick, pitch, velocity, LISTED(CASE type WHEN 'SLIDE_UP' THEN concat('<"type":"SLIDE","direction":"UP","target_pitch":', CAST(target_pitch AS VARCHAR(20)), '>') WHEN 'SLIDE_DOWN' THEN concat('<"type":"SLIDE","direction":"DOWN","target_pitch":', CAST(target_pitch AS VARCHAR(20)), '>')
      ELSE concat('<"type":"', CASE WHEN source_id % 31 = 17 AND seq % 3 = 0 THEN 'BEND' ELSE type END, '"', CASE WHEN source_id % 31 = 20 THEN ',"force":1' ELSE '' END, '>') END) ORDERED(type) AS kinds
    FROM v_annot a WHERE EXISTS (SELECT 1 FROM v_lead l WHERE l.source_id = a.source_id AND l.seq = a.seq) GROUP BY source_id, seq, onset_tick, end_tick, pitch, velocity) e GROUP BY source_id) m ON ms = source_id
LEFT JOIN (SELECT source_id AS rs, LISTED(concat('<"start_tick":', CAST(onset_tick - 1 AS VARCHAR(20)), ',"end_tick":', CAST(onset_tick + CASE WHEN source_id % 31 = 14 THEN 99999 ELSE 20 END AS VARCHAR(20)), '>')) ORDERED(onset_tick) AS spans
  FROM (SELECT DISTINCT source_id, onset_tick FROM v_lead WHERE onset_tick > 0 AND seq % 6 = 0) g GROUP BY source_id) r ON rs = source_id
UNION ALL
SELECT source_id, 'tonality', CASE WHEN sha256 IS NOT NULL THEN translate(concat('<"schema_version":1,"source_midi":"', name, '","source_sha256":"', sha256, '","instrument_index":', CAST(instrument_index AS VARCHAR(20)), ',"tonic":"', CASE source_id % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'F_SHARP' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'Db' ELSE 'A' END,
  '","mode":', CASE source_id % 5 WHEN 0 THEN '"MINOR"' WHEN 1 THEN '"UNKNOWN"' WHEN 2 THEN '"dorian"' WHEN 3 THEN '"BLUES"' ELSE 'null' END, '>'), '<>', concat(chr(123), chr(125))) END
FROM v_sidecar_sources CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t WHERE k = 0 OR source_id % 23 = 3"""


def _said(sql: str, agg: str, order: str, sha: str) -> str:
    """The sidecar views in one engine's words; agg takes what is listed, order its order."""
    sql = sql.replace("HASH(content)", sha)
    while "LISTED(" in sql:
        at = sql.rindex("LISTED(")
        depth, end = 1, at + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        by = re.match(r" ORDERED\((\w+)\)", sql[end:])
        sql = sql[:at] + agg.format(sql[at + 7 : end - 1]) + order.format(by[1]) + sql[end + by.end() :]
    return sql


SPARK_ONLY = {"v_seqs": "SELECT doc_id AS sequence_id, split(text, ' ') AS tokens FROM documents", "v_words": "SELECT doc_id AS sequence_id, CAST(pos AS BIGINT) AS pos, token FROM documents LATERAL VIEW posexplode(split(text, ' ')) w AS pos, token"}
DUCK_ONLY = {"v_seqs": "SELECT doc_id AS sequence_id, string_split(text, ' ') AS tokens FROM documents", "v_words": "SELECT doc_id AS sequence_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) u"}
for _name, _text in (("v_sidecar_sources", _SIDE_SOURCES), ("v_sidecar_texts", _SIDE_TEXTS)):
    SPARK_ONLY[_name] = _said(_text, "listagg({}, ',')", " WITHIN GROUP (ORDER BY {})", "sha2(content, 256)")
    DUCK_ONLY[_name] = _said(_text, "string_agg({}, ','", " ORDER BY {})", "sha256(content)")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    """Views that sql names, each after those that it needs itself."""
    out: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bv_\w+", sql)):
        if name in views:
            out += [x for x in [*_needed(views[name], views), name] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table over the given tables, as one plan."""
    views = VIEWS | SPARK_ONLY
    sql = f"SELECT * FROM {name}"
    with_views = ", ".join(f"{n} AS ({views[n]})" for n in _needed(sql, views))
    whole = f"WITH {with_views} {sql}"
    used = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", whole)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", whole), **used)


def oracle(sql: str) -> str:
    """DuckDB SQL over canonical tables, on the given tables."""
    views = VIEWS | DUCK_ONLY
    needed = _needed(sql, views)
    head = ", ".join(f"{n} AS ({views[n]})" for n in needed)
    if not needed:
        return sql
    if sql.lstrip()[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {sql.lstrip()[15:]}"
    return f"WITH {head}, {sql.lstrip()[5:]}" if sql.lstrip()[:5].upper() == "WITH " else f"WITH {head} {sql}"
