"""Queries of sidecar files: what is wrong with them, their labels, ranges and tonalities, and those without a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sidecars as sc
from ..operators.events import NOTE
from ..sources import runs
from .registry import query

VIEWS = "v_sidecar_texts v_sidecar_sources v_lead"
_keys = lambda kind: str(sorted(sc.KEYS[kind]))
_first = lambda *rules: "CASE " + " ".join(f"WHEN {bad} THEN '{name}'" for bad, name in rules) + " END"
_int = lambda j, path: f"coalesce(json_type({j}, '$.{path}') IN ('BIGINT', 'UBIGINT'), false)"

HEAD = _first(
    ("copies > 1", "several sidecars of a kind"), ("j IS NULL OR len(json_keys(j)) <> len(list_distinct(json_keys(j)))", "no strict JSON"),
    (f"list_sort(json_keys(j)) <> CASE kind WHEN 'techniques' THEN {_keys('techniques')} ELSE {_keys('tonality')} END", "fields"),
    ("(j->>'$.schema_version') <> '1'", "schema_version"), ("(j->>'$.source_midi') <> name", "source_midi"), ("(j->>'$.source_sha256') <> sha256", "source_sha256"),
    ("kind = 'techniques' AND CAST(j->>'$.ticks_per_quarter' AS INT) <> ppq", "ticks_per_quarter"), ("CAST(j->>'$.instrument_index' AS INT) <> instrument_index", "instrument_index"),
    ("(j->>'$.coverage') <> 'COMPLETE'", "coverage"), ("kind = 'tonality' AND (j->>'$.tonic') NOT IN ('C', 'F_SHARP', 'UNKNOWN', 'A')", "tonic"),
    ("kind = 'tonality' AND coalesce(j->>'$.mode', '') NOT IN ('MINOR', 'UNKNOWN', 'BLUES')", "mode"), ("(j->>'$.tonic') = 'UNKNOWN' AND (j->>'$.mode') <> 'UNKNOWN'", "mode without tonic"),
    ("kind = 'techniques' AND json_type(j, '$.note_techniques') <> 'ARRAY'", "note_techniques"),
)
ENTRY = _first(
    *[(f"NOT {_int('e', f'note.{c}')} OR CAST(e->>'$.note.{c}' AS BIGINT) NOT BETWEEN {low} AND {high}", f"note {c}") for c, low, high in (("onset_tick", 0, 1 << 40), ("end_tick", 1, 1 << 40), ("pitch", 0, 127), ("velocity", 1, 127))],
    ("NOT EXISTS (SELECT 1 FROM v_lead n WHERE n.source_id = se.source_id AND n.onset_tick = CAST(e->>'$.note.onset_tick' AS BIGINT) AND n.end_tick = CAST(e->>'$.note.end_tick' AS BIGINT) AND n.pitch = CAST(e->>'$.note.pitch' AS INT) AND n.velocity = CAST(e->>'$.note.velocity' AS DOUBLE))", "no such note"),
    ("again > 1", "note twice"), ("json_array_length(e, '$.techniques') = 0", "no techniques"), ("broken IS NOT NULL", "BROKEN"), ("len(list_distinct(kinds)) < len(kinds)", "technique twice"),
    ("list_contains(kinds, 'SLIDE_UP') AND list_contains(kinds, 'SLIDE_DOWN')", "slide up and down"), ("list_contains(kinds, 'DEAD_NOTE') AND len(kinds) > 1", "dead note with another"),
).replace("'BROKEN'", "broken")
MARK = _first(
    ("(x->>'$.type') NOT IN ('DEAD_NOTE', 'VIBRATO', 'SLIDE')", "technique type"), ("len(json_keys(x)) <> CASE WHEN (x->>'$.type') = 'SLIDE' THEN 3 ELSE 1 END", "technique fields"),
    ("CAST(x->>'$.target_pitch' AS INT) NOT BETWEEN 0 AND 127", "slide target"), ("(x->>'$.type') = 'SLIDE' AND (CAST(x->>'$.target_pitch' AS INT) - pitch) * CASE WHEN (x->>'$.direction') = 'UP' THEN 1 ELSE -1 END NOT BETWEEN 1 AND 24", "slide distance"),
)
JUDGED = f"""WITH st AS (SELECT t.source_id, kind, text, name, sha256, ppq, instrument_index, fin, count(*) OVER (PARTITION BY t.source_id, kind) AS copies, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM v_sidecar_texts t JOIN v_sidecar_sources USING (source_id)),
sh AS (SELECT *, {HEAD} AS reason FROM st), sg AS (SELECT * FROM sh WHERE reason IS NULL AND kind = 'techniques'),
sx AS (SELECT source_id, unnest(json_extract(j, '$.note_techniques[*]')) AS e, generate_subscripts(json_extract(j, '$.note_techniques[*]'), 1) AS pos FROM sg),
sm AS (SELECT source_id, pos, unnest(json_extract(e, '$.techniques[*]')) AS x, generate_subscripts(json_extract(e, '$.techniques[*]'), 1) AS k, TRY_CAST(e->>'$.note.pitch' AS INT) AS pitch FROM sx),
sk AS (SELECT *, {MARK} AS issue, concat_ws('_', x->>'$.type', x->>'$.direction') AS type FROM sm),
sq AS (SELECT source_id, pos, list(type ORDER BY k) AS kinds, list(issue ORDER BY k) FILTER (issue IS NOT NULL)[1] AS broken FROM sk GROUP BY 1, 2),
se AS (SELECT sx.*, kinds, broken, row_number() OVER (PARTITION BY sx.source_id, {', '.join(f"e->>'$.note.{c}'" for c in NOTE)} ORDER BY sx.pos) AS again FROM sx LEFT JOIN sq USING (source_id, pos)), si AS (SELECT source_id, 1 AS stage, pos, {ENTRY} AS reason FROM se),
sr AS (SELECT source_id, fin, unnest(json_extract(j, '$.palm_mute_ranges[*]')) AS e, generate_subscripts(json_extract(j, '$.palm_mute_ranges[*]'), 1) AS pos FROM sg WHERE json_type(j, '$.palm_mute_ranges') = 'ARRAY'),
sp AS (SELECT source_id, fin, pos, CAST(e->>'$.start_tick' AS BIGINT) AS start_tick, CAST(e->>'$.end_tick' AS BIGINT) AS end_tick FROM sr), sl AS (SELECT *, lag(end_tick) OVER (PARTITION BY source_id ORDER BY start_tick, end_tick) AS was FROM sp),
sa AS (SELECT * FROM si UNION ALL SELECT source_id, 2, 0, 'palm_mute_ranges' FROM sg WHERE coalesce(json_type(j, '$.palm_mute_ranges'), 'NULL') <> 'ARRAY' UNION ALL SELECT source_id, 3, pos, 'range beyond the source' FROM sp WHERE end_tick > fin
  UNION ALL SELECT source_id, 4, pos, CASE WHEN start_tick < was THEN 'ranges overlap' WHEN start_tick = was THEN 'ranges touch' END FROM sl),
sf AS (SELECT source_id, 'techniques' AS kind, arg_min(reason, (stage, pos)) AS later FROM sa WHERE reason IS NOT NULL GROUP BY 1),
sj AS (SELECT source_id, kind, j, coalesce(reason, later) AS reason FROM sh LEFT JOIN sf USING (source_id, kind)), so AS (SELECT source_id FROM sj WHERE kind = 'techniques' AND reason IS NULL) """  # fmt: skip
AT = ", ".join(NOTE)


def _read(texts: DataFrame, sources: DataFrame, notes: DataFrame) -> sc.Sidecars:
    return sc.read_sidecars(texts, sources, notes, sources.select("source_id", "fin"), runs.staged)


@query("s10_sidecar_issues", VIEWS, JUDGED + "SELECT source_id, kind, reason FROM sj WHERE reason IS NOT NULL")
def _(texts, sources, notes):
    return _read(texts, sources, notes).issues


@query("s10_sidecar_annotations", VIEWS, JUDGED + f""", sn AS (SELECT DISTINCT source_id, {AT} FROM v_lead JOIN so USING (source_id))
SELECT sk.source_id, {', '.join(f"CAST(e->>'$.note.{c}' AS BIGINT) AS {c}" for c in NOTE)}, type, CAST(x->>'$.target_pitch' AS INT) AS target_pitch FROM sk JOIN so USING (source_id) JOIN sx ON sx.source_id = sk.source_id AND sx.pos = sk.pos
UNION ALL SELECT DISTINCT sn.source_id, {AT.replace('end_tick', 'sn.end_tick')}, 'PALM_MUTE', CAST(NULL AS INT) FROM sn JOIN sp ON sp.source_id = sn.source_id AND onset_tick >= start_tick AND onset_tick < sp.end_tick""")  # fmt: skip
def _(texts, sources, notes):
    return _read(texts, sources, notes).annotations.select("source_id", *[F.col(c).cast("long").alias(c) for c in NOTE], "type", "target_pitch")


@query("s10_sidecar_ranges", VIEWS, JUDGED + "SELECT source_id, start_tick, end_tick FROM sp JOIN so USING (source_id)")
def _(texts, sources, notes):
    return _read(texts, sources, notes).ranges


@query("s10_sidecar_tonalities", VIEWS, JUDGED + "SELECT source_id, j->>'$.tonic' AS tonic, j->>'$.mode' AS mode FROM sj WHERE kind = 'tonality' AND reason IS NULL")
def _(texts, sources, notes):
    return _read(texts, sources, notes).tonalities


@query("s11_orphan_sidecars", "v_sidecars v_sources", """
SELECT 'data/raw/' || source_id || CASE WHEN source_id % 2 = 0 THEN '.txt.techniques.json' ELSE '.txt.tonality.json' END AS path, CASE WHEN source_id % 2 = 0 THEN 'techniques' ELSE 'tonality' END AS kind
FROM v_sidecars WHERE source_id NOT IN (SELECT source_id FROM v_sources WHERE lang = 'en')""")  # fmt: skip
def _(side, d):
    path = F.concat(F.lit("data/raw/"), "source_id", F.lit(".txt"))
    files = side.select(F.concat(path, F.when(F.col("source_id") % 2 == 0, ".techniques.json").otherwise(".tonality.json")).alias("path"))
    return sc.orphans(files, d.filter("lang = 'en'").select(path.alias("path")))
