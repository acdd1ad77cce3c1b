"""Queries of the inspection of files; the SQL says every rule again, by windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as e
from ..operators import inspection as ins
from ..sources import runs
from .registry import PAIR_SQL, query
from .token_queries import step

RULES = ins.Rules(pitch_low=41, pitch_high=87, least_notes=10)
FILES = "v_notes_dup v_file_bends v_file_controls v_file_messages v_file_tempi v_file_meters v_file_headers v_file_meta"
N_FILES = len(FILES.split())


def inspected(*tables: DataFrame, index: int | None = None) -> ins.Inspection:
    return ins.inspect(*tables[:N_FILES], RULES, index, runs.staged)


def range_sql(view: str, keys: str) -> str:
    """Ranges of a view of controls, by windows: epochs of selections, the entries in them, the last hundredths of each entry."""
    return f"""
ra AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY tick, seq) AS pos FROM {view}),
rb AS (SELECT *, last_value(CASE WHEN number = 101 THEN value END IGNORE NULLS) OVER w AS msb, last_value(CASE WHEN number = 100 THEN value END IGNORE NULLS) OVER w AS lsb,
  max(CASE WHEN number IN (100, 101) THEN pos END) OVER w AS sel, max(CASE WHEN number = 6 THEN pos END) OVER w AS ent FROM ra WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
rc AS (SELECT *, CASE WHEN tick < 0 THEN 'range controls out of time' WHEN number NOT IN (6, 38, 100, 101) THEN 'unsupported controller' WHEN number = 6 AND NOT coalesce(msb = 0 AND lsb = 0, false) THEN 'data entry without parameter'
  WHEN number = 6 AND value <= 0 THEN 'range not positive' WHEN number = 38 AND NOT coalesce(msb = 0 AND lsb = 0 AND ent > sel, false) THEN 'fine range without a coarse one' END AS bad FROM rb),
rd AS (SELECT {keys}, ent, max(value) FILTER (number = 6) + coalesce(arg_max(value, pos) FILTER (number = 38), 0) / 100.0 AS semis FROM rc WHERE number IN (6, 38) AND ent IS NOT NULL GROUP BY ALL),
re AS (SELECT {keys}, arg_min(semis, ent) AS first, min(semis) AS low, max(semis) AS high FROM rd GROUP BY ALL),
rf AS (SELECT {keys}, coalesce(arg_min(bad, pos) FILTER (bad IS NOT NULL), CASE WHEN any_value(first) IS NULL THEN 'selection without a range' WHEN any_value(greatest(high - first, first - low)) > 1e-9 THEN 'range changes' END) AS issue, any_value(first) AS first
  FROM rc LEFT JOIN re USING ({keys}) GROUP BY ALL),
rg AS (SELECT {keys}, CASE WHEN issue IS NULL THEN CAST(first AS DOUBLE) END AS bend_range, issue FROM rf)"""


@query("f07_bend_range_state", "v_controls", "WITH " + range_sql("v_controls", "source_id") + " SELECT * FROM rg")
def _(d):
    return ins.bend_ranges(d, "source_id")


@query("f07_track_ranges", "v_file_controls", "WITH " + range_sql("v_file_controls", "source_id, instrument_index") + " SELECT * FROM rg")
def _(d):
    return ins.bend_ranges(d, "source_id", "instrument_index")


COLUMNS = ["source_id", "instrument_index", "is_drum", "raw_notes", "n_notes", "collapsed", "min_pitch", "max_pitch", "n_bends", "n_expressive", "bend_range", "compatible", "reason"]


@query("a02_track_profile", "v_notes_dup v_file_bends v_file_controls", "WITH " + range_sql("v_file_controls", "source_id, instrument_index") + """,
nu AS (SELECT source_id, instrument_index, bool_or(is_drum) AS is_drum, count(*) AS raw_notes, min(pitch) AS min_pitch, max(pitch) AS max_pitch, count(*) FILTER (onset_tick < 0 OR end_tick <= onset_tick) AS bad_notes FROM v_notes_dup GROUP BY 1, 2),
nd AS (SELECT source_id, instrument_index, count(*) AS n_notes FROM (SELECT DISTINCT source_id, instrument_index, onset_tick, end_tick, pitch, velocity FROM v_notes_dup) x GROUP BY 1, 2),
be AS (SELECT source_id, instrument_index, count(*) AS n_bends, count(*) FILTER (value <> 0) AS n_expressive, min(tick) FILTER (value <> 0) AS first_bend, max(abs(value)) FILTER (value <> 0) AS reach,
  count(*) FILTER (value NOT BETWEEN -8192 AND 8191 OR tick < 0) AS bad_bends FROM v_file_bends GROUP BY 1, 2),
fe AS (SELECT source_id, instrument_index, min(tick) AS first_entry FROM v_file_controls WHERE number = 6 GROUP BY 1, 2),
ia AS (SELECT nu.source_id, nu.instrument_index, is_drum, raw_notes, n_notes, raw_notes - n_notes AS collapsed, min_pitch, max_pitch, coalesce(n_bends, 0) AS n_bends, coalesce(n_expressive, 0) AS n_expressive, bend_range, concat_ws(', ',
  CASE WHEN is_drum THEN 'drum track' END, CASE WHEN n_notes < 10 THEN 'too few notes' END, CASE WHEN min_pitch < 41 OR max_pitch > 87 THEN 'pitch out of range' END, issue,
  CASE WHEN n_expressive > 0 AND bend_range IS NULL THEN 'wheel moves without a range' END, CASE WHEN n_expressive > 0 AND bend_range IS NOT NULL AND first_entry > first_bend THEN 'range set after the wheel moves' END,
  CASE WHEN n_expressive > 0 AND reach * bend_range / 8192 > 6 + 1e-9 THEN 'wheel beyond 6 semitones' END, CASE WHEN bad_bends > 0 THEN bad_bends || ' invalid wheel events' END, CASE WHEN bad_notes > 0 THEN bad_notes || ' invalid notes' END) AS reason
  FROM nu JOIN nd USING (source_id, instrument_index) LEFT JOIN be USING (source_id, instrument_index) LEFT JOIN fe USING (source_id, instrument_index) LEFT JOIN rg USING (source_id, instrument_index))
SELECT *, reason = '' AS compatible FROM ia""")  # fmt: skip
def _(n, b, c):
    return ins.inspect_tracks(n, b, c, RULES).select(*COLUMNS)


#: What keeps a file from being read, and the facts of the others; files that are read are in ih with unread null.
FACTS = step(it="a02_track_profile") + ", pr AS (" + PAIR_SQL.replace("v_messages", "v_file_messages") + """ SELECT * FROM p),
po AS (SELECT *, lag(off_ord) OVER k AS before_off, lag(onset_tick) OVER k AS before_tick, lag(velocity) OVER k AS before_velocity, row_number() OVER k AS r FROM pr WINDOW k AS (PARTITION BY source_id, track, pitch ORDER BY on_ord)),
li AS (SELECT source_id, arg_min(told, 3 * track + rank) AS issue FROM (SELECT source_id, track, 0 AS rank, 'notes overlap' AS told FROM po WHERE r > 1 AND (before_off IS NULL OR before_off > on_ord) AND (before_tick <> onset_tick OR before_velocity <> velocity)
  UNION ALL SELECT source_id, track, 1, 'note-on without an end' FROM pr WHERE end_tick IS NULL
  UNION ALL SELECT source_id, track, 2, 'notes overlap' FROM pr WHERE end_tick IS NOT NULL GROUP BY source_id, track, pitch, onset_tick, velocity HAVING count(*) > 1 AND count(DISTINCT end_tick) > 1) x GROUP BY 1),
gm AS (SELECT source_id, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM v_file_meta WHERE track > 0 AND kind <> 'text' GROUP BY 1),
ih AS (SELECT source_id, coalesce(CASE WHEN file_type = 2 THEN 'asynchronous file type 2' WHEN ppq <= 0 THEN 'ticks per beat not positive' WHEN file_type = 0 AND n_tracks <> 1 THEN 'file type 0 with more than one track'
  WHEN file_type = 1 AND kinds IS NOT NULL THEN 'global events outside track 0: ' || kinds END, issue) AS unread FROM v_file_headers LEFT JOIN gm USING (source_id) LEFT JOIN li USING (source_id)),
ib AS (SELECT source_id, arg_min(bpm, seq) AS first_bpm, count(*) AS n, min(bpm) AS low, max(bpm) AS high FROM v_file_tempi GROUP BY 1),
ip AS (SELECT source_id, CASE WHEN first_bpm <= 0 THEN 'tempo not a positive number' WHEN greatest(high - first_bpm, first_bpm - low) > 0.001 THEN 'tempo changes' END AS tempo_issue, CASE WHEN first_bpm > 0 THEN first_bpm END AS bpm, n FROM ib),
im AS (SELECT source_id, string_agg(numerator || '/' || denominator, ', ' ORDER BY seq) AS meters FROM v_file_meters GROUP BY 1),
iu AS (SELECT source_id, 'unsupported meters: ' || string_agg(numerator || '/' || denominator, ', ' ORDER BY numerator, denominator) AS meter_issue FROM (SELECT DISTINCT source_id, numerator, denominator FROM v_file_meters WHERE numerator <> 4 OR denominator <> 4) x GROUP BY 1),
tc AS (SELECT source_id, count(*) AS n_tracks, bool_or(compatible) AS valid, string_agg('instrument ' || instrument_index || ': ' || reason, '; ' ORDER BY instrument_index) AS every FROM it GROUP BY 1),
tb AS (SELECT source_id, instrument_index AS best FROM it WHERE compatible QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n_notes DESC, instrument_index) = 1)"""
CHOICE = "CASE WHEN n_tracks IS NULL THEN 'no tracks' WHEN NOT valid THEN 'no valid track (' || every || ')' END"


def sources_sql(best: str = "best", choice: str = CHOICE) -> str:
    return FACTS + f""", iv AS (SELECT ih.source_id, unread, CASE WHEN tempo_issue IS NULL AND ip.source_id IS NULL THEN 120.0 ELSE bpm END AS tempo, coalesce(n, 0) AS n, coalesce(meters, '4/4 (implicit)') AS meters, coalesce(n_tracks, 0) AS n_tracks, {best} AS best,
  coalesce(unread, concat_ws('; ', tempo_issue, meter_issue, {choice})) AS issues FROM ih LEFT JOIN ip USING (source_id) LEFT JOIN im USING (source_id) LEFT JOIN iu USING (source_id) LEFT JOIN tc USING (source_id) LEFT JOIN tb USING (source_id))
SELECT source_id, issues = '' AS compatible, CASE WHEN issues = '' THEN best END AS instrument_index, CASE WHEN unread IS NULL THEN tempo END AS tempo_bpm, CASE WHEN unread IS NULL THEN n END AS n_tempi, CASE WHEN unread IS NULL THEN meters END AS meters,
  CASE WHEN unread IS NULL THEN n_tracks ELSE 0 END AS n_tracks, nullif(issues, '') AS reason FROM iv"""


@query("f11_issues_to_reason", FILES, sources_sql())
def _(*tables):
    return inspected(*tables).sources.drop("issues")


ASKED = "CASE WHEN NOT EXISTS (SELECT 1 FROM it a WHERE a.source_id = ih.source_id AND instrument_index = 1) THEN 'track 1 asked, which the file does not have' ELSE (SELECT 'track 1 is invalid: ' || reason FROM it a WHERE a.source_id = ih.source_id AND instrument_index = 1 AND NOT compatible) END"


@query("k01_track_by_index", FILES, "SELECT source_id, compatible, instrument_index, reason FROM (" + sources_sql("1", ASKED) + ") x")
def _(*tables):
    return inspected(*tables, index=1).sources.select("source_id", "compatible", "instrument_index", "reason")


@query("k01_select_track", FILES, step(so="f11_issues_to_reason", it="a02_track_profile") + " SELECT source_id, instrument_index, n_notes FROM so JOIN it USING (source_id, instrument_index)")
def _(*tables):
    found = inspected(*tables)
    return found.sources.select("source_id", "instrument_index").join(found.tracks, ["source_id", "instrument_index"]).select("source_id", "instrument_index", "n_notes")


@query("f10_track_rules", "v_notes_dup v_file_bends v_file_controls", step(it="a02_track_profile") + " SELECT source_id, count(*) FILTER (is_drum) AS drums, count(*) FILTER (n_notes < 10) AS short, count(*) FILTER (min_pitch < 41 OR max_pitch > 87) AS outside FROM it GROUP BY source_id")
def _(n, b, c):
    return ins.track_rules(ins.inspect_tracks(n, b, c, RULES), RULES)


@query("a16_top_reasons", FILES, step(so="f11_issues_to_reason") + " SELECT left(reason, 180) AS reason, count(*) AS n FROM so WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def _(*tables):
    return ins.top_reasons(inspected(*tables).sources)


@query("s14_inspection_report", FILES, step(so="f11_issues_to_reason") + " SELECT count(*) AS inspected, count(*) FILTER (compatible) AS compatible, count(*) FILTER (NOT compatible) AS discarded FROM so")
def _(*tables):
    return ins.report_totals(inspected(*tables).sources)


@query("s14_inspection_files", FILES, step(so="f11_issues_to_reason") + " SELECT source_id, CASE WHEN compatible THEN 'compatible' ELSE 'discarded' END AS status, instrument_index, tempo_bpm, meters, n_tracks, coalesce(reason, '-') AS reason FROM so")
def _(*tables):
    status = F.when(F.col("compatible"), "compatible").otherwise("discarded").alias("status")
    return inspected(*tables).sources.select("source_id", status, "instrument_index", "tempo_bpm", "meters", "n_tracks", F.coalesce("reason", F.lit("-")).alias("reason"))


@query("u01_merge_records", FILES, step(so="f11_issues_to_reason") + " SELECT source_id, CASE WHEN compatible THEN 'accepted' ELSE 'discarded' END AS status, instrument_index, CASE WHEN compatible THEN tempo_bpm END AS tempo_bpm, reason FROM so")
def _(*tables):
    return ins.merged_records(inspected(*tables).sources)


@query("f12_compatible_only", FILES, step(so="f11_issues_to_reason") + """, nx AS (SELECT DISTINCT source_id, instrument_index, onset_tick, end_tick, pitch, velocity FROM v_notes_dup JOIN so USING (source_id, instrument_index)),
pw AS (SELECT source_id, CAST(floor(onset_tick / 7680.0) AS BIGINT) AS phrase_index FROM nx) SELECT source_id, phrase_index, count(*) AS num_notes FROM pw GROUP BY 1, 2""")  # fmt: skip
def _(*tables):
    from ..operators import stages as st

    chosen = inspected(*tables).sources.select("source_id", "instrument_index")
    return e.phrase_window(st.notes_of_tracks(tables[0], chosen)).groupBy("source_id", "phrase_index").agg(F.count("*").alias("num_notes"))
