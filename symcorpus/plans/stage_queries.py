"""Queries of the first stage as a whole: tracks, normal form, labels, variants, contracts, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import contracts as c
from ..operators import events as e
from ..operators import rules as r
from ..operators import sequences as q
from ..operators import splits as sp
from ..operators import stages as st
from ..operators import tokens as t
from ..operators import tonality as ton
from ..sources import runs
from ..views import oracle, view
from .inspection_queries import FILES, N_FILES, inspected
from .registry import QUERIES, SQL, query
from .token_queries import TONIC_LIST, step

#: The given tables are sparse, so two notes make a phrase.
LIMITS = st.Limits(least_notes=2)
VIEWS = f"{FILES} v_sources v_sidecars v_annot v_ranges"


def _splits(d: DataFrame) -> DataFrame:
    return sp.assign_splits(sp.fingerprint(d)).select("source_id", "split")


def _stage(*tables: DataFrame) -> st.Preprocessed:
    """The first stage over the given tables."""
    d, side, a, m = tables[N_FILES:]
    return st.preprocess(tables[0], tables[1], inspected(*tables), _splits(d), st.coverage_label(d, side), a, m, LIMITS, runs.staged)


def _preprocessed(*tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _stage(*tables)[:2]


def _text(techniques: str = "techniques"):
    return F.array_join(F.transform(techniques, lambda x: F.concat(x["type"], F.lit(":"), x["note_index"])), ",")


NORMAL = """wb AS (SELECT b.source_id, b.tick, b.value, b.seq FROM v_file_bends b JOIN k USING (source_id, instrument_index)), fr AS (SELECT source_id, bend_range FROM it JOIN k USING (source_id, instrument_index)),
u AS (SELECT n.source_id, n.instrument_index, min(n.seq) AS seq, n.onset_tick, n.end_tick, n.pitch, n.velocity FROM v_notes_dup n JOIN k USING (source_id, instrument_index) GROUP BY ALL),
ld AS (SELECT source_id, min(onset_tick) AS lead FROM u GROUP BY 1),
bl AS (SELECT source_id, tick, arg_max(value, seq) AS value FROM wb GROUP BY 1, 2), bx AS (SELECT source_id FROM bl GROUP BY 1 HAVING bool_or(value <> 0)),
gw AS (SELECT source_id, 'bends without a range' AS reason FROM bx JOIN ld USING (source_id) LEFT JOIN fr USING (source_id) WHERE coalesce(bend_range, 0) <= 0
  UNION ALL SELECT DISTINCT source_id, 'bend beyond six semitones' FROM bl JOIN bx USING (source_id) JOIN ld USING (source_id) JOIN fr USING (source_id) WHERE bend_range > 0 AND abs(value * bend_range / 8192.0) > 6 + 1e-9),
ws AS (SELECT bl.source_id, tick - lead AS tick, CAST(round_even(value * bend_range / 6.0, 0) AS INT) AS x FROM bl JOIN bx USING (source_id) JOIN ld USING (source_id) JOIN fr USING (source_id) WHERE bend_range > 0),
wc AS (SELECT source_id, greatest(tick, 0) AS tick, arg_max(least(x, 8191), tick) AS value, max(tick) AS own FROM ws GROUP BY 1, 2 HAVING arg_max(x, tick) <> 0 OR max(tick) >= 0)"""
PLAIN = "mv AS (SELECT source_id, instrument_index, seq, onset_tick - lead AS onset_tick, end_tick - lead AS end_tick, pitch, velocity, onset_tick AS source_tick, end_tick AS source_end FROM u JOIN ld USING (source_id)), gn AS (SELECT source_id, min(reason) AS reason FROM gw GROUP BY 1), cv AS (SELECT source_id, tick, value FROM wc WHERE source_id NOT IN (SELECT source_id FROM gn))"
GRID = """ml AS (SELECT source_id, CAST(floor((onset_tick - lead) / 120.0 + 0.5) AS BIGINT) * 120 AS onset_tick, greatest(CAST(floor((end_tick - onset_tick) / 120.0 + 0.5) AS BIGINT), 1) * 120 AS length, pitch, velocity FROM u JOIN ld USING (source_id)),
mg AS (SELECT source_id, onset_tick, onset_tick + length AS end_tick, pitch, velocity FROM ml),
gn AS (SELECT source_id, min(reason) AS reason FROM (SELECT * FROM gw UNION ALL SELECT source_id, 'notes meet on the grid' FROM mg GROUP BY source_id, onset_tick, end_tick, pitch, velocity HAVING count(*) > 1) x GROUP BY 1)"""


CHOSEN = step(so="f11_issues_to_reason", it="a02_track_profile", sk="k03_assign_splits") + ", k AS (SELECT source_id, instrument_index FROM so WHERE compatible), "


@query("x01_normalize_source", f"{FILES} v_sources", CHOSEN + NORMAL + f", {GRID} " + """
SELECT source_id, 'note' AS kind, onset_tick AS tick, end_tick, pitch, velocity, CAST(NULL AS INT) AS value FROM mg WHERE source_id NOT IN (SELECT source_id FROM gn)
UNION ALL SELECT source_id, 'bend', tick, NULL, NULL, NULL, value FROM wc WHERE source_id NOT IN (SELECT source_id FROM gn)
UNION ALL SELECT source_id, reason, NULL, NULL, NULL, NULL, NULL FROM gn""")  # fmt: skip
def _(*tables):
    found = inspected(*tables)
    notes, wheel, gone = st.normalized(st.notes_of_tracks(tables[0], found.sources), *st.wheel_of_tracks(tables[1], found), 120)
    rows = notes.select("source_id", F.lit("note").alias("kind"), F.col("onset_tick").alias("tick"), "end_tick", "pitch", "velocity")
    rows = rows.unionByName(wheel.select("source_id", F.lit("bend").alias("kind"), "tick", "value"), allowMissingColumns=True)
    return rows.unionByName(gone.select("source_id", F.col("reason").alias("kind")), allowMissingColumns=True)


RANK = f"list_position({t.TECHNIQUES}, type)"
STAGE = CHOSEN + NORMAL + f", {PLAIN}," + f"""
pc AS (SELECT *, CAST(floor(onset_tick / 7680.0) AS BIGINT) AS phrase_index FROM mv WHERE source_id NOT IN (SELECT source_id FROM gn)),
pw AS (SELECT source_id, instrument_index, seq, phrase_index, pitch, velocity, onset_tick - phrase_index * 7680 AS onset_tick, least(end_tick, (phrase_index + 1) * 7680) - phrase_index * 7680 AS end_tick, source_tick, source_end FROM pc WHERE least(end_tick, (phrase_index + 1) * 7680) > onset_tick),
pn AS (SELECT *, row_number() OVER (PARTITION BY source_id, phrase_index ORDER BY onset_tick, pitch, end_tick, velocity, seq) - 1 AS note_index FROM pw QUALIFY count(*) OVER (PARTITION BY source_id, phrase_index) >= 2),
pk AS (SELECT * FROM pn WHERE source_id IN (SELECT source_id FROM v_sidecars)),
lt AS (SELECT DISTINCT pk.source_id, phrase_index, note_index, type, target_pitch FROM pk JOIN v_annot a ON a.source_id = pk.source_id AND a.onset_tick = source_tick AND a.end_tick = source_end AND a.pitch = pk.pitch AND a.velocity = pk.velocity),
lm AS (SELECT source_id, phrase_index, note_index, EXISTS (SELECT 1 FROM v_ranges g WHERE g.source_id = pk.source_id AND g.start_tick <= pk.source_tick AND pk.source_tick < g.end_tick) AS muted FROM pk),
ls AS (SELECT *, coalesce(lag(muted) OVER (PARTITION BY source_id, phrase_index ORDER BY note_index), false) AS before FROM lm),
lb AS (SELECT * FROM lt UNION ALL SELECT source_id, phrase_index, note_index, CASE WHEN muted THEN 'PALM_MUTE_ON' ELSE 'PALM_MUTE_OFF' END, NULL FROM ls WHERE muted <> before),
la AS (SELECT source_id, phrase_index, string_agg(type || ':' || note_index, ',' ORDER BY note_index, {RANK}, type) AS techniques, min(CASE WHEN type LIKE 'SLIDE%' THEN target_pitch END) AS slide_lo, max(CASE WHEN type LIKE 'SLIDE%' THEN target_pitch END) AS slide_hi FROM lb GROUP BY 1, 2),
bn AS (SELECT source_id, phrase_index, any_value(instrument_index) AS instrument_index, count(*) AS num_notes, min(pitch) AS lo, max(pitch) AS hi, max(end_tick) AS last_end FROM pn GROUP BY 1, 2),
ev AS (SELECT bn.source_id, phrase_index, count(*) AS n, count(*) FILTER (value <> 0) AS e, bool_or(tick = phrase_index * 7680) AS at0, arg_max(value, tick) AS fin FROM bn JOIN cv ON cv.source_id = bn.source_id AND tick >= phrase_index * 7680 AND tick < (phrase_index + 1) * 7680 GROUP BY 1, 2),
ca AS (SELECT bn.source_id, phrase_index, coalesce(arg_max(value, tick), 0) AS carried FROM bn LEFT JOIN cv ON cv.source_id = bn.source_id AND tick < phrase_index * 7680 GROUP BY 1, 2),
wf AS (SELECT source_id, phrase_index, carried <> 0 AND NOT coalesce(at0, false) AS si, coalesce(fin, carried) <> 0 AS sr, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM ca LEFT JOIN ev USING (source_id, phrase_index)),
fx AS (SELECT bn.source_id, phrase_index, CAST(o AS INT) AS semitones, split, instrument_index, num_notes, CASE WHEN live THEN n + si::INT + sr::INT ELSE 0 END AS num_bends, CASE WHEN live THEN e + si::INT ELSE 0 END AS num_expressive,
  CASE WHEN live AND e + si::INT > 0 THEN 6 END AS bend_range, live AND si AS synthetic_initial, live AND sr AS synthetic_reset, CASE WHEN bn.source_id IN (SELECT source_id FROM v_sidecars) THEN 'COMPLETE' ELSE 'UNLABELED' END AS coverage, coalesce(techniques, '') AS techniques, last_end
  FROM bn JOIN sk USING (source_id) JOIN (SELECT *, e + si::INT > 0 AS live FROM wf) w USING (source_id, phrase_index) LEFT JOIN la USING (source_id, phrase_index), range(-6, 7) g(o)
  WHERE (split = 'train' OR o = 0) AND least(lo, slide_lo) + o >= 38 AND greatest(hi, slide_hi) + o <= 90)"""
FRAGMENT_COLUMNS = "source_id, phrase_index, semitones, split, instrument_index, num_notes, num_bends, num_expressive, bend_range, synthetic_initial, synthetic_reset, coverage, techniques"


@query("x05_preprocess", VIEWS, STAGE + f" SELECT {FRAGMENT_COLUMNS} FROM fx")
def _(*tables):
    return _preprocessed(*tables)[1].withColumn("techniques", _text()).select(*FRAGMENT_COLUMNS.split(", "))


SOURCES = STAGE + """, nb AS (SELECT source_id, count(DISTINCT phrase_index) AS num_base_fragments FROM bn GROUP BY 1), nf AS (SELECT source_id, count(*) AS num_fragments FROM fx GROUP BY 1),
sz AS (SELECT so.source_id, split, so.instrument_index, CASE WHEN so.reason IS NOT NULL THEN so.reason WHEN gn.reason IS NOT NULL THEN gn.reason WHEN num_base_fragments IS NULL THEN 'no phrase of enough notes' WHEN num_fragments IS NULL THEN 'no variant inside the pitches' END AS reason,
  coalesce(num_base_fragments, 0) AS num_base_fragments, coalesce(num_fragments, 0) AS num_fragments FROM so LEFT JOIN sk USING (source_id) LEFT JOIN gn USING (source_id) LEFT JOIN nb USING (source_id) LEFT JOIN nf USING (source_id))"""


@query("x05_sources", VIEWS, SOURCES + " SELECT source_id, split, instrument_index, reason IS NULL AS compatible, reason, num_base_fragments, num_fragments FROM sz")
def _(*tables):
    return _preprocessed(*tables)[0]


@query("x03_project_labels", VIEWS, STAGE + " SELECT source_id, phrase_index, semitones, note_index, type FROM fx JOIN lb USING (source_id, phrase_index)")
def _(*tables):
    return _preprocessed(*tables)[1].select("source_id", "phrase_index", "semitones", F.inline("techniques")).select("source_id", "phrase_index", "semitones", "note_index", "type")


@query("t16_coverage_label", "v_sources v_sidecars", "SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM v_sidecars) THEN 'COMPLETE' ELSE 'UNLABELED' END AS coverage FROM v_sources")
def _(d, side):
    return st.coverage_label(d, side)


@query("a11_coverage_summary", "v_cover", "SELECT coverage, count(*) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM v_cover GROUP BY coverage")
def _(d):
    return d.groupBy("coverage").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


METHODS = ["MANUAL", "AUTO_SOURCE", "AUTO_PHRASE", "UNKNOWN"]
LABELS = {"technique": t.TECHNIQUES, "coverage": ["COMPLETE", "UNLABELED"], "bends": ["total", "sequences"], "tonic": [*ton.TONICS, "UNKNOWN"], "mode": [*ton.MODES, "UNKNOWN"], "method": METHODS}
LABEL_ROWS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, unnest({names}) AS name" for d, names in LABELS.items())


@query("a11_label_summary", f"{VIEWS} v_lead", STAGE.replace("WITH ", f"WITH lx AS ({SQL['x04_resolve_tonality']}), ", 1) + f""", al AS (SELECT fx.*, tonic, mode, method FROM fx JOIN lx USING (source_id)),
ar AS (SELECT 'technique' AS dimension, split_part(x, ':', 1) AS name, 1 AS n FROM (SELECT unnest(string_split(techniques, ',')) AS x FROM al WHERE techniques <> '') y UNION ALL SELECT 'coverage', coverage, 1 FROM al
 UNION ALL SELECT 'bends', 'total', num_bends FROM al UNION ALL SELECT 'bends', 'sequences', (num_bends > 0)::INT FROM al UNION ALL SELECT 'tonic', tonic, 1 FROM al UNION ALL SELECT 'mode', mode, 1 FROM al UNION ALL SELECT 'method', method, 1 FROM al)
SELECT d.dimension, d.name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM ({LABEL_ROWS}) d LEFT JOIN ar ON ar.dimension = d.dimension AND ar.name = d.name GROUP BY 1, 2""")  # fmt: skip
def _(*tables):
    from .token_queries import _resolved

    rows = _preprocessed(*tables[:-1])[1].join(_resolved(tables[-1]).select("source_id", "tonic", "mode", "method"), "source_id")
    return st.label_summary(rows, LABELS)


@query("a15_run_totals", VIEWS, STAGE + " SELECT split, count(*) AS samples, CAST(sum(num_notes) AS BIGINT) AS notes, CAST(sum(num_bends) AS BIGINT) AS bends, CAST(sum(CASE WHEN techniques = '' THEN 0 ELSE len(string_split(techniques, ',')) END) AS BIGINT) AS techniques FROM fx GROUP BY 1")
def _(*tables):
    return st.run_totals(_preprocessed(*tables)[1])


@query("f04_misplaced_global_meta", "v_headers v_meta", """
SELECT source_id, reason FROM (SELECT h.source_id, CASE WHEN file_type = 2 THEN 'asynchronous file type 2' WHEN ppq <= 0 THEN 'ticks per beat not positive' WHEN file_type = 0 AND n_tracks <> 1 THEN 'file type 0 with more than one track'
 WHEN file_type = 1 AND kinds IS NOT NULL THEN 'global events outside track 0: ' || kinds END AS reason
 FROM v_headers h LEFT JOIN (SELECT source_id, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM v_meta WHERE track > 0 AND kind <> 'text' GROUP BY 1) m USING (source_id)) x WHERE reason IS NOT NULL""")  # fmt: skip
def _(h, m):
    return c.header_issues(h, m)


RUN = "processed/run"
#: Each residue of a fragment's number spoils one field of its declaration; the rules that must say so.
SPOILED = {
    0: ("num_notes", "0", ["no notes"]), 1: ("track_number", "instrument_index + 1", ["track and instrument differ"]), 2: ("split", "'dev'", ["unknown split", "split differs from its source", "file outside the folder of its split"]),
    3: ("num_bends", "num_expressive - 1", []), 4: ("output_sha256", "'00'", ["malformed hash"]), 5: ("output_size_bytes", "0", ["empty file"]), 6: ("coverage", "'PARTIAL'", ["unknown coverage"]),
    7: ("nominal_duration", "0.0", ["duration not positive"]), 8: ("output_file", "'elsewhere/x.mid'", ["file outside the run"]), 9: ("output_file", "concat('processed/run/', split, '/x.wav')", ["no MIDI file"]),
    10: ("tonic", "'H'", ["unknown tonality"]), 11: ("mode", "NULL", ["missing mode"]), 12: ("source_id", "-source_id - 1", ["absent or incompatible source"]), 13: ("phrase_index", "-1", ["phrase index below zero"]),
}
NUMBER = "(source_id * 31 + phrase_index * 7 + semitones + 6) % 19"


def _declared(tables) -> tuple[DataFrame, DataFrame]:
    """Declared fragments, one field of most of them spoiled, and their sources."""
    from .token_queries import _resolved

    sources, made = _preprocessed(*tables[:-1])
    return sources, spoiled(declared(made, _resolved(tables[-1])))


def declared(made: DataFrame, tonality: DataFrame) -> DataFrame:
    """Fragments as their files are declared, with their own tonic, and a number that says which field will be spoiled.

    They are joined by sorting, as files of fragments are small and their rows are not: the driver would broadcast them whole.
    """
    name = F.concat(F.lit("src"), F.col("source_id"), F.lit("_"), F.col("phrase_index"), F.lit("_"), F.col("semitones"))
    return made.join(tonality.select("source_id", "tonic", "mode").hint("merge"), "source_id").withColumns({
        "tonic": s.transpose_tonic(F.col("tonic"), F.col("semitones")), "number": F.expr(NUMBER), "track_number": F.col("instrument_index"), "output_file": F.concat(F.lit(f"{RUN}/"), "split", F.lit("/"), name, F.lit(".mid")), "output_sha256": F.sha2(name, 256),
        "output_size_bytes": F.col("num_notes") * 8 + 40, "nominal_duration": F.lit(7680 / 960.0), "actual_duration": F.col("last_end") / 960.0,
    })


def spoiled(rows: DataFrame) -> DataFrame:
    whole = rows
    for k, (field, value, _) in SPOILED.items():
        whole = whole.withColumn(field, F.when(F.col("number") == k, F.expr(value).cast(rows.schema[field].dataType)).otherwise(F.col(field)))
    return whole


def _expected() -> str:
    parts = [f"SELECT {k} AS number, unnest({rules}) AS rule" for k, (_, _, rules) in SPOILED.items() if rules]
    return " UNION ALL ".join(parts)


BROKEN = f"""fn AS (SELECT *, {NUMBER} AS number FROM fx), xr AS ({_expected()}), fb AS (SELECT fn.*, rule FROM fn JOIN xr USING (number)
 UNION ALL SELECT *, 'more expressive bends than bends' FROM fn WHERE number = 3
 UNION ALL SELECT *, 'bend count below zero' FROM fn WHERE number = 3 AND num_expressive = 0 UNION ALL SELECT *, 'label outside the notes' FROM fn WHERE number = 0 AND techniques <> ''),
fr2 AS (SELECT CASE WHEN number = 12 THEN -source_id - 1 ELSE source_id END AS source_id, CASE WHEN number = 13 THEN -1 ELSE phrase_index END AS phrase_index, semitones, rule FROM fb)"""


@query("f13_fragment_contract", f"{VIEWS} v_lead", STAGE + f", {BROKEN} SELECT * FROM fr2")
def _(*tables):
    sources, rows = _declared(tables)
    return c.fragment_issues(rows, sources, RUN)


@query("j06_source_of_fragment", VIEWS, STAGE + f""" SELECT CASE WHEN {NUMBER} = 12 THEN -source_id - 1 ELSE source_id END AS source_id, phrase_index, semitones, {NUMBER} <> 12 AS known,
 CASE WHEN {NUMBER} <> 12 THEN {NUMBER} <> 2 END AS same_split, CASE WHEN {NUMBER} <> 12 THEN {NUMBER} <> 1 END AS same_track FROM fx""")  # fmt: skip
def _(*tables):
    sources, made = _preprocessed(*tables)
    at = lambda k, column, value: F.when(F.expr(NUMBER) == k, value).otherwise(F.col(column)).alias(column)
    rows = made.select(at(12, "source_id", -F.col("source_id") - 1), "phrase_index", "semitones", at(2, "split", F.lit("dev")), at(1, "instrument_index", F.col("instrument_index") + 1))
    return c.source_of_fragment(rows, sources)


def _flat(made: DataFrame) -> DataFrame:
    return made.withColumn("techniques", _text()).select(*FRAGMENT_COLUMNS.split(", "))


def _published(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Writes the manifest of the given tables with a stray run and undeclared rows beside it; its root and run id."""
    sources, made = _preprocessed(*[view(spark, sf_dir, v) for v in VIEWS.split()])
    ids = sp.run_id(sp.fingerprint(view(spark, sf_dir, "v_sources"))).first()[0]
    root = f"{runs.shared_root(spark)}/manifest-{ids}"
    rows = _flat(made)
    runs.publish(rows.filter("semitones = 0").withColumn("num_notes", F.lit(-1).cast("long")), root, "stray")
    runs.write_manifest(root, ids, {"least_notes": LIMITS.least_notes, "pitches": [LIMITS.pitch_low, LIMITS.pitch_high]}, sources.withColumn("split", F.coalesce("split", F.lit("none"))), rows)
    return root, ids


def _write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _published(spark, sf_dir)
    held = runs.read_manifest(spark, root)
    counts = held.sources.agg(F.count("*").alias("discovered_files"), F.count_if("compatible").alias("compatible_sources"), F.count_if(~F.col("compatible")).alias("discarded_sources"))
    return counts.crossJoin(held.fragments.agg(F.count("*").alias("generated_fragments")))  # one row each


QUERIES["s08_write_manifest"] = _write_manifest
SQL["s08_write_manifest"] = oracle(SOURCES + " SELECT count(*) AS discovered_files, count(*) FILTER (reason IS NULL) AS compatible_sources, count(*) FILTER (reason IS NOT NULL) AS discarded_sources, (SELECT count(*) FROM fx) AS generated_fragments FROM sz")
QUERIES["s09_read_manifest"] = lambda spark, sf_dir: runs.read_manifest(spark, _published(spark, sf_dir)[0]).fragments.select(*FRAGMENT_COLUMNS.split(", "))
SQL["s09_read_manifest"] = SQL["x05_preprocess"]


def _prints(d: DataFrame) -> DataFrame:
    return sp.fingerprint(d).select(F.col("source_id").alias("key"), "sha256")


@query("s03_guarded_commit", "v_sources", """WITH b AS (SELECT source_id AS key, CASE WHEN source_id % 50 = 0 THEN 'removed' WHEN source_id % 50 = 1 THEN 'changed' END AS status, source_id % 3 AS part FROM v_sources),
f AS (SELECT key, status FROM b WHERE status IS NOT NULL ORDER BY key LIMIT 5), n AS (SELECT count(*) AS n, count(*) FILTER (part = 1) AS m FROM b)
SELECT 1 AS attempt, 'committed' AS outcome, n AS rows_of_current FROM n UNION ALL SELECT 2, (SELECT count(*) FILTER (status IS NOT NULL) FROM b) || ' inputs changed before publication: ' || (SELECT string_agg(key || ' (' || status || ')', ', ' ORDER BY key) FROM f), n FROM n
UNION ALL SELECT 3, 'committed', m FROM n UNION ALL SELECT 4, 'version 2 of the current run was made by another writer', m FROM n UNION ALL SELECT 5, 'run fragments-one exists with other content', m FROM n""")  # fmt: skip
def _(d):
    """Five attempts on one root: a clean one, one whose inputs drift, a second version, one that follows a version already followed, another content under a known id."""
    spark, root = d.sparkSession, f"{runs.shared_root(d.sparkSession)}/guarded-{uuid.uuid4().hex}"
    sources = d.select("source_id", (F.col("source_id") % 2 == 0).alias("compatible"), F.lit("all").alias("split"))
    part = lambda k: sources.filter(F.col("source_id") % 3 == k)
    text = F.when(F.col("source_id") % 50 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    drifted = lambda: (_prints(d), _prints(d.filter("source_id % 50 <> 0").withColumn("content", text)))
    tries = [("one", sources, lambda: (_prints(d), _prints(d)), None), ("two", part(0), drifted, None), ("three", part(1), None, 1), ("four", part(2), None, 1), ("one", part(2), None, None)]
    told = []
    for k, (name, rows, recheck, follows) in enumerate(tries, 1):
        try:
            runs.write_manifest(root, name, {}, sources, rows, recheck, follows)
            outcome = "committed"
        except (runs.Drift, runs.Conflict, ValueError) as stopped:
            outcome = str(stopped)
        told.append((k, outcome, runs.read_manifest(spark, root).fragments.count()))
    return spark.createDataFrame(told, "attempt int, outcome string, rows_of_current long")


@query("s07_publish_run", "v_notes v_sources", step(x="x02_transpose", sk="k03_assign_splits") + "SELECT source_id, phrase_index, semitones, num_notes, split FROM x JOIN sk USING (source_id)")
def _(n, d):
    rows = e.transposed(e.phrase_window(n), -6, 6, 38, 90).join(_splits(d), "source_id")
    ids = sp.run_id(sp.fingerprint(d)).first()[0]
    root = f"{runs.shared_root(n.sparkSession)}/variants"
    runs.publish(rows, root, ids)
    return runs.read(n.sparkSession, root, ids)
