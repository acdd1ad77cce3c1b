"""Queries of tonality and token streams; their SQL nests the SQL of the steps before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TONICS
from ..operators import events as e
from ..operators import grids as gr
from ..operators import splits as sp
from ..operators import tokens as t
from ..operators import tonality as ton
from ..sources import runs
from ..views import oracle, view
from .registry import QUERIES, SQL, query

BPM = 120.0
VOCABULARY_SIZE = sum(n for _, n in t.families())


def step(**names: str) -> str:
    """WITH clauses that hold the SQL of other queries."""
    return "WITH " + ", ".join(f"{k} AS ({SQL[v]})" for k, v in names.items())


MODE_ROWS = ", ".join(f"('{name}', {i}, {steps})" for i, (name, steps) in enumerate(ton.MODES.items()))
TONIC_LIST = "['" + "', '".join(TONICS) + "']"
SCORED = f"""{step(tw="a05_pitch_class_profile", tb="a06_bass_profile")},
md(mode, o, steps) AS (VALUES {MODE_ROWS}),
tt AS (SELECT source_id, sum(weight) AS all_w FROM tw GROUP BY 1), tv AS (SELECT source_id, sum(votes) AS all_v, min(first_bass) AS fb, min(last_bass) AS lb FROM tb GROUP BY 1),
cd AS (SELECT source_id, all_w, all_v, fb, lb, p AS pc, mode, o, steps FROM tt JOIN tv USING (source_id), range(12) r(p), md),
ci AS (SELECT cd.source_id, cd.pc, cd.o, sum(weight) AS w, count(*) AS present FROM cd JOIN tw ON tw.source_id = cd.source_id AND list_contains(steps, (tw.pitch_class - cd.pc + 12) % 12) GROUP BY ALL),
cs AS (SELECT cd.source_id, cd.pc, cd.o, cd.mode, round(5 * coalesce(ci.w, 0) / all_w - 3 * (1 - coalesce(ci.w, 0) / all_w) + 1.5 * coalesce(a.weight, 0) / all_w + coalesce(b.votes, 0) / all_v
         + 0.35 * coalesce(f.weight, 0) / all_w + 0.5 * (fb = cd.pc)::INT + 0.75 * (lb = cd.pc)::INT + 0.25 * coalesce(present, 0) / len(steps), 9) AS score
       FROM cd LEFT JOIN ci ON ci.source_id = cd.source_id AND ci.pc = cd.pc AND ci.o = cd.o LEFT JOIN tw a ON a.source_id = cd.source_id AND a.pitch_class = cd.pc
       LEFT JOIN tw f ON f.source_id = cd.source_id AND f.pitch_class = (cd.pc + 7) % 12 LEFT JOIN tb b ON b.source_id = cd.source_id AND b.bass = cd.pc),
cr AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, pc, o) AS r FROM cs)"""
LABELLED = SCORED + f""", ct AS (SELECT source_id, pc, max(score) AS s FROM cs GROUP BY 1, 2), cq AS (SELECT source_id, s, row_number() OVER (PARTITION BY source_id ORDER BY s DESC) AS k FROM ct),
cm AS (SELECT cs.source_id, cs.score, row_number() OVER (PARTITION BY cs.source_id ORDER BY cs.score DESC) AS k FROM cs JOIN cr ON cr.source_id = cs.source_id AND cr.pc = cs.pc AND cr.r = 1),
cc AS (SELECT w.source_id, {TONIC_LIST}[w.pc + 1] AS tonic, w.mode, greatest(w.score - q.s, 0) AS tm, greatest(w.score - m.score, 0) AS mm
       FROM cr w JOIN cq q ON q.source_id = w.source_id AND q.k = 2 JOIN cm m ON m.source_id = w.source_id AND m.k = 2 WHERE w.r = 1)"""


@query("a07_score_tonality", "v_lead", SCORED + f" SELECT source_id, {TONIC_LIST}[pc + 1] AS tonic, mode FROM cr WHERE r = 1")
def _(n):
    return ton.infer(n).select("source_id", "tonic", "mode")


@query("a08_margin_confidence", "v_lead", LABELLED + " SELECT source_id, tonic, mode, round(tm / (1 + tm), 6) AS tonic_confidence, round(mm / (1 + mm), 6) AS mode_confidence FROM cc")
def _(n):
    return ton.infer(n)


def _manual(n: DataFrame) -> DataFrame:
    """Manual labels of every fifth source, from its first note."""
    first = n.filter("source_id % 5 = 0").groupBy("source_id").agg(F.min("pitch").alias("p"))
    return first.select("source_id", F.get(F.array(*map(F.lit, TONICS)), F.col("p") % 12).alias("tonic"), F.lit("MINOR").alias("mode"))


def _resolved(n: DataFrame) -> DataFrame:
    n = runs.staged(n)  # profiles and labels read it many times
    return ton.resolve(n.select("source_id").distinct(), _manual(n), ton.infer(n.filter("source_id % 7 <> 0")), "infer_source")


@query("x04_resolve_tonality", "v_lead", step(au="a08_margin_confidence") + f""", so AS (SELECT source_id, min(pitch) AS p FROM v_lead GROUP BY 1)
SELECT so.source_id, CASE WHEN so.source_id % 5 = 0 THEN {TONIC_LIST}[p % 12 + 1] WHEN so.source_id % 7 <> 0 THEN tonic ELSE 'UNKNOWN' END AS tonic,
 CASE WHEN so.source_id % 5 = 0 THEN 'MINOR' WHEN so.source_id % 7 <> 0 THEN mode ELSE 'UNKNOWN' END AS mode,
 CASE WHEN so.source_id % 5 = 0 THEN 'MANUAL' WHEN so.source_id % 7 <> 0 THEN 'AUTO_SOURCE' ELSE 'UNKNOWN' END AS method,
 CASE WHEN so.source_id % 5 <> 0 AND so.source_id % 7 <> 0 THEN tonic_confidence END AS tonic_confidence, CASE WHEN so.source_id % 5 <> 0 AND so.source_id % 7 <> 0 THEN mode_confidence END AS mode_confidence
FROM so JOIN au USING (source_id)""")  # fmt: skip
def _(n):
    return _resolved(n)


@query("p10_validate_tonality", "v_lead", step(la="x04_resolve_tonality") + """, lb AS (SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'UNKNOWN' ELSE tonic END AS tonic, mode, method, CASE WHEN source_id % 4 <> 0 THEN tonic_confidence END AS tc, mode_confidence AS mc FROM la),
li AS (SELECT source_id, concat_ws('; ', CASE WHEN tonic = 'UNKNOWN' AND mode <> 'UNKNOWN' THEN 'mode without tonic' END, CASE WHEN method LIKE 'AUTO%' AND (tc IS NULL OR mc IS NULL OR tc NOT BETWEEN 0 AND 1 OR mc NOT BETWEEN 0 AND 1) THEN 'confidence missing' END,
 CASE WHEN method NOT LIKE 'AUTO%' AND (tc IS NOT NULL OR mc IS NOT NULL) THEN 'confidence not allowed' END) AS issues FROM lb)
SELECT source_id, issues FROM li WHERE issues <> ''""")  # fmt: skip
def _(n):
    spoiled = _resolved(n).withColumn("tonic", F.when(F.col("source_id") % 3 == 0, "UNKNOWN").otherwise(F.col("tonic"))).withColumn("tonic_confidence", F.when(F.col("source_id") % 4 != 0, F.col("tonic_confidence")))
    return ton.label_issues(spoiled)


@query("k04_tonality_review", "v_lead", step(la="x04_resolve_tonality") + """ SELECT source_id, tonic, mode, CASE WHEN tonic_confidence IS NULL THEN '-' ELSE printf('%.3f', tonic_confidence) END AS tonic_confidence,
 CASE WHEN mode_confidence IS NULL THEN '-' ELSE printf('%.3f', mode_confidence) END AS mode_confidence FROM la ORDER BY coalesce(la.mode_confidence, 1.0), coalesce(la.tonic_confidence, 1.0), source_id LIMIT 20""")  # fmt: skip
def _(n):
    return ton.review(_resolved(n), 20)


NAME_SQL = "SELECT seq, replace(replace(upper(trim({x})), '-', '_'), ' ', '_') AS x FROM v_notes"
SPELLINGS = [" c#", "Db ", "e-flat", "g sharp", "A#", "unknown", "f", "Bb", "d"]
MODE_SPELLINGS = ["ionian", " Aeolian", "natural minor", "harmonic-minor", "blues", "Phrygian Dominant", "loud"]


def _alias_case(column: str, aliases: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items()) + f" ELSE {column} END"


def _normal(n: DataFrame, names: list[str], aliases: dict[str, str], known: list[str]) -> DataFrame:
    from ..functions.scalars import normalized_name

    raw = F.get(F.array(*map(F.lit, names)), (F.col("seq") % len(names)).cast("int"))
    rows = n.select("seq", normalized_name(raw, aliases).alias("name"))
    return rows.groupBy("name", F.col("name").isin(known).alias("known")).agg(F.count("*").alias("n"))


def _name_sql(names: list[str], aliases: dict[str, str], known: list[str]) -> str:
    clean = NAME_SQL.format(x=f"{names}[seq % {len(names)} + 1]")
    return f"WITH ns AS ({clean}), nn AS (SELECT {_alias_case('x', aliases)} AS name FROM ns) SELECT name, name IN ({str(known)[1:-1]}) AS known, count(*) AS n FROM nn GROUP BY 1, 2"


def _names() -> None:
    from ..functions.scalars import MODE_ALIASES, TONIC_ALIASES

    tonics, modes = [*TONICS, "UNKNOWN"], [*ton.MODES, "UNKNOWN"]
    query("p07_normalize_tonic", "v_notes", _name_sql(SPELLINGS, TONIC_ALIASES, tonics))(lambda n: _normal(n, SPELLINGS, TONIC_ALIASES, tonics))
    query("p08_normalize_mode", "v_notes", _name_sql(MODE_SPELLINGS, MODE_ALIASES, modes))(lambda n: _normal(n, MODE_SPELLINGS, MODE_ALIASES, modes))


_names()

GRID = """gn AS (SELECT p.source_id, p.phrase_index, p.seq, v.pitch, CAST(floor(p.onset_tick / 20.0 + 0.5) AS BIGINT) AS cell, p.end_tick - p.onset_tick AS len FROM pw p JOIN v_lead v USING (source_id, seq)),
gq AS (SELECT *, greatest(CAST(floor(len / 20.0 + 0.5) AS BIGINT), 1) AS g, least(greatest(CAST(floor(len / 120.0 + 0.5) AS BIGINT), 16), 64) AS q FROM gn),
gd AS (SELECT *, CASE WHEN g < 96 THEN g * 20 ELSE q * 120 END AS ticks, CASE WHEN g < 96 THEN 'Duration_' || (g // 24) || '.' || (g % 24) || '.24' ELSE 'Duration_' || (q // 4) || '.' || (q % 4) || '.4' END AS dur FROM gq)"""
ENCODE = step(pw="w03_phrase_window", sl="w05_slice_bends") + f""", {GRID},
gb AS (SELECT source_id, phrase_index, cell, arg_max(value, tick) AS value FROM (SELECT *, CAST(floor(tick / 20.0 + 0.5) AS BIGINT) AS cell FROM sl) x WHERE (source_id, phrase_index) IN (SELECT (source_id, phrase_index) FROM gd) GROUP BY 1, 2, 3),
ge AS (SELECT source_id, phrase_index, cell, 2 AS kind, 0 AS a, 0 AS b, 0 AS c, 0 AS part, 'PitchBend_' || CAST(trunc(floor((value + 8191) / 255.96875 + 0.5) * 255.96875 - 8191) AS INT) AS token FROM gb
  UNION ALL SELECT source_id, phrase_index, cell, 3, pitch, ticks, seq, 0, 'Pitch_' || pitch FROM gd
  UNION ALL SELECT source_id, phrase_index, cell, 3, pitch, ticks, seq, 1, dur FROM gd
  /*labels*/
  UNION ALL SELECT DISTINCT source_id, phrase_index, 0, 1, 0, 0, 0, 0, 'Tempo_121.29' FROM gd),
gl AS (SELECT source_id, phrase_index, max(l) AS l FROM (SELECT source_id, phrase_index, cell // 96 AS l FROM ge UNION ALL SELECT source_id, phrase_index, (cell * 20 + ticks - 1) // 1920 FROM gd) x GROUP BY 1, 2),
ga AS (SELECT * FROM ge UNION ALL SELECT DISTINCT source_id, phrase_index, cell, 0, 0, 0, 0, 0, 'Position_' || (cell % 96) FROM ge
  UNION ALL SELECT source_id, phrase_index, bar * 96, -1, 0, 0, 0, 0, 'Bar_None' FROM (SELECT source_id, phrase_index, unnest(range(0, l + 1)) AS bar FROM gl) x)
SELECT source_id, phrase_index, row_number() OVER (PARTITION BY source_id, phrase_index ORDER BY cell, kind, a, b, c, part) - 1 AS pos, token FROM ga"""
LABEL_ORDER = str(t.TECHNIQUES)
LABELS = f"UNION ALL SELECT gd.source_id, phrase_index, cell, 3, gd.pitch, ticks, gd.seq, 1 + list_position({LABEL_ORDER}, type), 'Technique_' || type FROM gd JOIN (SELECT DISTINCT source_id, seq, type FROM v_annot) la ON la.source_id = gd.source_id AND la.seq = gd.seq"


@query("t02_quantize_to_grid", "v_lead", step(pw="w03_phrase_window") + f", {GRID} SELECT source_id, seq, cell // 96 AS bar, cell % 96 AS position, dur AS duration FROM gd")
def _(n):
    d = e.phrase_window(n)
    cell = F.floor(F.col("onset_tick") / t.CELL + F.lit(0.5)).cast("long")
    return d.select("source_id", "seq", F.floor(cell / t.BAR).alias("bar"), (cell % t.BAR).alias("position"), F.concat(F.lit("Duration_"), t.duration_text(t.grid(F.col("end_tick") - F.col("onset_tick")))).alias("duration"))


SETTINGS = """gs AS (SELECT p_brand AS grid_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS ord, p_size, p_partkey FROM part),
gr AS (SELECT grid_id, ord, CASE WHEN ord = 1 THEN CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END ELSE 4 * (ord - 1) + CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END END AS start_beat, CASE WHEN p_size % 50 = 7 THEN 4 * (ord - 1) ELSE 4 * ord END AS end_beat, CASE WHEN p_partkey % 11 = 0 THEN 65 + p_size ELSE 1 + p_size % 24 END AS resolution FROM gs WHERE ord <= 3)"""
GRID_RULES = f"""WITH {SETTINGS}, gw AS (SELECT *, lag(end_beat) OVER (PARTITION BY grid_id ORDER BY ord) AS was FROM gr),
gi AS (SELECT grid_id, ord, unnest(list_filter([CASE WHEN start_beat >= end_beat OR end_beat > 64 THEN 'range of beats' END, CASE WHEN resolution NOT BETWEEN 1 AND 64 THEN 'resolution' END, CASE WHEN ord = 1 AND start_beat <> 0 THEN 'does not start at beat 0' END,
  CASE WHEN ord > 1 AND start_beat <> was THEN 'does not follow the range before' END], lambda x: x IS NOT NULL)) AS rule FROM gw)"""


def _settings(parts: DataFrame) -> DataFrame:
    """Three ranges for each brand, some of which break a rule."""
    first = F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)
    rows = parts.withColumn("ord", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).filter("ord <= 3")
    start = F.when(F.col("ord") == 1, first).otherwise(4 * (F.col("ord") - 1) + F.when(F.col("p_size") % 10 == 0, 1).otherwise(0))
    end = F.when(F.col("p_size") % 50 == 7, 4 * (F.col("ord") - 1)).otherwise(4 * F.col("ord"))
    steps = F.when(F.col("p_partkey") % 11 == 0, 65 + F.col("p_size")).otherwise(1 + F.col("p_size") % 24)
    return rows.select(F.col("p_brand").alias("grid_id"), "ord", start.alias("start_beat"), end.alias("end_beat"), steps.alias("resolution"))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")


QUERIES["t02_grid_issues"] = lambda spark, sf_dir: gr.grid_issues(_settings(_part(spark, sf_dir)))
SQL["t02_grid_issues"] = oracle(GRID_RULES + " SELECT grid_id, ord, rule FROM gi")


def _on_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each brand's grid takes the lengths of the notes whose number ends in it
    brands = F.concat(F.lit("Brand#"), F.col("seq") % 5 + 1, F.floor(F.col("seq") / 5) % 5 + 1)
    rows = view(spark, sf_dir, "v_notes").select("seq", brands.alias("grid_id"), ((F.col("end_tick") - F.col("onset_tick")) * 7).alias("ticks"))
    return gr.on_grids(rows, "ticks", _settings(_part(spark, sf_dir)), 480).select("seq", "grid_id", "length")


QUERIES["t02_on_grids"] = _on_grids
SQL["t02_on_grids"] = oracle(GRID_RULES + """, gk AS (SELECT DISTINCT grid_id, start_beat * 480 + CAST(floor(k * 480 / resolution) AS BIGINT) AS x FROM gr, unnest(range(1, 12 * 24 + 1)) u(k) WHERE k <= (end_beat - start_beat) * resolution AND grid_id NOT IN (SELECT grid_id FROM gi)),
gt AS (SELECT seq, 'Brand#' || (seq % 5 + 1) || ((seq // 5) % 5 + 1) AS grid_id, (end_tick - onset_tick) * 7 AS ticks FROM v_notes)
SELECT seq, gt.grid_id, arg_min(x, (abs(x - ticks), -x)) AS length FROM gt LEFT JOIN gk ON gk.grid_id = gt.grid_id GROUP BY 1, 2""")  # fmt: skip


def _encoded(n: DataFrame, b: DataFrame, a: DataFrame | None = None) -> DataFrame:
    return t.encode(e.phrase_window(n), e.slice_bends(b), F.lit(BPM), a)


@query("t03_encode_events", "v_lead v_bends", ENCODE)
def _(n, b):
    return _encoded(n, b)


@query("t04_insert_postfix_labels", "v_lead v_bends v_annot", ENCODE.replace("/*labels*/", LABELS))
def _(n, b, a):
    return _encoded(n, b, a)


STATE = """ty AS (SELECT *, split_part(token, '_', 1) AS type, substr(token, instr(token, '_') + 1) AS value FROM tk),
tz AS (SELECT *, count(*) FILTER (type = 'Bar') OVER w - 1 AS bar, last_value(CASE WHEN type = 'Position' THEN CAST(value AS INT) END IGNORE NULLS) OVER w AS position,
  last_value(CASE WHEN type = 'Pitch' THEN pos END IGNORE NULLS) OVER w AS note_pos, lead(value) OVER o AS nv, lead(type) OVER o AS nt, lag(type) OVER o AS bt
  FROM ty WINDOW w AS (PARTITION BY source_id, phrase_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), o AS (PARTITION BY source_id, phrase_index ORDER BY pos))"""
PLAIN = step(tk="t03_encode_events") + f", {STATE}"
LABELLED_TOKENS = step(tk="t04_insert_postfix_labels") + f", {STATE}"


@query("t05_extract_postfix_labels", "v_lead v_bends v_annot", LABELLED_TOKENS + "SELECT source_id, phrase_index, note_pos, value AS technique, coalesce(bt IN ('Duration', 'Technique'), false) AS placed FROM tz WHERE type = 'Technique'")
def _(n, b, a):
    return t.extract_labels(_encoded(n, b, a))


@query("t08_decode_tokens", "v_lead v_bends", PLAIN + """, td AS (SELECT source_id, phrase_index, pos, (bar * 96 + position) * 20 AS onset_tick, CAST(value AS INT) AS pitch, [CAST(x AS BIGINT) FOR x IN string_split(nv, '.')] AS p FROM tz WHERE type = 'Pitch')
SELECT source_id, phrase_index, pos AS seq, onset_tick, onset_tick + (p[1] * p[3] + p[2]) * 480 // p[3] AS end_tick, pitch FROM td""")  # fmt: skip
def _(n, b):
    return t.decode(_encoded(n, b))[0]


@query("j09_round_trip_diff", "v_lead v_bends", step(tk="t03_encode_events") + " SELECT count(*) AS n_tokens, CAST(0 AS BIGINT) AS n_different FROM tk")
def _(n, b):
    once = _encoded(n, b)
    twice = t.encode(*t.decode(once), F.lit(BPM))
    both = once.withColumn("side", F.lit(1)).unionByName(twice.withColumn("side", F.lit(-1))).groupBy(*t.PHRASE, "pos", "token").agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("n"))
    return both.agg(F.sum("n").alias("n_tokens"), F.sum(F.abs("d")).alias("n_different"))


LEGAL = ", ".join(f"'{a}>{b}'" for a, then in t.GRAPH.items() for b in then)


@query("j11_legal_transitions", "v_lead v_bends v_annot", LABELLED_TOKENS + f"SELECT type, nt AS next, count(*) AS n, type || '>' || nt IN ({LEGAL}) AS legal FROM tz WHERE nt IS NOT NULL GROUP BY 1, 2")
def _(n, b, a):
    return t.transitions(_encoded(n, b, a))


@query("w15_trim_trailing_bar", "v_lead v_bends", PLAIN + "SELECT source_id, phrase_index, count(*) AS n_tokens, max(pos) FILTER (type <> 'Bar') + 1 AS n_kept FROM tz GROUP BY 1, 2")
def _(n, b):
    tokens = _encoded(n, b)
    kept = t.without_closing_bars(tokens).groupBy(*t.PHRASE).agg(F.count("*").alias("n_kept"))
    return tokens.groupBy(*t.PHRASE).agg(F.count("*").alias("n_tokens")).join(kept, t.PHRASE)


def _family_sql() -> str:
    value = {
        "Pitch": "CAST(i + 21 AS VARCHAR)", "Position": "CAST(i AS VARCHAR)", "Tempo": "printf('%.2f', i * 210 / 31.0 + 40)", "PitchBend": "CAST(CAST(trunc(i * 255.96875 - 8191) AS INT) AS VARCHAR)",
        "Duration": "CASE WHEN i < 95 THEN ((i + 1) // 24) || '.' || ((i + 1) % 24) || '.24' ELSE ((i - 79) // 4) || '.' || ((i - 79) % 4) || '.4' END",
        "Technique": f"{t.TECHNIQUES}[i + 1]", "Tonic": f"{[*TONICS, 'UNKNOWN']}[i + 1]", "Mode": f"{[*ton.MODES, 'UNKNOWN']}[i + 1]",
    }
    parts, start = [], 0
    for name, n in t.families():
        parts.append(f"SELECT CAST({start} + i AS INT) AS id, '{name}_' || {value.get(name, chr(39) + 'None' + chr(39))} AS token, '{name}' AS type FROM range({n}) r(i)")
        start += n
    return " UNION ALL ".join(parts)


VOCABULARY = f"vc AS ({_family_sql()})"


@query("t01_build_vocabulary", "v_lead v_bends v_annot", step(tk="t04_insert_postfix_labels") + f", {VOCABULARY} SELECT id, vc.token, type, count(tk.token) AS uses FROM vc LEFT JOIN tk ON tk.token = vc.token GROUP BY 1, 2, 3")
def _(n, b, a):
    uses = _encoded(n, b, a).groupBy("token").agg(F.count("*").alias("uses"))
    return F.broadcast(t.vocabulary(n.sparkSession)).join(uses, "token", "left").fillna(0, ["uses"])


@query("u04_vocabulary_contiguous", "v_lead v_bends v_annot", step(tk="t04_insert_postfix_labels") + f", {VOCABULARY}, vu AS (SELECT DISTINCT token FROM tk) SELECT type, count(*) AS n, min(id) AS first_id, max(id) AS last_id, max(id) - min(id) + 1 = count(*) AND count(DISTINCT id) = count(*) AS contiguous, count(vu.token) AS used FROM vc LEFT JOIN vu ON vu.token = vc.token GROUP BY type")
def _(n, b, a):
    used = _encoded(n, b, a).select("token").distinct().withColumn("used", F.lit(1))
    rows = t.vocabulary(n.sparkSession).join(used, "token", "left")
    whole = (F.max("id") - F.min("id") + 1 == F.count("*")) & (F.count_distinct("id") == F.count("*"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), whole.alias("contiguous"), F.count("used").alias("used"))


WRAP = step(tk="t04_insert_postfix_labels", la="a07_score_tonality") + f""", {VOCABULARY}, wr AS (SELECT source_id, phrase_index, pos + 3 AS pos, token FROM tk
 UNION ALL SELECT source_id, phrase_index, max(pos) + 4, 'EOS_None' FROM tk GROUP BY 1, 2 UNION ALL SELECT DISTINCT source_id, phrase_index, 0, 'BOS_None' FROM tk
 UNION ALL SELECT DISTINCT source_id, phrase_index, 1, 'Tonic_' || tonic FROM tk JOIN la USING (source_id) UNION ALL SELECT DISTINCT source_id, phrase_index, 2, 'Mode_' || mode FROM tk JOIN la USING (source_id))"""


def _wrapped(n: DataFrame, b: DataFrame, a: DataFrame) -> DataFrame:
    return t.wrapped(_encoded(n, b, a), ton.infer(n))


@query("t06_wrap_sequence", "v_lead v_bends v_annot", WRAP + " SELECT source_id, phrase_index, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM wr JOIN vc USING (token) GROUP BY 1, 2")
def _(n, b, a):
    return _wrapped(n, b, a).select(*t.PHRASE, F.array_join("ids", " ").alias("ids"))


@query("t07_split_prefix", "v_lead v_bends v_annot", step(tk="t04_insert_postfix_labels", la="a07_score_tonality") + """ SELECT source_id, phrase_index, CASE WHEN cut THEN NULL ELSE tonic END AS tonic, CASE WHEN cut THEN NULL ELSE mode END AS mode,
 n - CASE WHEN cut THEN 1 ELSE 0 END AS n_body, NOT cut AS valid FROM (SELECT source_id, phrase_index, source_id % 5 = 2 AS cut, tonic, mode, count(*) AS n FROM tk JOIN la USING (source_id) GROUP BY ALL) x""")  # fmt: skip
def _(n, b, a):
    # sequences of some sources have lost their first id
    cut = F.col("source_id") % 5 == 2
    rows = _wrapped(n, b, a).withColumn("ids", F.when(cut, F.slice("ids", F.lit(2), F.size("ids"))).otherwise(F.col("ids")))
    got = t.split_prefix(rows)
    held = lambda c: F.when(F.col("valid"), F.col(c)).alias(c)
    return got.select(*t.PHRASE, held("tonic"), held("mode"), F.size("body").cast("long").alias("n_body"), "valid")
