"""One query and one DuckDB string for each operator, on the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import contracts
from ..operators import events as e
from ..operators import sequences as q
from ..operators import splits as sp
from ..sources import runs
from ..views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str, sql: str | None):
    """Registers a function of the named views."""

    def keep(f):
        def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views.split()])

        QUERIES[name] = bound
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep


SPLIT_SQL = """
WITH f AS (SELECT source_id, path, n_chars, sha256(content) AS sha256 FROM v_sources),
g AS (SELECT sha256, row_number() OVER (ORDER BY sha256('0' || sha256)) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT sha256 FROM f) x),
c AS (SELECT n, floor(n * 0.8 + 1e-9) AS a, floor(n * 0.1 + 1e-9) AS b FROM (SELECT max(n) AS n FROM g) x),
r AS (SELECT n, a, b, n - a - 2 * b AS extra, n * 0.8 - a AS ra, n * 0.1 - b AS rb FROM c),
k AS (SELECT n, a + CASE WHEN extra >= 1 AND ra + 1e-9 >= rb THEN 1 WHEN extra >= 3 THEN 1 ELSE 0 END AS a,
             b + CASE WHEN extra >= 2 OR (extra >= 1 AND ra + 1e-9 < rb) THEN 1 ELSE 0 END AS b FROM r),
s AS (SELECT f.*, CASE WHEN rank <= a THEN 'train' WHEN rank <= a + b THEN 'validation' ELSE 'test' END AS split FROM f JOIN g USING (sha256) CROSS JOIN k) """


@query("s02_fingerprint", "v_sources", "SELECT source_id, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS size_bytes FROM v_sources")
def _(d):
    return sp.fingerprint(d).select("source_id", "sha256", "size_bytes")


SQL["s03_snapshot_drift"] = oracle("""
WITH a AS (SELECT source_id AS key, sha256(content) AS was FROM v_sources),
b AS (SELECT source_id AS key, sha256(CASE WHEN source_id % 50 = 1 THEN content || '!' ELSE content END) AS now FROM v_sources WHERE source_id % 50 <> 0
      UNION ALL SELECT -1 - item_id, sha256(text) FROM benchmark)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.key = b.key WHERE was IS DISTINCT FROM now""")


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "v_sources")
    before = d.select(F.col("source_id").alias("key"), F.sha2("content", 256).alias("sha256"))
    text = F.when(F.col("source_id") % 50 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    after = d.filter("source_id % 50 <> 0").select(F.col("source_id").alias("key"), F.sha2(text, 256).alias("sha256"))
    added = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select((-1 - F.col("item_id")).alias("key"), F.sha2("text", 256).alias("sha256"))
    return sp.snapshot_drift(before, after.union(added))


QUERIES["s03_snapshot_drift"] = _drift


@query("s04_source_label", "v_sources", """
SELECT source_id, coalesce(nullif(left(lower(trim(regexp_replace(path, '[^A-Za-z0-9_-]+', '-', 'g'), '-_')), 48), ''), 'midi') || '-' || left(sha256(path), 10) AS slug FROM v_sources""")  # fmt: skip
def _(d):
    return d.select("source_id", s.slug(F.col("path")).alias("slug"))


@query("s06_run_id", "v_sources", """
WITH h AS (SELECT sha256('{"label":"' || path || '","sha256":"' || sha256(content) || '"}') AS h FROM v_sources),
p AS (SELECT left(h, 3) AS prefix, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT left(sha256(string_agg(d, '' ORDER BY prefix)), 20) AS run_id FROM p""")  # fmt: skip
def _(d):
    return sp.run_id(sp.fingerprint(d))


@query("a04_content_groups", "v_sources", "SELECT source_id, count(*) OVER (PARTITION BY sha256(content)) AS group_size FROM v_sources")
def _(d):
    return sp.content_groups(sp.fingerprint(d)).select("source_id", "group_size")


@query("k03_assign_splits", "v_sources", SPLIT_SQL + "SELECT source_id, split FROM s")
def _(d):
    return sp.assign_splits(sp.fingerprint(d)).select("source_id", "split")


@query("k02_allocate_splits", "v_sources", SPLIT_SQL + "SELECT split, count(DISTINCT sha256) AS n_groups FROM s GROUP BY split")
def _(d):
    return sp.assign_splits(sp.fingerprint(d)).groupBy("split").agg(F.count_distinct("sha256").alias("n_groups"))


@query("f22_split_leakage", "v_sources", "SELECT sha256(content) AS sha256, count(DISTINCT source_id % 3) AS n_splits FROM v_sources GROUP BY 1 HAVING count(DISTINCT source_id % 3) > 1")
def _(d):
    return sp.split_leakage(sp.fingerprint(d).withColumn("split", F.col("source_id") % 3))


@query("a10_corpus_summary", "v_sources", SPLIT_SQL + """, t AS (SELECT split, CAST(len(string_split(d.text, ' ')) AS BIGINT) AS n FROM s JOIN documents d ON d.doc_id = s.source_id)
SELECT split, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS total_tokens, min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 6) AS mean_tokens
FROM t GROUP BY GROUPING SETS ((split), ())""")  # fmt: skip
def _(d):
    sized = sp.assign_splits(sp.fingerprint(d)).select("split", F.size(F.split("content", " ")).cast("long").alias("n_tokens"))
    return sp.corpus_summary(sized)


@query("p01_absolute_ticks", "v_messages", "SELECT source_id, track, ord, CAST(sum(delta) OVER (PARTITION BY source_id, track ORDER BY ord) AS BIGINT) AS tick FROM v_messages")
def _(d):
    return e.absolute_ticks(d).select("source_id", "track", "ord", "tick")


@query("p03_round_half_up", "v_notes", "SELECT seq, CAST(floor(onset_tick / 40.0 + 0.5) AS BIGINT) AS cell FROM v_notes")
def _(d):
    return d.select("seq", s.round_half_up(F.col("onset_tick") / 40.0).alias("cell"))


@query("p05_note_identity", "v_notes_dup", "SELECT source_id, onset_tick, end_tick, pitch, velocity, count(*) AS n FROM v_notes_dup GROUP BY ALL HAVING count(*) > 1")
def _(d):
    return e.repeated_identities(d)


@query("p06_note_index", "v_notes", "SELECT source_id, seq, row_number() OVER (PARTITION BY source_id ORDER BY onset_tick, pitch, end_tick, velocity, seq) - 1 AS note_index FROM v_notes")
def _(d):
    return e.note_index(d)


TONIC_LIST = "['" + "','".join(s.TONICS) + "']"


@query("p09_transpose_tonic", "v_notes", f"SELECT seq, {TONIC_LIST}[CAST((pitch % 12 + velocity) % 12 AS INT) + 1] AS tonic FROM v_notes")
def _(d):
    names = F.array(*map(F.lit, s.TONICS))
    return d.select("seq", s.transpose_tonic(F.element_at(names, (F.col("pitch") % 12 + 1).cast("int")), F.col("velocity")).alias("tonic"))


@query("p11_bend_to_semitones", "v_bends", "SELECT source_id, bool_or(abs(value * 12 / 8192.0) > 6 + 1e-9) AS beyond, round(max(value * 12 / 8192.0), 6) AS highest FROM v_bends GROUP BY source_id")
def _(d):
    x = s.bend_to_semitones(F.col("value"), F.lit(12))
    return d.groupBy("source_id").agg(F.bool_or(F.abs(x) > 6 + 1e-9).alias("beyond"), F.round(F.max(x), 6).alias("highest"))


@query("p12_scale_bend", "v_bends", "SELECT seq, CASE WHEN x = 8192 THEN 8191 ELSE x END AS value FROM (SELECT seq, CAST(round_even(value * 2 / 8192.0 * 8192.0 / 6, 0) AS INT) AS x FROM v_bends) t")
def _(d):
    return d.select("seq", s.scale_bend(F.col("value"), F.lit(2)).alias("value"))


@query("p13_split_token", "v_annot", "SELECT seq, type AS token, split_part(type, '_', 1) AS kind, CASE WHEN instr(type, '_') > 0 THEN substr(type, instr(type, '_') + 1) END AS value FROM v_annot")
def _(d):
    return d.select("seq", F.col("type").alias("token"), s.token_type(F.col("type")).alias("kind"), s.token_value(F.col("type")).alias("value"))


@query("p16_attempt_seed", "v_logits", "SELECT row_id, CAST((CAST(row_id AS HUGEINT) * 1000000007 + CAST(target AS HUGEINT) * 1000003 + CAST(row_id % 7 AS HUGEINT) * 10007) % 9223372036854775807 AS BIGINT) AS seed FROM v_logits")
def _(d):
    return d.select("row_id", s.attempt_seed(F.col("row_id") * 1000000007, F.col("target") + 1, F.col("row_id") % 7 + 1).alias("seed"))


PAIR_SQL = """
WITH m AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY source_id, track ORDER BY ord) AS BIGINT) AS tick,
             sum(CASE WHEN on_flag = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY source_id, track, pitch ORDER BY ord) AS s FROM v_messages),
l AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY source_id, track, pitch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY source_id, track, pitch, on_flag ORDER BY ord) AS rn FROM l WHERE on_flag = 1 OR s >= low),
p AS (SELECT a.source_id, a.track, a.pitch, a.ord AS on_ord, a.tick AS onset_tick, a.velocity, b.ord AS off_ord, b.tick AS end_tick
      FROM (SELECT * FROM u WHERE on_flag = 1) a LEFT JOIN (SELECT * FROM u WHERE on_flag = 0) b
      ON a.source_id = b.source_id AND a.track = b.track AND a.pitch = b.pitch AND a.rn = b.rn) """


@query("j01_pair_notes", "v_messages", PAIR_SQL + "SELECT * FROM p")
def _(d):
    return e.pair_notes(d)


@query("f01_overlap_violations", "v_messages", PAIR_SQL + """, w AS (SELECT *, lag(off_ord) OVER k AS po, lag(onset_tick) OVER k AS pt, lag(velocity) OVER k AS pv, row_number() OVER k AS r FROM p
WINDOW k AS (PARTITION BY source_id, track, pitch ORDER BY on_ord))
SELECT source_id, track, pitch, on_ord, onset_tick FROM w WHERE r > 1 AND (po IS NULL OR po > on_ord) AND (pt <> onset_tick OR pv <> velocity)""")  # fmt: skip
def _(d):
    return e.overlap_violations(d)


@query("f02_dangling_note_on", "v_messages", PAIR_SQL + "SELECT source_id, count(*) AS dangling FROM p WHERE end_tick IS NULL GROUP BY source_id")
def _(d):
    return e.pair_notes(d).filter("end_tick IS NULL").groupBy("source_id").agg(F.count("*").alias("dangling"))


@query("f03_duplicate_end_mismatch", "v_messages", PAIR_SQL + "SELECT source_id, track, pitch, onset_tick, velocity, count(*) AS n, count(DISTINCT end_tick) AS n_ends FROM p WHERE end_tick IS NOT NULL GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT end_tick) > 1")
def _(d):
    return e.duplicate_end_mismatch(e.pair_notes(d))


@query("f05_constant_tempo", "v_tempi v_customers", """
WITH f AS (SELECT source_id, arg_min(bpm, seq) AS first_bpm FROM v_tempi GROUP BY source_id)
SELECT c.source_id, coalesce(first_bpm, 120.0) AS first_bpm, count(t.seq) AS n_events, coalesce(bool_or(abs(bpm - first_bpm) > 0.001 OR bpm <= 0), false) AS varies
FROM v_customers c LEFT JOIN v_tempi t ON t.source_id = c.source_id LEFT JOIN f ON f.source_id = c.source_id GROUP BY c.source_id, first_bpm""")  # fmt: skip
def _(d, c):
    return e.constant_tempo(d, 0.001, c)


@query("f06_meter_check", "v_meters v_file_meters v_file_headers", """
WITH a AS (SELECT source_id, numerator, denominator FROM v_meters UNION SELECT CAST(source_id AS VARCHAR), numerator, denominator FROM v_file_meters),
s AS (SELECT DISTINCT source_id FROM v_meters UNION SELECT CAST(source_id AS VARCHAR) FROM v_file_headers)
SELECT s.source_id, coalesce(string_agg(numerator || '/' || denominator, ', ' ORDER BY numerator, denominator) FILTER (numerator <> 4 OR denominator <> 4), '') AS unsupported,
  coalesce(string_agg(numerator || '/' || denominator, ', ' ORDER BY numerator, denominator), '4/4 (implicit)') AS meters FROM s LEFT JOIN a USING (source_id) GROUP BY 1""")  # fmt: skip
def _(m, fm, fh):
    text = F.col("source_id").cast("string").alias("source_id")
    rows = m.select("source_id", "numerator", "denominator").union(fm.select(text, "numerator", "denominator"))
    return e.meter_check(rows, m.select("source_id").union(fh.select(text)))


@query("f09_invalid_events", "v_notes v_bends", """
SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(bad_notes, 0) AS bad_notes, coalesce(bad_bends, 0) AS bad_bends
FROM (SELECT source_id, count(*) FILTER (onset_tick < 0 OR end_tick <= onset_tick) AS bad_notes FROM v_notes GROUP BY 1) a
FULL JOIN (SELECT source_id, count(*) FILTER (value NOT BETWEEN -8192 AND 8191 OR tick < 0) AS bad_bends FROM v_bends GROUP BY 1) b ON a.source_id = b.source_id""")  # fmt: skip
def _(n, b):
    return e.invalid_events(n, b)


@query("a01_dedupe_exact", "v_notes_dup", """
SELECT source_id, instrument_index, CAST(sum(n) AS BIGINT) AS raw, count(*) AS unique_notes, CAST(sum(n) - count(*) AS BIGINT) AS collapsed
FROM (SELECT source_id, instrument_index, onset_tick, end_tick, pitch, velocity, count(*) AS n FROM v_notes_dup GROUP BY ALL) t GROUP BY 1, 2""")  # fmt: skip
def _(d):
    return e.dedupe_counts(d)


LAST_SQL = "WITH t AS (SELECT source_id, tick, arg_max(value, seq) AS value FROM v_bends GROUP BY 1, 2) "


@query("a03_last_per_tick", "v_bends", LAST_SQL + "SELECT * FROM t")
def _(d):
    return e.last_per_tick(d)


@query("j05_asof_state", "v_notes v_bends", LAST_SQL + "SELECT n.source_id, n.seq AS id, onset_tick AS tick, coalesce(t.value, 0) AS state FROM v_notes n ASOF LEFT JOIN t ON n.source_id = t.source_id AND n.onset_tick >= t.tick")
def _(n, b):
    return e.asof_state(n.select("source_id", F.col("onset_tick").alias("tick"), F.col("seq").alias("id")), b)


@query("w01_strip_lead_in", "v_notes", "SELECT source_id, seq, onset_tick - min(onset_tick) OVER k AS onset_tick, end_tick - min(onset_tick) OVER k AS end_tick FROM v_notes WINDOW k AS (PARTITION BY source_id)")
def _(d):
    return e.strip_lead_in(d)


QUANT_SQL = """
WITH z AS (SELECT source_id, instrument_index, seq, pitch, velocity, CAST(floor(onset_tick / 120.0 + 0.5) AS BIGINT) AS c, greatest(CAST(floor((end_tick - onset_tick) / 120.0 + 0.5) AS BIGINT), 1) AS l FROM v_notes),
y AS (SELECT source_id, instrument_index, seq, pitch, velocity, c * 120 AS onset_tick, (c + l) * 120 AS end_tick FROM z) """


@query("w02_quantize", "v_notes", QUANT_SQL + "SELECT * FROM y")
def _(d):
    return e.quantize(d, 120)


@query("w02_collisions", "v_notes_dup", QUANT_SQL.replace("v_notes", "v_notes_dup") + "SELECT DISTINCT source_id FROM (SELECT source_id FROM y GROUP BY source_id, instrument_index, onset_tick, end_tick, pitch, velocity HAVING count(*) > 1) x")
def _(d):
    return e.collisions(e.quantize(d, 120))


PHRASE_SQL = """
WITH c AS (SELECT *, CAST(floor(onset_tick / 7680.0) AS BIGINT) AS phrase_index FROM v_notes),
w AS (SELECT source_id, instrument_index, seq, pitch, velocity, phrase_index, onset_tick - phrase_index * 7680 AS onset_tick, least(end_tick, (phrase_index + 1) * 7680) - phrase_index * 7680 AS end_tick FROM c
      WHERE least(end_tick, (phrase_index + 1) * 7680) > onset_tick) """


@query("w03_phrase_window", "v_notes", PHRASE_SQL + "SELECT source_id, seq, phrase_index, onset_tick, end_tick FROM w")
def _(d):
    return e.phrase_window(d).select("source_id", "seq", "phrase_index", "onset_tick", "end_tick")


@query("w04_phrase_count", "v_notes", "SELECT source_id, CAST(floor(max(end_tick) / 7680.0) AS BIGINT) + CASE WHEN max(end_tick) % 7680 > 0 THEN 1 ELSE 0 END AS n_phrases FROM v_notes GROUP BY source_id")
def _(d):
    return e.phrase_counts(d)


ENDS = "sd AS (SELECT source_id, max(t) + CASE source_id % 4 WHEN 1 THEN 0.000004 WHEN 2 THEN 9000.5 ELSE 0 END AS d FROM (SELECT source_id, track, sum(delta) AS t FROM v_file_messages GROUP BY 1, 2) x GROUP BY 1), sn AS (SELECT source_id, max(end_tick) AS n FROM v_notes GROUP BY 1), su AS (SELECT source_id, greatest(n, CAST(coalesce(d, 0) AS DOUBLE)) AS u FROM sn LEFT JOIN sd USING (source_id))"


def _ends(m):
    more = F.when(F.col("source_id") % 4 == 1, 0.000004).when(F.col("source_id") % 4 == 2, 9000.5).otherwise(0.0)
    return e.structural_ends(m).withColumn("duration", F.col("duration") + more)


@query("w04_structural_count", "v_notes v_file_messages", f"WITH {ENDS} SELECT source_id, CAST(floor((u + 7.68e-6) / 7680) AS BIGINT) AS n_full, CAST(ceil((u - 7.68e-6) / 7680) AS BIGINT) AS n_phrases FROM su")
def _(n, m):
    full = e.phrase_counts(n, durations=_ends(m), partial=False).withColumnRenamed("n_phrases", "n_full")
    return full.join(e.phrase_counts(n, durations=_ends(m)), "source_id")


@query("w04_counted_phrases", "v_notes", "WITH u AS (SELECT source_id, max(end_tick) // 7680 AS n FROM v_notes GROUP BY 1) SELECT source_id, seq, onset_tick // 7680 AS phrase_index FROM v_notes JOIN u USING (source_id) WHERE onset_tick // 7680 < n")
def _(n):
    # windows that are filled alone count, so notes of a source's last part go
    return e.counted_phrases(e.phrase_window(n), e.phrase_counts(n, partial=False)).select("source_id", "seq", "phrase_index")


@query("w05_slice_bends", "v_bends", LAST_SQL + """, v AS (SELECT *, CAST(floor(tick / 7680.0) AS BIGINT) AS i FROM t),
n AS (SELECT source_id, unnest(range(min(i), max(i) + 1)) AS i FROM v GROUP BY source_id),
c AS (SELECT n.source_id, n.i, coalesce(t.value, 0) AS value FROM n ASOF LEFT JOIN t ON n.source_id = t.source_id AND n.i * 7680 >= t.tick),
o AS (SELECT source_id, i, tick, value, false AS synthetic FROM v
      UNION ALL SELECT c.source_id, c.i, c.i * 7680, c.value, true FROM c WHERE c.value <> 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.source_id = c.source_id AND v.tick = c.i * 7680)),
a AS (SELECT * FROM o UNION ALL SELECT source_id, i, (i + 1) * 7680, 0, true FROM (SELECT source_id, i, arg_max(value, tick) AS f FROM o GROUP BY 1, 2) x WHERE f <> 0)
SELECT source_id, i AS phrase_index, tick - i * 7680 AS tick, value, synthetic FROM a WHERE (source_id, i) IN (SELECT (source_id, i) FROM a WHERE value <> 0)""")  # fmt: skip
def _(d):
    return e.slice_bends(d)


@query("w06_min_notes_per_phrase", "v_notes", PHRASE_SQL + "SELECT source_id, phrase_index, count(*) AS num_notes FROM w GROUP BY 1, 2 HAVING count(*) >= 8")
def _(d):
    return e.full_phrases(e.phrase_window(d), 8)


@query("x02_transpose", "v_notes", PHRASE_SQL + """SELECT source_id, phrase_index, CAST(k AS INT) AS semitones, n AS num_notes
FROM (SELECT source_id, phrase_index, min(pitch) AS lo, max(pitch) AS hi, count(*) AS n FROM w GROUP BY 1, 2) b, range(-6, 7) r(k) WHERE lo + k >= 38 AND hi + k <= 90""")  # fmt: skip
def _(d):
    return e.transposed(e.phrase_window(d), -6, 6, 38, 90)


@query("j02_attach_annotations", "v_notes v_annot", """
WITH t AS (SELECT source_id, onset_tick, end_tick, pitch, velocity, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM v_annot GROUP BY ALL)
SELECT source_id, n.seq, n.onset_tick, n.end_tick, n.pitch, n.velocity, coalesce(types, '') AS types FROM v_notes n LEFT JOIN t USING (source_id, onset_tick, end_tick, pitch, velocity)""")  # fmt: skip
def _(n, a):
    return e.attach_annotations(n, a)


MUTE_SQL = "WITH m AS (SELECT source_id, seq, onset_tick, EXISTS (SELECT 1 FROM v_ranges r WHERE r.source_id = n.source_id AND start_tick <= onset_tick AND onset_tick < r.end_tick) AS muted FROM v_notes n) "


@query("j03_range_label", "v_notes v_ranges", MUTE_SQL + "SELECT * FROM m")
def _(n, r):
    return e.range_label(n, r)


@query("w07_state_transitions", "v_notes v_ranges", MUTE_SQL + """SELECT source_id, phrase_index, seq, CASE WHEN muted THEN 'ON' ELSE 'OFF' END AS toggle
FROM (SELECT *, coalesce(lag(muted) OVER (PARTITION BY source_id, phrase_index ORDER BY onset_tick, seq), false) AS before FROM (SELECT *, CAST(floor(onset_tick / 7680.0) AS BIGINT) AS phrase_index FROM m) x) y WHERE muted <> before""")  # fmt: skip
def _(n, r):
    return e.state_transitions(e.range_label(n, r))


@query("w08_merge_check", "v_ranges", """
SELECT source_id, start_tick, end_tick, CASE WHEN start_tick < b THEN 'overlap' ELSE 'adjacent' END AS kind
FROM (SELECT *, lag(end_tick) OVER (PARTITION BY source_id ORDER BY start_tick, end_tick) AS b FROM v_ranges) t WHERE start_tick <= b""")  # fmt: skip
def _(d):
    return e.merge_check(d)


@query("f17_toggle_alternation", "v_toggle", "SELECT sequence_id, pos, toggle FROM (SELECT *, coalesce(lag(toggle) OVER (PARTITION BY sequence_id ORDER BY pos), 'OFF') AS b FROM v_toggle) t WHERE toggle = b")
def _(d):
    return e.toggle_alternation(d)


@query("f18_exclusive_labels", "v_annot", """
WITH g AS (SELECT source_id, onset_tick, end_tick, pitch, velocity, bool_or(type = 'DEAD_NOTE') AS dead, bool_or(type = 'VIBRATO') AS vib, count(*) FILTER (type LIKE 'SLIDE%') AS sl,
  coalesce(bool_or(CASE type WHEN 'SLIDE_UP' THEN target_pitch - pitch NOT BETWEEN 1 AND 24 WHEN 'SLIDE_DOWN' THEN pitch - target_pitch NOT BETWEEN 1 AND 24 END), false) AS far FROM v_annot GROUP BY ALL)
SELECT source_id, onset_tick, end_tick, pitch, velocity, dead AND (vib OR sl > 0) AS dead_and_more, sl > 1 AS many_slides, far AS slide_out_of_bounds FROM g WHERE (dead AND (vib OR sl > 0)) OR sl > 1 OR far""")  # fmt: skip
def _(d):
    return e.exclusive_labels(d)


@query("f15_unique_keys", "v_notes_dup", "SELECT onset_tick, pitch, count(*) AS n FROM v_notes_dup GROUP BY 1, 2 HAVING count(*) > 1")
def _(d):
    return contracts.repeated_keys(d, "onset_tick", "pitch")


@query("f23_same_pitch_overlap", "v_notes", "SELECT source_id, instrument_index, pitch, seq FROM (SELECT *, lag(end_tick) OVER (PARTITION BY source_id, instrument_index, pitch ORDER BY onset_tick, end_tick, velocity, seq) AS b FROM v_notes) t WHERE onset_tick < b")
def _(d):
    return e.same_pitch_overlap(d)


@query("a05_pitch_class_profile", "v_lead", """
WITH d AS (SELECT source_id, pitch, seq, greatest(CAST(greatest(end_tick - onset_tick, 0) AS DOUBLE), 1e-9) AS duration FROM v_lead),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY duration, seq) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM d),
m AS (SELECT source_id, duration AS typical FROM r WHERE rn = n // 2 + 1)
SELECT source_id, pitch % 12 AS pitch_class, round(sum(1 + 0.25 * least(duration / typical, 2.0)), 6) AS weight FROM d JOIN m USING (source_id) GROUP BY 1, 2""")  # fmt: skip
def _(d):
    return e.pitch_class_profile(d)


@query("a06_bass_profile", "v_lead", """
WITH l AS (SELECT source_id, onset_tick, min(pitch) % 12 AS bass FROM v_lead GROUP BY 1, 2),
f AS (SELECT source_id, arg_min(bass, onset_tick) AS first_bass, arg_max(bass, onset_tick) AS last_bass FROM l GROUP BY 1)
SELECT source_id, bass, count(*) AS votes, any_value(first_bass) AS first_bass, any_value(last_bass) AS last_bass FROM l JOIN f USING (source_id) GROUP BY 1, 2""")  # fmt: skip
def _(d):
    return e.bass_profile(d)


TYPES = ["DEAD_NOTE", "HAMMER_ON", "SLIDE_DOWN", "SLIDE_UP", "VIBRATO"]


@query("a09_label_counts", "v_annot", f"SELECT t AS type, count(a.type) AS n FROM (SELECT unnest({TYPES}) AS t) x LEFT JOIN v_annot a ON a.type = t GROUP BY t")
def _(d):
    return e.with_zeros(d.groupBy("type").agg(F.count("*").alias("n")), "type", TYPES)


@query("f20_overlong", "v_words", "SELECT count(*) AS n_overlong, min(sequence_id) AS first_id FROM (SELECT sequence_id FROM v_words GROUP BY 1 HAVING count(*) > 512) t")
def _(d):
    return q.overlong(d, 512)


@query("j07_lookup_ids", "v_words", """
WITH v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM v_words) x)
SELECT sequence_id, count(*) AS n_tokens, CAST(sum(id) AS BIGINT) AS id_sum FROM v_words JOIN v USING (token) GROUP BY sequence_id""")  # fmt: skip
def _(d):
    keep = runs.staged
    counts = keep(q.token_counts(d))
    return q.ids_of(d, keep(q.vocabulary(counts, keep)), keep, counts).groupBy("sequence_id").agg(F.count("*").alias("n_tokens"), F.sum("id").alias("id_sum"))


@query("j07_texts_of_ids", "v_words", """
WITH v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM v_words) x)
SELECT sequence_id, count(*) AS n_tokens, sum(CASE WHEN id % 50 <> 3 THEN 1 ELSE 0 END)::BIGINT AS n_known, sum(CASE WHEN id % 50 <> 3 THEN strlen(token) ELSE 0 END)::BIGINT AS n_bytes FROM v_words JOIN v USING (token) GROUP BY sequence_id""")  # fmt: skip
def _(d):
    # a vocabulary that lacks every fiftieth id, so that some ids have no text
    keep = runs.staged
    counts = keep(q.token_counts(d))
    words = keep(q.vocabulary(counts, keep).join(counts, "token"))
    ids = q.ids_of(d, words.select("token", "id"), keep, counts).select("sequence_id", "id")
    back = q.texts_of(ids, words.filter("id % 50 <> 3").select("token", "id"), keep, words.select("id", "_n"))
    return back.groupBy("sequence_id").agg(F.count("*").alias("n_tokens"), F.count("token").alias("n_known"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).cast("long").alias("n_bytes"))


#: Eight ids of the given logits play each type of token.
TYPE_NAMES = ["Special", "Bar", "Position", "Pitch", "Duration", "Tempo", "PitchBend", "Technique"]


def types_of(d: DataFrame) -> DataFrame:
    return d.sparkSession.createDataFrame([(i, TYPE_NAMES[i // 8]) for i in range(64)], "id int, type string")


SCORE_SQL = """
WITH a AS (SELECT row_id, target, unknown, CAST(logits AS DOUBLE[]) AS x FROM v_logits),
b AS (SELECT *, list_max(x) AS m, list_position(x, list_max(x)) - 1 AS best, x[target + 1] AS own FROM a),
c AS (SELECT *, m + ln(list_sum(list_transform(x, lambda v: exp(v - m)))) - own AS full_nll,
  CASE WHEN unknown THEN list_max(x[1:60]) + ln(list_sum(list_transform(x[1:60], lambda v: exp(v - list_max(x[1:60]))))) - own END AS rest FROM b),
r AS (SELECT row_id, target, unknown, full_nll, coalesce(rest, full_nll) AS objective_nll, best = target AS top1,
  len(list_filter(x, lambda v, i: v > own OR (v = own AND i - 1 < target))) < 5 AS topk, TYPES[best // 8 + 1] = TYPES[target // 8 + 1] AS type_top1, TYPES[target // 8 + 1] AS type FROM c) """.replace("TYPES", str(TYPE_NAMES))
METRICS_SQL = "count(*) AS tokens, round(avg(full_nll), 6) AS full_nll, round(avg(objective_nll), 6) AS objective_nll, CASE WHEN count(objective_nll) > 0 THEN round(exp(least(avg(objective_nll), 50)), 4) END AS perplexity, round(avg(top1::INT), 6) AS top1, round(avg(topk::INT), 6) AS top5, round(avg(type_top1::INT), 6) AS type_top1 FROM r"
EXCLUDED = [60, 61, 62, 63]


@query("t12_nll", "v_logits", SCORE_SQL + "SELECT row_id, round(full_nll, 6) AS nll FROM r")
def _(d):
    return q.scored(d, EXCLUDED).select("row_id", F.round("full_nll", 6).alias("nll"))


@query("t13_restricted_nll", "v_logits", SCORE_SQL + "SELECT row_id, round(objective_nll, 6) AS nll FROM r")
def _(d):
    return q.scored(d, EXCLUDED).select("row_id", F.round("objective_nll", 6).alias("nll"))


@query("k05_topk_hit", "v_logits", SCORE_SQL + "SELECT row_id, top1, topk FROM r")
def _(d):
    return q.scored(d, EXCLUDED).select("row_id", "top1", "topk")


@query("t15_type_top1", "v_logits", SCORE_SQL + "SELECT row_id, type_top1 FROM r")
def _(d):
    return q.scored(d, EXCLUDED, types_of(d)).select("row_id", "type_top1")


@query("a12_token_metrics", "v_logits", SCORE_SQL + "SELECT " + METRICS_SQL)
def _(d):
    return q.token_metrics(q.scored(d, EXCLUDED, types_of(d)))


@query("a13_metrics_by_type", "v_logits", SCORE_SQL + f""", u AS (SELECT 'all' AS scope, '' AS type UNION ALL SELECT 'unknown', '' UNION ALL SELECT 'type', unnest({TYPE_NAMES})),
x AS (SELECT u.scope, u.type AS slice, r.* EXCLUDE (type) FROM u LEFT JOIN r ON u.scope = 'all' OR (u.scope = 'unknown' AND r.unknown) OR (u.scope = 'type' AND r.type = u.type))
SELECT scope, slice AS type, """ + METRICS_SQL.replace("count(*)", "count(row_id)").replace("FROM r", "FROM x") + " GROUP BY ALL")  # fmt: skip
def _(d):
    return q.metrics_by_type(q.scored(d, EXCLUDED, types_of(d)), types_of(d))


@query("k06_truncate_topk", "v_logits", "SELECT row_id, len(list_filter(x, lambda v: v >= list_sort(x, 'DESC')[10])) AS kept, round(list_sum(list_filter(x, lambda v: v >= list_sort(x, 'DESC')[10])), 5) AS total FROM (SELECT row_id, CAST(logits AS DOUBLE[]) AS x FROM v_logits) t")
def _(d):
    kept = F.filter(s.truncate_topk(F.transform("logits", lambda x: x.cast("double")), 10), lambda x: x.isNotNull())
    return d.select("row_id", F.size(kept).alias("kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("k07_truncate_topp", "v_logits", """
WITH f AS (SELECT row_id, i - 1 AS id, x[i] AS x FROM (SELECT row_id, CAST(logits AS DOUBLE[]) AS x, unnest(range(1, len(logits) + 1)) AS i FROM v_logits) t),
p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY row_id) AS p FROM f),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY row_id ORDER BY x DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT row_id, count(*) AS n_kept, round(sum(p), 6) AS mass FROM c WHERE before < 0.9 - 1e-9 GROUP BY row_id""")  # fmt: skip
def _(d):
    return q.nucleus(d, 0.9)


@query("t09_repetition_penalty", "v_logits", "SELECT row_id, round(list_sum(list_transform(x, lambda v, i: CASE WHEN i - 1 NOT IN (target, target + 1) THEN v WHEN v < 0 THEN v * 1.3 ELSE v / 1.3 END)), 5) AS total FROM (SELECT row_id, target, CAST(logits AS DOUBLE[]) AS x FROM v_logits) t")
def _(d):
    out = s.repetition_penalty(F.transform("logits", lambda x: x.cast("double")), F.array("target", F.col("target") + 1), 1.3)
    return d.select("row_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("t10_mask_and_temperature", "v_logits", "SELECT row_id, round(x[target + 1] / 0.8, 6) AS own, round(x[target + 2] / 0.8, 6) AS next FROM (SELECT row_id, target, CAST(logits AS DOUBLE[]) AS x FROM v_logits) t")
def _(d):
    out = s.mask_and_temperature(F.transform("logits", lambda x: x.cast("double")), F.array("target", F.col("target") + 1), 0.8)
    kept = F.filter(out, lambda x: x.isNotNull())
    return d.select("row_id", F.round(F.get(kept, F.lit(0)), 6).alias("own"), F.round(F.get(kept, F.lit(1)), 6).alias("next"))


@query("a14_epoch_loss", "v_epochs", "SELECT run_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(validation_loss * tokens) / sum(tokens), 5) AS loss FROM v_epochs GROUP BY run_id")
def _(d):
    return q.epoch_loss(d).withColumn("loss", F.round("loss", 5))
