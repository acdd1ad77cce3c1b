"""Queries of contracts, batches, histories, evaluation and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import contracts as c
from ..operators import events as e
from ..operators import fitting
from ..operators import rules as r
from ..operators import sequences as q
from ..operators import splits as sp
from ..operators import stages as st
from ..operators import tokens as t
from ..operators import tonality as ton
from ..sources import runs
from .registry import query
from .stage_queries import _splits
from .token_queries import LABELLED_TOKENS, WRAP, _encoded, _wrapped, step

LISTED = "CASE source_id % 5 WHEN 0 THEN replace(path, '.txt', '.MID') WHEN 1 THEN replace(path, '.txt', '.midi') WHEN 2 THEN upper(replace(path, '.txt', '.mid')) WHEN 3 THEN replace(path, '.txt', '.mid.bak') ELSE path END"


@query("s01_scan_files", "v_sources", f"WITH l AS (SELECT {LISTED} AS path, n_chars AS size_bytes FROM v_sources) SELECT path, size_bytes, row_number() OVER (ORDER BY lower(path), path) - 1 AS rank FROM l WHERE regexp_matches(lower(path), '[.]midi?$')")
def _(d):
    return runs.listed(d.select(F.expr(LISTED).alias("path"), F.col("n_chars").alias("size_bytes")))


@query("s06_canonical_run_id", "v_sources v_sidecars", """
WITH h AS (SELECT sha256('{"label":"' || path || '","sha256":"' || sha256(content) || '","sidecar":"' || coalesce(sha256(quality || '|' || toxic), 'null') || '"}') AS h FROM v_sources LEFT JOIN v_sidecars USING (source_id)),
p AS (SELECT left(h, 3) AS prefix, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT left(sha256('{"configuration":{"pitches":[38,90],"seed":0},"schema":4,"tools":{"engine":"1"}}' || sha256(string_agg(d, '' ORDER BY prefix))), 20) AS run_id FROM p""")  # fmt: skip
def _(d, side):
    mark = F.sha2(F.concat_ws("|", "quality", "toxic"), 256)
    rows = sp.fingerprint(d).join(side.select("source_id", mark.alias("sidecar")), "source_id", "left")
    return sp.canonical_run_id(rows, {"schema": 4, "configuration": {"seed": 0, "pitches": [38, 90]}, "tools": {"engine": "1"}})


BPM = "CASE WHEN seq % 13 = 0 THEN 0.0 WHEN seq % 17 = 0 THEN -1.0 ELSE CAST(velocity AS DOUBLE) END"


@query("p02_ticks_to_seconds", "v_notes", f"WITH b AS (SELECT seq, onset_tick, {BPM} AS bpm FROM v_notes) SELECT seq, CASE WHEN bpm > 0 THEN round(onset_tick * 60.0 / bpm / 480, 6) END AS seconds, CASE WHEN bpm > 0 THEN onset_tick END AS back, CASE WHEN bpm <= 0 THEN 'tempo or resolution not positive' END AS issue FROM b")
def _(d):
    bpm, ppq = F.expr(BPM), F.lit(s.PPQ)
    seconds = s.ticks_to_seconds(F.col("onset_tick"), bpm, ppq)
    return d.select("seq", F.round(seconds, 6).alias("seconds"), s.seconds_to_ticks(seconds, bpm, ppq).alias("back"), s.timing_issue(bpm, ppq).alias("issue"))


@query("f19_annotation_limits", "v_annot v_notes v_ranges", """
WITH a AS (SELECT source_id, count(*) AS n FROM v_annot GROUP BY 1), g AS (SELECT source_id, count(*) AS n FROM v_ranges GROUP BY 1),
m AS (SELECT n.source_id, count(DISTINCT n.seq) AS n FROM v_notes n JOIN v_ranges r ON r.source_id = n.source_id AND start_tick <= onset_tick AND onset_tick < r.end_tick GROUP BY 1),
b AS (SELECT source_id, coalesce(a.n, 0) + coalesce(g.n, 0) AS declared, coalesce(a.n, 0) + coalesce(m.n, 0) AS expanded FROM a FULL JOIN g USING (source_id) LEFT JOIN m USING (source_id))
SELECT * FROM b WHERE declared > 30 OR expanded > 30""")  # fmt: skip
def _(a, n, g):
    return c.limit_issues(a, e.range_label(n, g), g, 30)


@query("j02_unmatched_annotations", "v_notes v_annot", "SELECT source_id, seq, type FROM (SELECT * REPLACE (CASE WHEN seq % 19 = 0 THEN pitch + 1 ELSE pitch END AS pitch) FROM v_annot) a WHERE NOT EXISTS (SELECT 1 FROM v_notes n WHERE n.source_id = a.source_id AND n.onset_tick = a.onset_tick AND n.end_tick = a.end_tick AND n.pitch = a.pitch AND n.velocity = a.velocity)")
def _(n, a):
    off = a.withColumn("pitch", F.when(F.col("seq") % 19 == 0, F.col("pitch") + 1).otherwise(F.col("pitch")))
    return c.unmatched_annotations(n, off).select("source_id", "seq", "type")


LISTS = """kn AS (SELECT source_id, min(seq) AS first_seq, count(*) AS num_notes FROM v_notes GROUP BY 1),
kl AS (SELECT a.source_id AS key, row_number() OVER (PARTITION BY a.source_id ORDER BY a.seq, a.type, a.target_pitch) AS ord, CASE WHEN a.seq % 29 = 0 THEN 'BEND' WHEN a.seq % 7 = 0 AND type = 'VIBRATO' THEN 'PALM_MUTE_ON' WHEN a.seq % 7 = 0 AND type = 'SLIDE_UP' THEN 'PALM_MUTE_OFF' ELSE type END AS type,
  CAST((a.seq - first_seq) % 40 AS INT) AS note_index FROM v_annot a JOIN kn ON kn.source_id = a.source_id),
kr AS (SELECT source_id AS key, num_notes, coverage FROM kn JOIN v_cover USING (source_id))"""


@query("f16_label_contract", "v_annot v_notes v_cover", f"WITH {LISTS}, " + f"""kx AS (SELECT *, list_position({t.TECHNIQUES}, type) AS rank FROM kl JOIN kr USING (key)),
ko AS (SELECT *, lag(note_index) OVER w AS bi, lag(coalesce(rank, 0)) OVER w AS br, count(*) OVER (PARTITION BY key, type, note_index) AS same FROM kx WINDOW w AS (PARTITION BY key ORDER BY ord)),
kz AS (SELECT key, note_index, bool_or(type = 'SLIDE_UP') AND bool_or(type = 'SLIDE_DOWN') AS sl, bool_or(type = 'PALM_MUTE_ON') AND bool_or(type = 'PALM_MUTE_OFF') AS mu FROM kx GROUP BY 1, 2)
SELECT key, rule, count(*) AS n FROM (SELECT key, unnest(list_filter([CASE WHEN rank IS NULL THEN 'unknown label' END, CASE WHEN note_index >= num_notes OR note_index < 0 THEN 'label outside the notes' END, CASE WHEN coverage = 'UNLABELED' THEN 'labels without coverage' END,
 CASE WHEN same > 1 THEN 'label twice' END, CASE WHEN bi > note_index OR (bi = note_index AND br > coalesce(rank, 0)) THEN 'labels out of order' END, CASE WHEN sl THEN 'slide up and down' END, CASE WHEN mu THEN 'mute on and off' END], lambda x: x IS NOT NULL)) AS rule FROM ko JOIN kz USING (key, note_index)) y GROUP BY 1, 2""")  # fmt: skip
def _(a, n, cover):
    kn = n.groupBy("source_id").agg(F.min("seq").alias("first_seq"), F.count("*").alias("num_notes"))
    kind = F.when(F.col("seq") % 29 == 0, "BEND").when((F.col("seq") % 7 == 0) & (F.col("type") == "VIBRATO"), "PALM_MUTE_ON").when((F.col("seq") % 7 == 0) & (F.col("type") == "SLIDE_UP"), "PALM_MUTE_OFF").otherwise(F.col("type"))
    at = F.row_number().over(Window.partitionBy("source_id").orderBy("seq", "type", F.col("target_pitch").asc_nulls_last()))
    lists = a.join(kn, "source_id").select(F.col("source_id").alias("key"), at.alias("at"), kind.alias("type"), ((F.col("seq") - F.col("first_seq")) % 40).cast("int").alias("note_index"))
    records = kn.join(cover, "source_id").select(F.col("source_id").alias("key"), "num_notes", "coverage")
    return c.label_issues(lists, records)


#: Each residue of a sequence's number spoils its ids or what its record declares.
SEQUENCES = {
    0: ("ids", "slice(ids, 2, size(ids))", ["no BOS first", "tonic not once in its place", "mode not once in its place", "no bar after the prefix", "length differs"]), 1: ("ids", "concat(ids, array(0))", ["no EOS last", "BOS or EOS inside", "PAD", "length differs"]),
    2: ("ids", "concat(slice(ids, 1, 3), array(99999), slice(ids, 4, size(ids)))", ["id outside the vocabulary", "no bar after the prefix", "length differs"]), 3: ("n_notes", "n_notes + 1", ["note count differs", "duration count differs"]), 4: ("n_bends", "n_bends + 1", ["bend count differs"]),
    5: ("n_labels", "n_labels + 1", ["label count differs"]), 6: ("tonic", "'NONE'", ["tonic differs from the label"]), 7: ("length", "length + 1", ["length differs"]),
}
SEQUENCE_NUMBER = "(source_id * 3 + phrase_index) % 11"


def _recorded(n, b, a) -> DataFrame:
    """Wrapped sequences with the record that describes them, one field of most spoiled."""
    streams = t.typed(_encoded(n, b, a))
    counts = streams.groupBy(*t.PHRASE).agg(*[F.count_if(F.col("type") == k).cast("int").alias(v) for k, v in (("Pitch", "n_notes"), ("PitchBend", "n_bends"), ("Technique", "n_labels"))])
    rows = _wrapped(n, b, a).join(counts, t.PHRASE).join(ton.infer(n).select("source_id", "tonic", "mode"), "source_id").withColumn("length", F.size("ids")).withColumn("number", F.expr(SEQUENCE_NUMBER))
    out = rows
    for k, (field, value, _) in SEQUENCES.items():
        out = out.withColumn(field, F.when(F.col("number") == k, F.expr(value).cast(rows.schema[field].dataType)).otherwise(F.col(field)))
    return out


SEQUENCE_RULES = " UNION ALL ".join(f"SELECT {k} AS number, unnest({rules}) AS rule" for k, (_, _, rules) in SEQUENCES.items())


@query("f14_sequence_contract", "v_lead v_bends v_annot", step(tk="t04_insert_postfix_labels") + f""", sl AS (SELECT source_id, phrase_index, {SEQUENCE_NUMBER} AS number, count(*) + 4 AS n FROM tk GROUP BY 1, 2), sr AS ({SEQUENCE_RULES})
SELECT source_id, phrase_index, rule FROM sl JOIN sr USING (number) UNION ALL SELECT source_id, phrase_index, 'too long' FROM sl WHERE n + CASE number WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END > 64""")  # fmt: skip
def _(n, b, a):
    return c.sequence_issues(_recorded(n, b, a), 64)


RULED = """rz AS (SELECT *, last_value(CASE WHEN type = 'Technique' AND value LIKE 'PALM_MUTE%' THEN value END IGNORE NULLS) OVER (PARTITION BY source_id, phrase_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mute,
  lag(position) OVER (PARTITION BY source_id, phrase_index, bar, type ORDER BY pos) AS pp, row_number() OVER (PARTITION BY source_id, phrase_index, bar, position, type ORDER BY pos) AS nth FROM tz),
rl AS (SELECT x.source_id, x.phrase_index, x.pos, x.value, list(y.value) AS held FROM tz x JOIN tz y ON y.source_id = x.source_id AND y.phrase_index = x.phrase_index AND y.note_pos = x.note_pos AND y.type = 'Technique' AND x.type = 'Technique' AND y.pos < x.pos GROUP BY ALL),
rb AS (SELECT source_id, phrase_index, 'position falls' AS rule FROM rz WHERE type = 'Position' AND position <= pp
 UNION ALL SELECT source_id, phrase_index, 'too many notes at a place' FROM rz WHERE type = 'Pitch' AND nth > 1
 UNION ALL SELECT source_id, phrase_index, 'pitch twice at a place' FROM (SELECT *, row_number() OVER (PARTITION BY source_id, phrase_index, bar, position, value ORDER BY pos) AS k FROM tz WHERE type = 'Pitch') x WHERE k > 1
 UNION ALL SELECT source_id, phrase_index, 'label twice' FROM rl WHERE list_contains(held, value)
 UNION ALL SELECT source_id, phrase_index, 'slide up and down' FROM rl WHERE (value = 'SLIDE_UP' AND list_contains(held, 'SLIDE_DOWN')) OR (value = 'SLIDE_DOWN' AND list_contains(held, 'SLIDE_UP'))
 UNION ALL SELECT source_id, phrase_index, 'dead note with another label' FROM rl WHERE (value = 'DEAD_NOTE' AND list_has_any(held, ['SLIDE_UP', 'SLIDE_DOWN', 'VIBRATO'])) OR (value IN ('SLIDE_UP', 'SLIDE_DOWN', 'VIBRATO') AND list_contains(held, 'DEAD_NOTE'))
 UNION ALL SELECT source_id, phrase_index, 'mute does not alternate' FROM rz WHERE type = 'Technique' AND ((value = 'PALM_MUTE_ON' AND coalesce(mute = 'PALM_MUTE_ON', false)) OR (value = 'PALM_MUTE_OFF' AND NOT coalesce(mute = 'PALM_MUTE_ON', false))))"""
@query("w14_token_state_audit", "v_lead v_bends", step(tk="t03_encode_events") + """, ty AS (SELECT *, split_part(token, '_', 1) AS type, substr(token, instr(token, '_') + 1) AS value FROM tk),
tz AS (SELECT *, count(*) FILTER (type = 'Bar') OVER w - 1 AS bar, last_value(CASE WHEN type = 'Position' THEN CAST(value AS INT) END IGNORE NULLS) OVER w AS position FROM ty WINDOW w AS (PARTITION BY source_id, phrase_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fa AS (SELECT source_id, phrase_index, count(*) FILTER (type = 'Position' AND position <= pp) AS falls FROM (SELECT *, lag(position) OVER (PARTITION BY source_id, phrase_index, bar, type ORDER BY pos) AS pp FROM tz) x GROUP BY 1, 2),
pl AS (SELECT source_id, phrase_index, bar, position, count(*) AS n, count(DISTINCT value) AS d FROM tz WHERE type = 'Pitch' GROUP BY ALL),
cw AS (SELECT source_id, phrase_index, CAST(sum(n - d) AS BIGINT) AS repeated, count(*) FILTER (n > 1) AS crowded FROM pl GROUP BY 1, 2)
SELECT source_id, phrase_index, falls, coalesce(repeated, 0) AS repeated, coalesce(crowded, 0) AS crowded FROM fa LEFT JOIN cw USING (source_id, phrase_index)""")  # fmt: skip
def _(n, b):
    return t.state_audit(_encoded(n, b), 1)


@query("w14_token_rules", "v_lead v_bends v_annot", LABELLED_TOKENS + f", {RULED} SELECT source_id, phrase_index, rule, count(*) AS n FROM rb GROUP BY 1, 2, 3")
def _(n, b, a):
    return c.token_rules(t.typed(_encoded(n, b, a)), 1, 16)


#: Sequences of over so many ids are no training rows.
LONGEST = 40


@query("x06_tokenize", "v_lead v_bends v_annot v_sources", step(tk="t04_insert_postfix_labels", sk="k03_assign_splits") + f""", xl AS (SELECT source_id, phrase_index, count(*) + 4 AS n FROM tk GROUP BY 1, 2)
SELECT split, count(*) FILTER (n <= {LONGEST}) AS sequences, CAST(coalesce(sum(n) FILTER (n <= {LONGEST}), 0) AS BIGINT) AS total_tokens, min(n) FILTER (n <= {LONGEST}) AS min_tokens, max(n) FILTER (n <= {LONGEST}) AS max_tokens, round(avg(n) FILTER (n <= {LONGEST}), 6) AS mean_tokens,
 count(*) FILTER (n > {LONGEST}) AS failures FROM xl JOIN sk USING (source_id) GROUP BY GROUPING SETS ((split), ())""")  # fmt: skip
def _(n, b, a, d):
    n = runs.staged(n)  # the encoding and the tonality read it many times
    sequences, failures = t.tokenized(_encoded(n, b, a), ton.infer(n), LONGEST, runs.staged)
    return t.tokenize_summary(sequences, failures, _splits(d))


@query("x06_failures", "v_lead v_bends v_annot", step(tk="t04_insert_postfix_labels") + f" SELECT source_id, phrase_index, 'too long' AS rules FROM tk GROUP BY 1, 2 HAVING count(*) + 4 > {LONGEST}")
def _(n, b, a):
    n = runs.staged(n)
    return t.tokenized(_encoded(n, b, a), ton.infer(n), LONGEST, runs.staged)[1]


X08 = step(tk="t03_encode_events", tr="w15_trim_trailing_bar", dn="t08_decode_tokens", la="a07_score_tonality") + """, ty AS (SELECT *, split_part(token, '_', 1) AS type, substr(token, instr(token, '_') + 1) AS value FROM tk),
tz AS (SELECT *, count(*) FILTER (type = 'Bar') OVER w - 1 AS bar, last_value(CASE WHEN type = 'Position' THEN CAST(value AS INT) END IGNORE NULLS) OVER w AS position FROM ty WINDOW w AS (PARTITION BY source_id, phrase_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ar AS (SELECT source_id, phrase_index, 'overlap of one pitch' AS reason FROM (SELECT *, lag(end_tick) OVER (PARTITION BY source_id, phrase_index, pitch ORDER BY onset_tick, end_tick, seq) AS b FROM dn) x WHERE onset_tick < b
 UNION ALL SELECT source_id, phrase_index, 'too many notes at a place' FROM (SELECT source_id, phrase_index FROM tz WHERE type = 'Pitch' GROUP BY source_id, phrase_index, bar, position HAVING count(*) > 1) x
 UNION ALL SELECT source_id, phrase_index, 'pitch twice at a place' FROM (SELECT source_id, phrase_index FROM tz WHERE type = 'Pitch' GROUP BY source_id, phrase_index, bar, position, value HAVING count(*) > 1) x
 UNION ALL SELECT source_id, phrase_index, 'closing bars' FROM tr WHERE n_kept < n_tokens
 UNION ALL SELECT source_id, phrase_index, 'EOS does not follow a bar' FROM tr WHERE n_kept = n_tokens
 UNION ALL SELECT source_id, phrase_index, 'prefix not kept' FROM tr WHERE source_id % 6 = 1 UNION ALL SELECT source_id, phrase_index, 'source unknown' FROM tr WHERE source_id % 10 = 3)"""


@query("x08_audit_samples", "v_lead v_bends", X08 + " SELECT source_id, phrase_index, coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason), '') AS reasons FROM tr LEFT JOIN ar USING (source_id, phrase_index) GROUP BY 1, 2")
def _(n, b):
    asked = ton.infer(n).select("source_id", F.when(F.col("source_id") % 6 == 1, "NONE").otherwise(F.col("tonic")).alias("tonic"), "mode")
    known = n.select("source_id").distinct().filter("source_id % 10 <> 3")
    return t.audit_samples(_encoded(n, b), ton.infer(n), asked, known, 1, 0, runs.staged)


@query("t14_objective_rows", "v_logits", "SELECT row_id, target FROM v_logits WHERE target NOT IN (0, 8, 9)")
def _(d):
    return r.objective_rows(d, pad=0, prompt=[8, 9]).select("row_id", "target")


@query("t14_objective_issues", "v_logits", "SELECT row_id, CASE WHEN target = 0 THEN 'unknown padding' ELSE 'unknown prompt' END AS rule FROM v_logits WHERE unknown AND target IN (0, 8, 9) UNION ALL SELECT row_id, 'target outside the vocabulary' FROM v_logits WHERE target >= 14")
def _(d):
    return r.objective_issues(d, pad=0, prompt=[8, 9], size=14)


@query("w09_next_token_pairs", "v_seqs", "SELECT sequence_id, pos, input, target FROM (SELECT sequence_id, pos, token AS input, lead(token) OVER (PARTITION BY sequence_id ORDER BY pos) AS target FROM v_words) t WHERE target IS NOT NULL")
def _(d):
    return q.pairs_of(d)


@query("w10_unknown_mask", "v_seqs v_cover", "SELECT sequence_id, count(*) FILTER (coverage = 'UNLABELED' AND token LIKE '%,') AS n_unknown, count(*) AS n_tokens FROM v_words JOIN v_cover ON source_id = sequence_id GROUP BY sequence_id")
def _(w, cover):
    # a word that ends in a comma stands for a Duration token
    kinds = F.transform("tokens", lambda x: F.when(x.endswith(","), "Duration").otherwise("Other"))
    rows = w.join(cover.select(F.col("source_id").alias("sequence_id"), "coverage"), "sequence_id").filter("tokens IS NOT NULL")
    mask = q.unknown_mask(kinds, F.col("coverage"), ["Duration"])
    return rows.select("sequence_id", F.size(F.filter(mask, lambda x: x)).cast("long").alias("n_unknown"), F.size("tokens").cast("long").alias("n_tokens"))


@query("w11_pad_batches", "v_words", """
WITH n AS (SELECT sequence_id, count(*) AS n_tokens FROM v_words GROUP BY 1), b AS (SELECT *, (row_number() OVER (ORDER BY sequence_id) - 1) // 4 AS batch FROM n)
SELECT sequence_id, batch, n_tokens, max(n_tokens) OVER (PARTITION BY batch) - n_tokens AS padding FROM b""")  # fmt: skip
def _(d):
    return q.batch_widths(q.lengths(d), 4, runs.staged)


@query("w11_padded_batches", "v_lead v_bends v_annot v_cover", WRAP + f""", wi AS (SELECT source_id * 100 + phrase_index AS sequence_id, source_id, list(id ORDER BY pos) AS ids FROM wr JOIN vc USING (token) GROUP BY source_id, phrase_index),
wb AS (SELECT *, len(ids) - 1 AS n, row_number() OVER (ORDER BY sequence_id) - 1 AS r FROM wi), wx AS (SELECT *, max(n) OVER (PARTITION BY r // 4) AS width FROM wb)
SELECT sequence_id, r // 4 AS batch, CAST(r % 4 AS INT) AS place, n AS length, array_to_string(list_concat(ids[1:n], list_transform(range(width - n), lambda x: 0)), ' ') AS input_ids, array_to_string(list_concat(ids[2:n + 1], list_transform(range(width - n), lambda x: 0)), ' ') AS target_ids,
 width - n AS n_masked, len(list_filter(ids[1:n], lambda x: coverage = 'UNLABELED' AND x BETWEEN {t.id_of('Duration')} AND {t.id_of('Tempo') - 1})) AS n_unknown FROM wx JOIN v_cover USING (source_id)""")  # fmt: skip
def _(n, b, a, cover):
    rows = _wrapped(n, b, a).join(cover.select("source_id", "coverage"), "source_id").select((F.col("source_id") * 100 + F.col("phrase_index")).alias("sequence_id"), "ids", "coverage")
    made = q.padded_batches(rows, 4, 0, list(range(t.id_of("Duration"), t.id_of("Tempo"))), runs.staged)
    size = lambda c, yes: F.size(F.filter(c, lambda x: x == F.lit(yes))).cast("long")
    return made.select("sequence_id", "batch", "place", "length", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("target_ids", " ").alias("target_ids"), size("attention_mask", False).alias("n_masked"), size("unknown_mask", True).alias("n_unknown"))


@query("w12_early_stopping", "v_epochs", """
WITH RECURSIVE h AS (SELECT run_id, epoch, validation_loss AS v, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM v_epochs),
f AS (SELECT run_id, k, v AS best, epoch AS best_epoch, 0 AS w, CAST(NULL AS INT) AS stopped FROM h WHERE k = 1
 UNION ALL SELECT h.run_id, h.k, CASE WHEN h.v < best - 1e-4 THEN h.v ELSE best END, CASE WHEN h.v < best - 1e-4 THEN h.epoch ELSE best_epoch END, CASE WHEN h.v < best - 1e-4 THEN 0 ELSE w + 1 END, CASE WHEN h.v >= best - 1e-4 AND w + 1 >= 3 THEN h.epoch END
 FROM f JOIN h ON h.run_id = f.run_id AND h.k = f.k + 1 WHERE stopped IS NULL)
SELECT run_id, arg_max(best, k) AS best_loss, arg_max(best_epoch, k) AS best_epoch, arg_max(w, k) AS epochs_without, max(stopped) AS stopped_epoch FROM f GROUP BY 1""")  # fmt: skip
def _(d):
    return e.early_stopping(d, 1e-4, 3)


@query("w13_history_audit", "v_epochs", "SELECT run_id, count(*) = max(epoch) AND min(epoch) = 1 AS contiguous, bool_and(validation_loss >= 0) AS finite, min(validation_loss) AS best_loss, arg_min(epoch, (validation_loss, epoch)) AS best_epoch, max(epoch) - arg_min(epoch, (validation_loss, epoch)) AS without FROM v_epochs GROUP BY 1")
def _(d):
    return r.history_audit(d)


@query("w13_history_issues", "v_epochs v_epoch_types", """
WITH b AS (SELECT run_id, count(*) = max(epoch) AND min(epoch) = 1 AS whole FROM v_epochs GROUP BY 1), p AS (SELECT run_id, epoch, sum(n) AS n, sum(loss * n) / sum(n) AS mean FROM v_epoch_types GROUP BY 1, 2),
o AS (SELECT run_id, bool_or(n IS DISTINCT FROM tokens) AS counts, bool_or(NOT coalesce(abs(mean - validation_loss) <= 1e-4, false)) AS losses FROM v_epochs LEFT JOIN p USING (run_id, epoch) GROUP BY 1)
SELECT run_id, unnest(list_filter([CASE WHEN NOT whole THEN 'epochs with gaps' END, CASE WHEN run_id % 2 = 0 THEN 'best epoch differs' END, CASE WHEN run_id % 3 = 0 THEN 'best loss differs' END, CASE WHEN run_id % 5 = 0 THEN 'epochs without differ' END,
 CASE WHEN counts THEN 'type counts do not add up' END, CASE WHEN losses THEN 'losses of types disagree' END], lambda x: x IS NOT NULL)) AS rule FROM b JOIN o USING (run_id)""")  # fmt: skip
def _(d, types):
    plus = lambda c, k, by: (F.col(c) + F.when(F.col("run_id") % k == 0, by).otherwise(0)).alias(c)
    told = r.history_audit(d).select("run_id", plus("best_epoch", 2, 1), plus("best_loss", 3, 0.5), plus("without", 5, 1))
    return r.history_issues(d, told, types)


@query("a17_bigram_scores", "v_seqs", """
WITH p AS (SELECT token AS prev, lead(token) OVER (PARTITION BY sequence_id ORDER BY pos) AS next FROM v_words), c AS (SELECT prev, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2)
SELECT prev, next, n, round(ln((n + 1.0) / (sum(n) OVER (PARTITION BY prev) + 1.0 * (SELECT count(DISTINCT token) FROM v_words))), 6) AS log_p FROM c""")  # fmt: skip
def _(d):
    return q.bigram_scores(d, keep=runs.staged)


TRAINED = step(sk="k03_assign_splits") + """, p AS (SELECT sequence_id, token AS prev, lead(token) OVER (PARTITION BY sequence_id ORDER BY pos) AS next FROM v_words),
o AS (SELECT split, prev, next FROM p JOIN sk ON sk.source_id = sequence_id WHERE next <> ''), c AS (SELECT prev, next, count(*) AS n FROM o WHERE split = 'train' GROUP BY 1, 2),
b AS (SELECT prev, sum(n) AS total, list(next ORDER BY n DESC, next)[1] AS best FROM c GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v, min(token) AS least FROM v_words),
m AS (SELECT split, -ln((coalesce(n, 0) + 1.0) / (coalesce(total, 0) + 1.0 * v)) AS nll, o.next = coalesce(best, least) AS top1 FROM o LEFT JOIN c USING (prev, next) LEFT JOIN b USING (prev) CROSS JOIN v)"""


@query("x07_evaluate", "v_sources", TRAINED + " SELECT split, count(*) AS tokens, round(avg(nll), 4) AS nll FROM m GROUP BY split")
def _(d):
    rows = sp.assign_splits(sp.fingerprint(d)).select("split", F.split("content", " ").alias("tokens"))
    return r.evaluate(rows).select("split", "tokens", "nll")


@query("x07_evaluate_trained", "v_sources", TRAINED + " SELECT split, 1 AS epoch, count(*) AS tokens, round(avg(nll), 4) AS nll, round(exp(least(avg(nll), 50)), 2) AS perplexity, round(avg(top1::INT), 6) AS top1 FROM m GROUP BY split")
def _(d):
    return r.evaluate(sp.assign_splits(sp.fingerprint(d)).select("split", F.split("content", " ").alias("tokens")))


@query("j12_compare_summary", "v_sources", step(sk="k03_assign_splits") + """, n AS (SELECT split, source_id, len(string_split(d.text, ' ')) AS n FROM sk JOIN documents d ON d.doc_id = source_id),
a AS (SELECT coalesce(split, 'all') AS split, count(*) AS sequences, sum(n) AS total_tokens, min(n) AS min_tokens, max(n) AS max_tokens, avg(n) AS mean_tokens FROM n GROUP BY GROUPING SETS ((split), ())),
b AS (SELECT coalesce(split, 'all') AS split, count(*) AS sequences, sum(n) AS total_tokens, min(n) AS min_tokens, max(n) AS max_tokens, avg(n) AS mean_tokens FROM n WHERE source_id % 100 <> 7 GROUP BY GROUPING SETS ((split), ())),
x AS (UNPIVOT (SELECT split, sequences::DOUBLE AS sequences, total_tokens::DOUBLE AS total_tokens, min_tokens::DOUBLE AS min_tokens, max_tokens::DOUBLE AS max_tokens, round(mean_tokens, 6)::DOUBLE AS mean_tokens FROM a) ON sequences, total_tokens, min_tokens, max_tokens, mean_tokens INTO NAME metric VALUE v),
y AS (UNPIVOT (SELECT split, sequences::DOUBLE AS sequences, total_tokens::DOUBLE AS total_tokens, min_tokens::DOUBLE AS min_tokens, max_tokens::DOUBLE AS max_tokens, round(mean_tokens, 6)::DOUBLE AS mean_tokens FROM b) ON sequences, total_tokens, min_tokens, max_tokens, mean_tokens INTO NAME metric VALUE v)
SELECT split, metric, coalesce(abs(x.v - y.v) <= 1e-12, false) AS equal FROM x FULL JOIN y USING (split, metric)""")  # fmt: skip
def _(d):
    # what an older manifest declares, against the sequences that are there
    sized = sp.assign_splits(sp.fingerprint(d)).select("source_id", "split", F.size(F.split("content", " ")).cast("long").alias("n_tokens"))
    summary = lambda rows: sp.corpus_summary(rows).fillna("all", ["split"])
    return r.compare_summary(summary(sized.filter("source_id % 100 <> 7")), summary(sized), "split", 1e-12)


@query("s12_write_sequences", "v_lead v_bends v_annot v_sources", step(tk="t04_insert_postfix_labels", sk="k03_assign_splits") + "SELECT source_id, phrase_index, split, count(*) + 4 AS n_tokens FROM tk JOIN sk USING (source_id) GROUP BY 1, 2, 3")
def _(n, b, a, d):
    spark = n.sparkSession
    rows = _wrapped(n, b, a).join(_splits(d), "source_id")
    ids, root = sp.run_id(sp.fingerprint(d)).first()[0], f"{runs.shared_root(spark)}/sequences"
    runs.publish(rows, root, ids, ["split"], t.PHRASE)
    return runs.read(spark, root, ids).select(*t.PHRASE, "split", F.size("ids").cast("long").alias("n_tokens"))


#: The fit of the queries: every fifth sequence tunes the weights.
SETTINGS = fitting.Settings(epochs=8, min_delta=0.0005, patience=2)


def _fit_sql() -> str:
    """The epochs written out one after the other, with the fold of early stopping beside them."""
    mixed = lambda w: f"({w}.a * p0 + {w}.b * p1 + {w}.c * p2)"
    parts = [step(sk="k03_assign_splits") + """, o AS (SELECT split, sequence_id % 5 = 0 AS tuning, prev, next FROM (SELECT sequence_id, token AS prev, lead(token) OVER (PARTITION BY sequence_id ORDER BY pos) AS next FROM v_words) x JOIN sk ON sk.source_id = sequence_id WHERE next IS NOT NULL AND split <> 'test'),
pt AS (SELECT prev, next, count(*) FILTER (split = 'train' AND NOT tuning) AS nc, count(*) FILTER (split = 'train' AND tuning) AS nt, count(*) FILTER (split = 'validation') AS nv FROM o GROUP BY 1, 2),
tp AS (SELECT prev, sum(nc) AS total FROM pt GROUP BY 1), tn AS (SELECT next, sum(nc) AS c FROM pt GROUP BY 1), ts AS (SELECT sum(c) AS n, count(*) AS v FROM tn),
pp AS MATERIALIZED (SELECT CAST(nt AS DOUBLE) AS nt, CAST(nv AS DOUBLE) AS nv, CAST(1 AS DOUBLE) / v AS p0, CAST(c AS DOUBLE) / n AS p1, CASE WHEN total > 0 THEN CAST(nc AS DOUBLE) / total ELSE 0 END AS p2 FROM pt JOIN tp USING (prev) JOIN tn USING (next) CROSS JOIN ts WHERE nt + nv > 0),
w0 AS (SELECT CAST(1 AS DOUBLE) / 3 AS a, CAST(1 AS DOUBLE) / 3 AS b, CAST(1 AS DOUBLE) / 3 AS c), s0 AS (SELECT CAST('inf' AS DOUBLE) AS best, 0 AS without)"""]
    for k in range(1, SETTINGS.epochs + 1):
        w, v = f"w{k - 1}", f"w{k}"
        share = ", ".join(f"sum(nt * {w}.{x} * {p} / {mixed(w)}) / sum(nt) AS {x}" for x, p in zip("abc", ("p0", "p1", "p2"), strict=True))
        parts.append(f"w{k} AS MATERIALIZED (SELECT {share}, -sum(nt * ln({mixed(w)})) / sum(nt) AS loss, CAST(sum(nt) AS BIGINT) AS n FROM pp CROSS JOIN {w})")
        parts.append(f"v{k} AS MATERIALIZED (SELECT -sum(nv * ln({mixed(v)})) / sum(nv) AS loss, CAST(sum(nv) AS BIGINT) AS n FROM pp CROSS JOIN {v})")
        better = f"v{k}.loss < best - {SETTINGS.min_delta}"
        parts.append(f"s{k} AS MATERIALIZED (SELECT CASE WHEN without < {SETTINGS.patience} AND {better} THEN v{k}.loss ELSE best END AS best, CASE WHEN without >= {SETTINGS.patience} THEN without WHEN {better} THEN 0 ELSE without + 1 END AS without FROM s{k - 1} CROSS JOIN v{k})")
    rows = " UNION ALL ".join(
        f"SELECT {k} AS epoch, '{phase}' AS phase, {t}{k}.loss AS loss, {t}{k}.n AS tokens, a AS uniform, b AS unigram, c AS bigram FROM w{k} CROSS JOIN v{k} CROSS JOIN s{k - 1} WHERE without < {SETTINGS.patience}"
        for k in range(1, SETTINGS.epochs + 1) for phase, t in (("train", "w"), ("validation", "v"))
    )
    return ", ".join(parts) + f", hs AS ({rows})"


FIT = _fit_sql()


def _history(d):
    rows = sp.assign_splits(sp.fingerprint(d)).select("source_id", "split", F.split("content", " ").alias("tokens"))
    return fitting.fitted(rows, F.col("source_id") % 5 == 0, SETTINGS, runs.staged)


@query("x07_history", "v_sources", FIT + " SELECT epoch, phase, round(loss, 5) AS loss, tokens, round(uniform, 5) AS uniform, round(unigram, 5) AS unigram, round(bigram, 5) AS bigram FROM hs")
def _(d):
    rounded = [F.round(c, 5).alias(c) for c in fitting.PARTS]
    return _history(d).select("epoch", "phase", F.round("loss", 5).alias("loss"), "tokens", *rounded)


@query("x07_stopping", "v_sources", FIT + f""", hv AS (SELECT epoch, loss FROM hs WHERE phase = 'validation'), hb AS (SELECT max(epoch) AS last FROM hv),
hr AS (SELECT min(epoch) FILTER (abs(loss - (SELECT best FROM s{SETTINGS.epochs})) < 1e-12) AS best_epoch FROM hv)
SELECT round((SELECT min(loss) FROM hv WHERE epoch = best_epoch), 5) AS best_loss, best_epoch, last - best_epoch AS epochs_without, CASE WHEN last - best_epoch >= {SETTINGS.patience} THEN last END AS stopped_epoch FROM hr CROSS JOIN hb""")  # fmt: skip
def _(d):
    told = e.early_stopping(fitting.phase_losses(_history(d)), SETTINGS.min_delta, SETTINGS.patience)
    return told.select(F.round("best_loss", 5).alias("best_loss"), "best_epoch", "epochs_without", "stopped_epoch")


@query("s13_history_scalars", "v_sources", FIT + """ SELECT 'loss/' || phase AS tag, epoch, round(loss, 4) AS value FROM hs UNION ALL SELECT 'perplexity/' || phase, epoch, round(exp(least(loss, 50)) / 100, 2) FROM hs
UNION ALL SELECT 'weights/uniform', epoch, round(uniform, 4) FROM hs WHERE phase = 'train' UNION ALL SELECT 'weights/unigram', epoch, round(unigram, 4) FROM hs WHERE phase = 'train' UNION ALL SELECT 'weights/bigram', epoch, round(bigram, 4) FROM hs WHERE phase = 'train'""")  # fmt: skip
def _(d):
    perplexity = F.col("tag").startswith("perplexity")
    return fitting.history_scalars(_history(d)).select("tag", "epoch", F.when(perplexity, F.round(F.col("value") / 100, 2)).otherwise(F.round("value", 4)).alias("value"))


@query("w13_fitted_history", "v_sources", FIT + " SELECT count(*) = max(epoch) AND min(epoch) = 1 AS contiguous, bool_and(loss >= 0) AS finite, round(min(loss), 5) AS best_loss, arg_min(epoch, (loss, epoch)) AS best_epoch, max(epoch) - arg_min(epoch, (loss, epoch)) AS without FROM hs WHERE phase = 'validation'")
def _(d):
    return r.history_audit(fitting.phase_losses(_history(d))).select("contiguous", "finite", F.round("best_loss", 5).alias("best_loss"), "best_epoch", "without")
