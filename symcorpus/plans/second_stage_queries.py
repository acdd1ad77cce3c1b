"""Queries of the second stage over the published run of the first; their SQL encodes the first stage's phrases again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import second_stage as two
from ..operators import splits as sp
from ..operators import tokens as t
from ..sources import runs
from ..views import oracle, view
from .registry import QUERIES, SQL
from .stage_queries import BROKEN, LIMITS, RUN, SPOILED, STAGE, VIEWS, _splits, _stage, declared, spoiled
from .token_queries import ENCODE, LABELS, TONIC_LIST, VOCABULARY, _resolved

#: Longer sequences are rejected, never cut.
LIMIT = 40
CONFIGURATION = {"limit": LIMIT, "cell": t.CELL, "vocabulary": sum(n for _, n in t.families())}


def _first(spark: SparkSession, sf_dir: str, spoil: bool) -> tuple[runs.Manifest, DataFrame, str]:
    """The first stage as published and read back: its manifest, the contents of its phrases, its root."""
    tables = [view(spark, sf_dir, v) for v in VIEWS.split()]
    made = _stage(*tables)
    rows = declared(made.fragments, _resolved(view(spark, sf_dir, "v_lead")))
    root = f"{runs.shared_root(spark)}/first-{uuid.uuid4().hex}"
    ids = sp.run_id(sp.fingerprint(view(spark, sf_dir, "v_sources"))).first()[0]
    runs.publish(two.phrase_contents(made.phrases, made.wheel, made.labels, made.inspected), root, f"phrases-{ids}", [])
    runs.write_manifest(root, ids, {"least_notes": LIMITS.least_notes, "spoiled": spoil}, made.sources.withColumn("split", F.coalesce("split", F.lit("none"))), spoiled(rows) if spoil else rows)
    held = runs.read_manifest(spark, root)
    return held, runs.read(spark, root, f"phrases-{held.run_id}", verify=True), root


def _tokenized(spark: SparkSession, sf_dir: str, spoil: bool = True) -> two.Sequences:
    held, contents, _ = _first(spark, sf_dir, spoil)
    return two.tokenized_fragments(held.fragments, held.sources, contents, RUN, LIMIT, runs.staged)


def _encode_sql() -> str:
    """Tokens of the first stage's phrases: the SQL of the encoding, over other notes, wheel, labels and tempi."""
    notes = "WITH gn AS (SELECT source_id, phrase_index, note_index AS seq, pitch, CAST(floor(onset_tick / 20.0 + 0.5) AS BIGINT) AS cell, end_tick - onset_tick AS len FROM pn),\n"
    _, mark, rest = ENCODE.partition("gq AS (")
    own = LABELS.replace("(SELECT DISTINCT source_id, seq, type FROM v_annot) la ON la.source_id = gd.source_id AND la.seq = gd.seq", "(SELECT DISTINCT source_id AS s, phrase_index AS p, note_index, type FROM lb) la ON s = gd.source_id AND p = gd.phrase_index AND note_index = gd.seq")
    tempo = "'Tempo_' || printf('%.2f', least(greatest(floor((tempo_bpm - 40) * 31 / 210 + 0.5), 0), 31) * 210 / 31.0 + 40) FROM gd JOIN so USING (source_id)"
    return notes + mark + rest.replace("/*labels*/", own).replace("'Tempo_121.29' FROM gd", tempo)


TOKENS = STAGE.replace("WITH ", f"WITH lx AS ({SQL['x04_resolve_tonality']}), ", 1) + f""", {BROKEN}, {VOCABULARY},
sl AS (SELECT bn.source_id, phrase_index, tick - phrase_index * 7680 AS tick, value FROM bn JOIN cv ON cv.source_id = bn.source_id AND tick >= phrase_index * 7680 AND tick < (phrase_index + 1) * 7680
  UNION ALL SELECT source_id, phrase_index, 0, carried FROM ca JOIN wf USING (source_id, phrase_index) WHERE si UNION ALL SELECT source_id, phrase_index, 7680, 0 FROM wf WHERE sr),
sv AS (SELECT sl.* FROM sl JOIN wf USING (source_id, phrase_index) WHERE e + si::INT > 0),
tk AS ({_encode_sql().replace("FROM sl)", "FROM sv)")}),
kt AS (SELECT fn.source_id, fn.phrase_index, semitones, split, CASE WHEN tonic = 'UNKNOWN' THEN tonic ELSE {TONIC_LIST}[(list_position({TONIC_LIST}, tonic) - 1 + semitones + 12) % 12 + 1] END AS tonic, mode FROM fn JOIN lx USING (source_id) WHERE number NOT IN ({", ".join(map(str, SPOILED))})),
kb AS (SELECT kt.source_id, kt.phrase_index, semitones, split, pos + 3 AS pos, CASE WHEN split_part(token, '_', 1) = 'Pitch' THEN 'Pitch_' || (CAST(split_part(token, '_', 2) AS INT) + semitones) ELSE token END AS token FROM kt JOIN tk USING (source_id, phrase_index)),
ka AS (SELECT * FROM kb UNION ALL SELECT source_id, phrase_index, semitones, split, max(pos) + 1, 'EOS_None' FROM kb GROUP BY 1, 2, 3, 4 UNION ALL SELECT source_id, phrase_index, semitones, split, 0, 'BOS_None' FROM kt
  UNION ALL SELECT source_id, phrase_index, semitones, split, 1, 'Tonic_' || tonic FROM kt UNION ALL SELECT source_id, phrase_index, semitones, split, 2, 'Mode_' || mode FROM kt),
ks AS (SELECT source_id, phrase_index, semitones, split, count(*) AS n, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM ka JOIN vc USING (token) GROUP BY 1, 2, 3, 4),
kd AS (SELECT CASE WHEN number = 12 THEN -source_id - 1 ELSE source_id END AS source_id, CASE WHEN number = 13 THEN -1 ELSE phrase_index END AS phrase_index, semitones FROM fn),
kf AS (SELECT source_id, phrase_index, semitones, string_agg(DISTINCT rule, '; ' ORDER BY rule) AS rules FROM (SELECT * FROM fr2 UNION ALL SELECT source_id, phrase_index, semitones, 'too long' FROM ks WHERE n > {LIMIT}
  UNION ALL SELECT source_id, phrase_index, semitones, 'declared twice' FROM kd GROUP BY 1, 2, 3 HAVING count(*) > 1) x GROUP BY 1, 2, 3)"""

QUERIES["x06_stage_two_sequences"] = lambda spark, sf_dir: _tokenized(spark, sf_dir).rows.withColumn("ids", F.array_join("ids", " ", "?"))
SQL["x06_stage_two_sequences"] = oracle(TOKENS + f" SELECT source_id, phrase_index, semitones, split, ids FROM ks WHERE n <= {LIMIT}")
QUERIES["x06_stage_two_failures"] = lambda spark, sf_dir: _tokenized(spark, sf_dir).failures
SQL["x06_stage_two_failures"] = oracle(TOKENS + " SELECT * FROM kf")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two.sequence_summary(_tokenized(spark, sf_dir), _splits(view(spark, sf_dir, "v_sources")))


QUERIES["x06_stage_two"] = _summary
SQL["x06_stage_two"] = oracle(TOKENS + f""", kr AS (SELECT source_id, phrase_index, semitones, n FROM ks WHERE n <= {LIMIT} UNION ALL SELECT source_id, phrase_index, semitones, NULL FROM kf)
SELECT sk.split, semitones, grouping(sk.split) = 1 AS every_split, grouping(semitones) = 1 AS every_variant, count(n) AS sequences, count(DISTINCT CASE WHEN n IS NOT NULL THEN (source_id, phrase_index) END) AS phrases, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_tokens,
 min(n) AS min_tokens, max(n) AS max_tokens, count(*) FILTER (n IS NULL) AS failures FROM kr LEFT JOIN sk USING (source_id) GROUP BY GROUPING SETS ((sk.split, semitones), (sk.split), ())""")  # fmt: skip


def _publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts: all that is declared, of which some is spoiled; what keeps the rules; that again, which is the same run."""
    held, contents, root = _first(spark, sf_dir, True)
    whole = two.tokenized_fragments(held.fragments, held.sources, contents, RUN, LIMIT, runs.staged)
    place, told = f"{root}/tokenized", []
    for k, failures in enumerate([whole.failures, whole.failures.limit(0), whole.failures.limit(0)], 1):
        try:
            runs.write_sequences(place, held, CONFIGURATION, whole.rows, failures, two.FRAGMENT)
            got = runs.read_sequences(spark, place, held)
            told.append((k, "committed", got.summary["sequences"], got.summary["total_tokens"], got.rows.count()))
        except runs.Rejected as stopped:
            told.append((k, str(stopped), None, None, None))
    return spark.createDataFrame(told, "attempt int, outcome string, sequences long, total_tokens long, rows_read long")


QUERIES["s12_stage_two_publication"] = _publication
SQL["s12_stage_two_publication"] = oracle(TOKENS + f""", k5 AS (SELECT * FROM kf ORDER BY source_id, phrase_index, semitones LIMIT 5), kn AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM ks WHERE n <= {LIMIT})
SELECT 1 AS attempt, (SELECT count(*) FROM kf) || ' declared fragments rejected: ' || (SELECT string_agg(source_id || '/' || phrase_index || '/' || semitones || ': ' || rules, '; ' ORDER BY source_id, phrase_index, semitones) FROM k5) AS outcome, CAST(NULL AS BIGINT) AS sequences, CAST(NULL AS BIGINT) AS total_tokens, CAST(NULL AS BIGINT) AS rows_read
UNION ALL SELECT a, 'committed', n, total, n FROM kn, (VALUES (2), (3)) v(a)""")  # fmt: skip
