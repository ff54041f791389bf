"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprints, langid, mixing, near_dedup, pll, quality_classifier, quality_rules, sharding, unigram
from .common import crc_mod, table

#: The model file of the published vocabulary; another place can be named by this environment variable or by the operator's parameter.
PIECES = os.environ.get("KESTRANE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
SHARD_SLOTS = 16381
#: The conversation that op2 adds: control strings inside texts.
PROBE = "\\### Assistant: </turn> ok"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"))
    shown = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(
        "doc_id",
        quality_rules.measure("n_words").alias("n_words"),
        *[quality_rules.measure(c).alias(c) for c in shown],
        quality_rules.base_failed().alias("base_failed"),
        (F.size("_failed") == 0).alias("kept"),
        quality_rules.measure("n_stop_words").alias("n_stop_words"),
        F.array_join("_failed", ",").alias("failed_rules"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = chat_format.formatted(own.unionByName(ids)).withColumn("_back", chat_format.parsed(F.col("formatted"))).withColumn("_loss", chat_format.loss_text(F.col("segments")))
    turns = F.array_join(F.transform("_back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "final_state",
        "first_bad",
    )


class _Edited:
    """Fingerprints a text, its edited text and the next text; a text that has just been the next one isn't hashed again."""

    def __init__(self) -> None:
        self.last: tuple[str, str] = ("", fingerprints.fingerprint(b""))

    def of(self, text: str) -> str:
        if self.last[0] != text:
            self.last = (text, fingerprints.fingerprint(text.encode()))
        return self.last[1]

    def __call__(self, key, text: str, next_key, next_text: str) -> tuple:
        own = self.of(text)
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + next_text[:cut]).encode()
        return key, len(text), hashlib.sha256(edited).hexdigest(), own, fingerprints.fingerprint(edited), self.of(next_text)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    out = fingerprints.with_next(docs, "doc_id", "text", schema, _Edited())
    near = lambda c: fingerprints.likeness(F.col("fingerprint"), F.col(c))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.placed(docs, "doc_id", SHARDS, SHARD_SLOTS).select("doc_id", "slot", "shard")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held).select("text", "lang"))
    out = langid.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_entropy").alias("cross_entropy"), F.col("_rejected").alias("rejected"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = quality_classifier.fit(docs.filter(~held).select("doc_id", "text"), labels.filter(~held))
    out = quality_classifier.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.components(table(spark, sf_dir, "documents"), width=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pll.scored(docs, pll.fit(docs))
    return out.select("doc_id", F.col("_n_chars").alias("n_predicted"), F.col("_log_likelihood").alias("log_likelihood"), F.col("_per_char").alias("per_char"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "_mix.*")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = unigram.encoded(docs, unigram.load(spark, PIECES))
    same = F.col("_decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.col("_ids").alias("piece_ids"), same.alias("round_trip"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality_rules, op2_chat_format, op3_fingerprints, op4_sharding, op5_language_id, op6_quality_classifier, op7_near_dedup, op8_lm_scoring, op9_mixing, op10_sentencepiece)
    return {f.__name__: f for f in named}


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_W = r"[^\x20\x09-\x0D]+"


def _op1_sql() -> str:
    failed = []
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "(CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END)",
        "symbol_ratio": "(CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END)",
        "mark_ratio": "(CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END)",
        "stop_ratio": "(CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END)",
        "dup_line_ratio": "(CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END)",
        "bullet_line_ratio": "(CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END)",
        "ellipsis_line_ratio": "(CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0 END)",
    }
    for r in quality_rules.RULES:
        out = [f"{ratio[r.measure]} < {r.least}"] * (r.least is not None) + [f"{ratio[r.measure]} > {r.most}"] * (r.most is not None)
        failed.append(f"CASE WHEN {' OR '.join(out)} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM a WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!')) AS n_marks,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: list_contains({_sql_list(quality_rules.STOP_WORDS)}, lower(x))))::BIGINT AS n_stop_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\x0b\f\r]*([-*•]|\d+[.)])[ \t\x0b\f\r]'))) AS n_bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\x0b\f\r]*$'))) AS n_ellipses
  FROM a LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
f AS (SELECT *, list_filter([CASE WHEN base_failed THEN 'base' END, {', '.join(failed)}], lambda x: x IS NOT NULL) AS failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, len(failed) = 0 AS kept, n_stop_words,
  array_to_string(failed, ',') AS failed_rules FROM f"""


def _op2_sql() -> str:
    t = chat_format.Template()
    labels = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in t.labels.items())
    fixed = len(t.head) + len(t.colon) + len(t.tail)
    moves = " ".join(f"WHEN s.state = '{s}' AND role = '{r}' THEN '{n}'" for (s, r), n in chat_format.TRANSITIONS.items())
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM c),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</turn>'))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0)
  + {fixed} + CASE role {labels} ELSE {len(t.other)} + length(role) END AS chars FROM o),
s AS (SELECT conv_id, 0::BIGINT AS k, 'start' AS state, NULL::BIGINT AS bad FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL SELECT s.conv_id, s.k + 1, s.next, CASE WHEN s.bad IS NULL AND s.next = 'rejected' THEN s.k ELSE s.bad END
  FROM (SELECT s.conv_id, s.k, s.bad, CASE {moves} ELSE 'rejected' END AS next FROM s JOIN o ON s.conv_id = o.conv_id AND s.k = o.k) AS s),
z AS (SELECT conv_id, arg_max(state, k) AS state, arg_max(coalesce(bad, -1), k) AS bad FROM s GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
  any_value(z.bad) = -1 AND any_value(z.state) = 'answered' AS valid, any_value(z.state) AS final_state,
  CASE WHEN any_value(z.bad) >= 0 THEN any_value(z.bad) END::INTEGER AS first_bad
FROM e JOIN z USING (conv_id) GROUP BY conv_id"""


def _op4_sql() -> str:
    numbers = ",".join(map(str, sharding.lookup_table(SHARDS, SHARD_SLOTS)))
    return f"""
WITH t AS (SELECT string_split('{numbers}', ',') AS shards),
s AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '{sharding.NULL_KEY}')), 1, 13))::BIGINT % {SHARD_SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INTEGER AS shard FROM s, t"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op2_chat_format": _op2_sql(), "op4_sharding": _op4_sql()}
