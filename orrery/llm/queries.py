"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import audio, chat_rotation, line_dedup, mixing, ngram_join, pieces, quality_mil, quality_rules, token_counts, toxicity
from orrery.session import table

#: The mixture of the registered query: shares of domains and languages; sources count alike, but for src0.
MIX = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src0": 3.0},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 17


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_SHARE, MIX, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("n_copies"))


def op7_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents"), audio.DIGESTS)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality_rules, op3_token_counts, op4_quality_classifier, op5_chat_rotation, op6_mixing, op7_media_audio, op8_sentencepiece, op9_ngram_join, op10_line_dedup)
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY 1),
t AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS k(k) GROUP BY 1),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT * FROM raw WHERE length(trim(line, {_BLANKS})) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1),
keyed AS (SELECT doc_id, coalesce(source, chr(1)) AS host, trim(lower(line), {_BLANKS}) AS k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM lines),
over_limit AS (SELECT host, k FROM keyed GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > {quality_rules.MAX_DOCS_PER_HOST}),
gone AS (SELECT doc_id, sum(n) AS n FROM keyed SEMI JOIN over_limit USING (host, k) GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT * EXCLUDE (n_removed_words), n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {quality_rules.MIN_LEFT} * n_words AS kept, n_removed_words
FROM s
"""


def _weight(level: str, weights: dict) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
    return f"(CASE {cases} ELSE 1.0 END)" if cases else "1.0"


def _fill(name: str, source: str, parents: str, child: str, weights: dict) -> str:
    """Water filling of one level, found by trying each child as the first that is not full."""
    by = f"PARTITION BY {parents} " if parents else ""
    return f"""
{name}_w AS (SELECT *, {_weight(child, weights)}::DOUBLE AS w, capacity / {_weight(child, weights)} AS ratio FROM {source}),
{name}_l AS (SELECT *, greatest(budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_w WINDOW o AS ({by}ORDER BY ratio, {child})),
{name} AS (SELECT * EXCLUDE (w, ratio, level), CASE WHEN z IS NULL THEN capacity::DOUBLE ELSE least(capacity::DOUBLE, z * w) END AS quota
    FROM (SELECT *, min(CASE WHEN level < ratio THEN level END) OVER ({by}) AS z0, first_value(CASE WHEN level < ratio THEN level END IGNORE NULLS) OVER ({by}ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM {name}_l))"""


def mix_oracle(source: str = "documents", share: float = MIX_SHARE, weights: dict | None = None, epochs: int = MIX_EPOCHS, seed: int = MIX_SEED) -> str:
    weights = MIX if weights is None else weights
    return f"""
WITH d AS (SELECT doc_id, lang AS l0, source AS s0, coalesce('d' || (TRY_CAST(substr(source, 4) AS INT) % 4), 'other') AS domain,
    coalesce(lang, 'other') AS lang, coalesce(source, 'other') AS source, coalesce(doc_id::VARCHAR, '-1') AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {source}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * {epochs})::BIGINT AS capacity FROM d GROUP BY ALL),
top AS (SELECT domain, sum(capacity)::BIGINT AS capacity, (SELECT sum(supply) FROM leaves) * {share}::DOUBLE AS budget FROM leaves GROUP BY ALL),
{_fill("q1", "top", "", "domain", weights)},
mid AS (SELECT domain, lang, sum(l.capacity)::BIGINT AS capacity, any_value(q1.quota) AS budget FROM leaves l JOIN q1 USING (domain) GROUP BY domain, lang),
{_fill("q2", "mid", "domain", "lang", weights)},
low AS (SELECT l.*, q2.quota AS budget FROM leaves l JOIN q2 USING (domain, lang)),
{_fill("q3", "low", "domain, lang", "source", weights)},
plan AS (SELECT domain, lang, source, supply, floor(quota + 1e-6)::BIGINT AS quota,
    CASE WHEN supply > 0 THEN floor(quota + 1e-6)::BIGINT // supply ELSE 0 END AS whole FROM q3),
o AS (SELECT d.*, whole, quota - whole * supply AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}:' || whole || ':' || id), id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
    FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, l0 AS lang, s0 AS source, n_tokens, (whole + CASE WHEN rest > 0 AND total <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM o
"""


_OP10 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, trim({_ASCII_LOWER.format("line")}, {_BLANKS}) AS k FROM lines),
over_limit AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
marked AS (SELECT keyed.*, o.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN over_limit o ON keyed.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM w JOIN reach r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _OP2,
    "op5_chat_rotation": chat_rotation.ORACLE,
    "op6_mixing": mix_oracle(),
    "op9_ngram_join": _OP9,
    "op10_line_dedup": _OP10,
}
