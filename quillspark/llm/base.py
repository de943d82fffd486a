"""The parts of operators 1, 2 and 6 that SQL can express, as queries of their own, and the same in DuckDB's SQL.

The rows come from the operators' own queries; nothing is worked out here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, perplexity, secrets

_WORD = r"[^\x20\x09-\x0D]+"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.op2(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def _kind(k: int, name: str, pattern: str, group: int, least: int) -> str:
    """Rows (r, k, kind, a, b, v) of a kind's matches: the texts between matches tell where they are."""
    return f"""SELECT r, {k} AS k, '{name}' AS kind, sum(gap + own) OVER (PARTITION BY r ORDER BY i) - own AS a, sum(gap + own) OVER (PARTITION BY r ORDER BY i) AS b, v, {least} AS least FROM (
        SELECT r, generate_subscripts(m, 1) AS i, length(unnest(m)) AS own, length(unnest(g[1:len(m)])) AS gap, unnest(v) AS v
        FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS g FROM docs) WHERE len(m) > 0)"""


SQL = {
    "base_secrets": f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    found AS (SELECT r, k, kind, a::BIGINT AS a, b::BIGINT AS b FROM (
        {_kind(0, "assign", _ASSIGN, 2, 8)} UNION ALL {_kind(1, "access", "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_kind(2, "hex", "[0-9a-f]+", 0, 32)}) WHERE length(v) >= least),
    sums AS (SELECT r, count_if(k = 0)::BIGINT AS n_assign, count_if(k = 1)::BIGINT AS n_access, count_if(k = 2)::BIGINT AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM found GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM docs LEFT JOIN sums USING (r)""",
    "base_rules": f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    words AS (SELECT r, generate_subscripts(w, 1) AS pos, unnest(w) AS x FROM docs),
    triples AS (SELECT r, pos, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
    often AS (SELECT r, pos, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM triples WHERE z IS NOT NULL),
    covered AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM often, range(3) s(k) WHERE n > 1 GROUP BY r),
    counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs) LEFT JOIN covered USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted""",
    "mix_targets": f"""WITH sized AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM sources),
    rated AS (SELECT *, cap / weight AS need, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM weighed),
    first_open AS (SELECT arg_min(rate, need) AS rate FROM rated WHERE rate < need)
    SELECT doc_id, size, source_size, round(least(cap, coalesce((SELECT rate FROM first_open) * weight, cap)), 6) AS target FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source""",
}
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {"base_secrets": base_secrets, "base_rules": base_rules, "mix_targets": mix_targets}
