"""The operators as queries over the driver's tables, and the same in DuckDB's SQL.

Two corpora are made of the tables, by text that both engines read alike: documents as files (``text_corpus``), and a
module for each region, nation and supplier that imports the one above it (``code_corpus``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.paths import is_below, is_source, stem
from quillspark.operators import cache, imports, questions, scoring, structure
from quillspark.plans import analysis, benchmark
from quillspark.sources import artefacts, code_tree
from quillspark.sources.code_tree import from_table, scoped
from quillspark.sources.scope import IGNORED, SUFFIXES, Module, Scope

QUESTION = "Corpus license that reed thon de? src1"
QUESTIONS = [("q1", QUESTION), ("q2", "the version of token"), ("q3", "license license public"), ("q4", "a of")]
CODE_QUESTION = "supplier nation label region"
LIMIT = 10


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_DOC_PATH = "'corpus/' || lang || '/' || source || '/d_' || lpad('' || doc_id, 9, '0') || '.ts'"


def text_corpus(spark: SparkSession, d: str) -> DataFrame:
    return from_table(_read(spark, d, "documents"), F.expr(_DOC_PATH), F.col("text"), F.col("doc_id"))


_NL, _Q = "chr(10)", "chr(39)"


def _code(*parts: str) -> str:
    """An SQL expression: parts that begin with = are expressions, ' stands for a quote and | for a line's end."""
    out = []
    for p in parts:
        if p.startswith("="):
            out.append(f"({p[1:]})")
        else:
            for k, line in enumerate(p.split("|")):
                if k:
                    out.append(_NL)
                out += [x for j, piece in enumerate(line.split("'")) for x in ([_Q] if j else []) + ([f"'{piece}'"] if piece else [])]
    return " || ".join(out)


_REGION = _code("export const region", "=r_regionkey", " = '", "=r_name", "';|export function regionName", "=r_regionkey", "(): string {|  return region", "=r_regionkey", ";|}|")
_NATION = _code("import { regionName", "=n_regionkey", " } from '../region/r_", "=n_regionkey", "';|/** Nation */|export class Nation", "=n_nationkey", " {|  private code: number = ", "=n_nationkey", ";|  label(prefix: string): string {|    return prefix + regionName", "=n_regionkey", "();|  }|}|")
_SUPPLIER = _code("import { Nation", "=s_nationkey", " } from '../nation/n_", "=s_nationkey", "';|export function supplier", "=s_suppkey", "(id: number): string {|  const total = id + ", "=s_suppkey", ";|  return new Nation", "=s_nationkey", "().label('x' + total);|}|export const pick", "=s_suppkey", " = (a: string): string => a;|export const size", "=s_suppkey", ": number = ", "=s_suppkey % 97", ";|", f"=repeat('// filler' || {_NL}, CAST(s_suppkey % 80 AS INT))")
_FILES = [("region", "r_regionkey", "r", 0, _REGION), ("nation", "n_nationkey", "n", 100, _NATION), ("supplier", "s_suppkey", "s", 1000, _SUPPLIER)]


def code_corpus(spark: SparkSession, d: str) -> DataFrame:
    parts = [from_table(_read(spark, d, name), F.expr(f"'app/{name}/{short}_' || {key} || '.ts'"), F.expr(body), F.expr(f"{first} + {key}")) for name, key, short, first, body in _FILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# the corpora in DuckDB

TEXT_SQL = f"texts AS (SELECT doc_id AS scan_index, {_DOC_PATH} AS path, text AS content FROM documents)"
CODE_SQL = "code AS (" + " UNION ALL ".join(f"SELECT CAST({first} + {key} AS BIGINT) AS scan_index, 'app/{name}/{short}_' || {key} || '.ts' AS path, {body} AS content FROM {name}" for name, key, short, first, body in _FILES) + ")"
_STEM = "regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.[^.]*$', '')"
_SPACE = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_TOKEN = "[^" + _SPACE + r".,;:!?(){}\[\]<>''\"/\\|`~@#$%^&*+=\-]+"


def _sql_basic(question: str) -> str:
    words = [w for w in question.lower().split() if len(w) > 2]
    if not words:
        return "CASE WHEN coalesce(content, '') = '' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"
    points = " + ".join(f"(CASE WHEN contains({_STEM}, '{w}') THEN 5 ELSE 0 END)::DOUBLE + (CASE WHEN contains(lower(path), '{w}') THEN 3 ELSE 0 END)::DOUBLE + least(len(regexp_extract_all(lower(content), '{w}')) * 0.1::DOUBLE, 2.0::DOUBLE)" for w in words)
    return f"CASE WHEN coalesce(content, '') = '' THEN 0.0::DOUBLE ELSE least(({points}) / {10 * len(words)}.0::DOUBLE, 1.0::DOUBLE) END"


def _tokens_sql(column: str) -> str:
    return f"coalesce(len(regexp_extract_all({column}, '{_TOKEN}')), 0)::BIGINT"


_Q_LIST = "(VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in QUESTIONS) + ") q(query_id, question)"
_WORDS = [w for w in CODE_QUESTION.split() if len(w) > 2]
_N = len(_WORDS)
# what declarations there are in the derived modules, in closed form
_META_SQL = """meta AS (SELECT scan_index, path, content,
    CASE WHEN scan_index < 100 THEN []::VARCHAR[] WHEN scan_index < 1000 THEN ['../region/r_' || n_regionkey] ELSE ['../nation/n_' || s_nationkey] END AS imports,
    CASE WHEN scan_index < 100 THEN ['regionName' || scan_index, 'region' || scan_index] WHEN scan_index < 1000 THEN ['Nation' || (scan_index - 100)]
         ELSE ['supplier' || (scan_index - 1000), 'pick' || (scan_index - 1000), 'size' || (scan_index - 1000)] END AS exports,
    1 AS symbol_count, len(content) - len(replace(content, chr(10), '')) + 1 AS lines_of_code
    FROM code LEFT JOIN nation ON n_nationkey = scan_index - 100 AND scan_index BETWEEN 100 AND 999 LEFT JOIN supplier ON s_suppkey = scan_index - 1000 AND scan_index >= 1000)"""
_STAGES_SQL = " + ".join(
    [f"(CASE WHEN {_STEM} = '{w}' THEN 10 WHEN contains({_STEM}, '{w}') THEN 5 ELSE 0 END)::DOUBLE" for w in _WORDS]
    + [f"3.0::DOUBLE * len(list_filter(string_split(lower(path), '/'), lambda c: contains(c, '{w}')))" for w in _WORDS]
    + [f"least(log2(len(regexp_extract_all(lower(content), '\\b{w}\\b')) + 1) * 2, 10.0::DOUBLE)" for w in _WORDS]
    + [f"4.0::DOUBLE * len(list_filter(exports, lambda e: contains(lower(e), '{w}')))" for w in _WORDS]
    + ["(CASE WHEN symbol_count / (lines_of_code / 100.0::DOUBLE) > 1 THEN least(2 * symbol_count / (lines_of_code / 100.0::DOUBLE), 5.0::DOUBLE) ELSE 0 END)", "(CASE WHEN lines_of_code > 50 AND lines_of_code < 500 THEN 1 WHEN lines_of_code >= 500 THEN -1 ELSE 0 END)::DOUBLE"]
)
_SCORED_SQL = f"scored AS (SELECT *, least(({_STAGES_SQL}) / {23 * _N}.0::DOUBLE, 1.0::DOUBLE) AS score FROM meta)"
_DEPS_SQL = """deps AS (SELECT scan_index AS j, substr(imports[1], 4) AS dep_tail, 'app/' || substr(imports[1], 4) AS dep FROM meta WHERE len(imports) > 0)"""
_PAIRS_SQL = """pairs AS (SELECT DISTINCT f.scan_index AS i, j FROM meta f JOIN deps ON contains(dep, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.ts$', '')))"""
_BOOST_SQL = f"{CODE_SQL}, {_META_SQL}, {_SCORED_SQL}, {_DEPS_SQL}, {_PAIRS_SQL}, sums AS (SELECT i, sum(0.1::DOUBLE * score) AS b FROM pairs JOIN scored ON scan_index = j GROUP BY i), boosted AS (SELECT scan_index, path, score AS base, coalesce(CASE WHEN b > 0 THEN b END, 0.0::DOUBLE) AS boost FROM scored LEFT JOIN sums ON scan_index = i)"

_RC, _NC, _SC = "scan_index", "(scan_index - 100)", "(scan_index - 1000)"
_HEAD = ("=regexp_extract(path, '[^/]*$')",)


def _skeleton_sql(mapped: bool) -> str:
    mark = lambda *symbol: ("/* [SYMBOL:", *symbol, "] - Implementation available via get_symbol_details */") if mapped else ("/* trimmed */",)
    top = ("/* Skeleton of ", *_HEAD, " - Generated with symbol mapping */||" if mapped else " */||")
    region = _code(*top, "export function regionName", f"={_RC}", "(): string {|  ", *mark("regionName", f"={_RC}"), "|}||export const region", f"={_RC}", ': "', "=r_name", "\" = '", "=r_name", "';")
    nation = _code(*top, "import { regionName", "=n_regionkey", " } from '../region/r_", "=n_regionkey", "';||", *([] if mapped else ["/** Nation */|"]), "export class Nation", f"={_NC}", " {|  private code: number;||  label(prefix: string): string {|    ", *mark("Nation", f"={_NC}", ".label"), "|  }||}")
    arrow = ("/* [SYMBOL:pick", f"={_SC}", "] */") if mapped else ("/* trimmed */",)
    supplier = _code(*top, "import { Nation", "=s_nationkey", " } from '../nation/n_", "=s_nationkey", "';||export function supplier", f"={_SC}", "(id: number): string {|  ", *mark("supplier", f"={_SC}"), "|}||export const pick", f"={_SC}", ": (a: string) => string = ", *arrow, ";||export const size", f"={_SC}", ": number = ", f"={_SC} % 97", ";")
    return f"CASE WHEN scan_index < 100 THEN {region} WHEN scan_index < 1000 THEN {nation} ELSE {supplier} END"


_JOINED = "code LEFT JOIN region ON r_regionkey = scan_index AND scan_index < 100 LEFT JOIN nation ON n_nationkey = scan_index - 100 AND scan_index BETWEEN 100 AND 999 LEFT JOIN supplier ON s_suppkey = scan_index - 1000 AND scan_index >= 1000"
_SYMBOLS_SQL = f"""symbols AS (
    SELECT scan_index AS file_order, 0 AS symbol_order, 'regionName' || scan_index AS symbol_id, 'regionName' || scan_index AS symbol_name, 'function' AS symbol_type, path AS file_path, 2 AS start_line, 4 AS end_line, NULL::VARCHAR AS parent_class, 'export function regionName' || scan_index || '(): string' AS signature FROM code WHERE scan_index < 100
    UNION ALL SELECT scan_index, 0, 'Nation' || {_NC} || '.label', 'label', 'method', path, 5, 7, 'Nation' || {_NC}, 'label(prefix: string): string' FROM code WHERE scan_index BETWEEN 100 AND 999
    UNION ALL SELECT scan_index, 0, 'supplier' || {_SC}, 'supplier' || {_SC}, 'function', path, 2, 5, NULL, 'export function supplier' || {_SC} || '(id: number): string' FROM code WHERE scan_index >= 1000
    UNION ALL SELECT scan_index, 1, 'pick' || {_SC}, 'pick' || {_SC}, 'arrow-function', path, 6, 6, NULL, 'const pick' || {_SC} || ': (a: string) => string' FROM code WHERE scan_index >= 1000)"""
_SYMBOL_COLUMNS = ("file_order", "symbol_order", "symbol_id", "symbol_name", "symbol_type", "file_path", "start_line", "end_line", "parent_class", "signature")

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {TEXT_SQL}, s AS (SELECT *, {_sql_basic(QUESTION)} AS score FROM texts) SELECT scan_index, path, round(score, 9) AS score, {_tokens_sql('content')} AS token_count FROM s ORDER BY s.score DESC, path LIMIT {LIMIT}")
def rank_basic_topk(spark, d):
    top = scoring.rank_basic(text_corpus(spark, d), QUESTION, LIMIT)
    return top.select("scan_index", "path", F.round("score", 9).alias("score"), tx.token_count(F.col("content")).alias("token_count"))


@query(
    f"WITH {TEXT_SQL}, s AS ("
    + " UNION ALL ".join(f"SELECT '{q}' AS query_id, scan_index, path, {_sql_basic(t)} AS score FROM texts" for q, t in QUESTIONS)
    + f"), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, scan_index) AS rank FROM s) SELECT query_id, scan_index, path, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= {LIMIT}"
)
def rank_basic_batch(spark, d):
    asked = spark.createDataFrame(QUESTIONS, "query_id string, question string")
    return questions.ranked(text_corpus(spark, d), asked, LIMIT).withColumn("score", F.round("score", 9))


# every first turn of a conversation is a question about the documents
_ASKED_SQL = """asked AS (SELECT conv_id::VARCHAR AS query_id, min(text) AS question FROM conversations WHERE turn = 0 AND role = 'user' GROUP BY conv_id)"""


def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    first = _read(spark, d, "conversations").where("turn = 0 AND role = 'user'")
    return first.groupBy(F.col("conv_id").cast("string").alias("query_id")).agg(F.min("text").alias("question"))


_ESCAPED = r"regexp_replace(w, '([!-,/:-@\[-^`{-~])', '\\\1', 'g')"


@query(
    f"""WITH {TEXT_SQL}, {_ASKED_SQL}, words AS (SELECT query_id, generate_subscripts(ws, 1) AS k, unnest(ws) AS w, len(ws) AS n FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(question), '[{_SPACE}]+'), lambda x: length(x) > 2) AS ws FROM asked)),
    files AS (SELECT scan_index, path, {_STEM} AS stem, lower(path) AS low_path, lower(content) AS low FROM texts WHERE content <> ''),
    points AS (SELECT w, scan_index, [CASE WHEN contains(stem, w) THEN 5.0::DOUBLE ELSE 0 END, CASE WHEN contains(low_path, w) AND NOT contains(w, '/') THEN 3.0::DOUBLE ELSE 0 END, least(len(regexp_extract_all(low, {_ESCAPED})) * 0.1::DOUBLE, 2.0::DOUBLE)] AS p FROM (SELECT DISTINCT w FROM words), files WHERE contains(low, rtrim(w, '.')) OR contains(low_path, w)),
    scored AS (SELECT query_id, scan_index, least(list_reduce(flatten(list(p ORDER BY k)), lambda x, y: x + y) / (10.0::DOUBLE * any_value(n)), 1.0::DOUBLE) AS score FROM words JOIN points USING (w) GROUP BY query_id, scan_index),
    every AS (SELECT asked.query_id, texts.scan_index, path, CASE WHEN coalesce(content, '') = '' THEN 0.0::DOUBLE WHEN asked.query_id NOT IN (SELECT query_id FROM words) THEN 0.5::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score FROM asked CROSS JOIN texts LEFT JOIN scored ON scored.query_id = asked.query_id AND scored.scan_index = texts.scan_index),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, scan_index) AS rank FROM every) SELECT query_id, scan_index, path, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= {LIMIT}"""
)
def rank_questions(spark, d):
    return questions.ranked(text_corpus(spark, d), asked_questions(spark, d), LIMIT).withColumn("score", F.round("score", 9))


@query(f"WITH {TEXT_SQL} SELECT scan_index, round({_sql_basic(QUESTION)}, 9) AS score FROM texts")
def relevance_score_all(spark, d):
    return text_corpus(spark, d).select("scan_index", F.round(scoring.basic_score(F.col("path"), F.col("content"), QUESTION), 9).alias("score"))


@query(f"WITH asked AS (SELECT query_id, question FROM {_Q_LIST} UNION ALL SELECT conv_id || ':' || turn, text FROM conversations WHERE role = 'user') SELECT query_id, len(w)::INT AS n_words, array_to_string(w, ' ') AS words FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(question), '[{_SPACE}]+'), lambda x: length(x) > 2) AS w FROM asked)")
def question_words(spark, d):
    said = _read(spark, d, "conversations").where("role = 'user'").selectExpr("conv_id || ':' || turn AS query_id", "text AS question")
    asked = spark.createDataFrame(QUESTIONS, "query_id string, question string").unionByName(said)
    words = tx.question_words(F.col("question"))
    return asked.select("query_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("words"))


@query(f"SELECT doc_id, {_tokens_sql('text')} AS token_count FROM documents")
def token_count(spark, d):
    return _read(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).alias("token_count"))


@query(f"SELECT page_id, {_tokens_sql('html')} AS token_count FROM pages")
def token_count_pages(spark, d):
    return _read(spark, d, "pages").select("page_id", tx.token_count(F.col("html")).alias("token_count"))


@query(f"SELECT count(*) AS file_count, floor(sum(CASE WHEN doc_id < 50 THEN {_tokens_sql('text')} END) / count(CASE WHEN doc_id < 50 THEN 1 END) * count(*) + 0.5)::BIGINT AS total_tokens, count(*) > 50 AS is_sampled FROM documents")
def token_sample_extrapolate(spark, d):
    return benchmark.sampled_tokens(text_corpus(spark, d), 50)


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '\\bêtre\\b'))::INT AS n1, len(regexp_extract_all(lower(text), '\\bcle\\b'))::INT AS n2, len(regexp_extract_all(lower(text), '\\bder\\b'))::INT AS n3, len(regexp_extract_all(lower(text), '\\btion\\b'))::INT AS n4 FROM documents")
def word_frequency_boundary(spark, d):
    low = F.lower("text")
    return _read(spark, d, "documents").select("doc_id", *[tx.whole_word_count(low, w).alias(f"n{k}") for k, w in enumerate(("être", "cle", "der", "tion"), 1)])


@query("SELECT doc_id, round(least(log2(len(regexp_extract_all(lower(text), '\\bthe\\b')) + 1) * 2, 10.0::DOUBLE), 9) AS points FROM documents")
def content_frequency_score(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.round(scoring.frequency_points(tx.whole_word_count(F.lower("text"), "the")), 9).alias("points"))


@query("SELECT page_id, len(list_filter(string_split(lower(url), '/'), lambda c: contains(c, 'page')))::INT AS hits FROM pages")
def path_component_hits(spark, d):
    return _read(spark, d, "pages").select("page_id", scoring.component_hits(F.col("url"), "page").alias("hits"))


@query(f"WITH {CODE_SQL} SELECT scan_index, {_STEM} AS stem, CASE WHEN {_STEM} = 's_1' THEN 10.0::DOUBLE WHEN contains({_STEM}, 's_1') THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS points FROM code")
def filename_match(spark, d):
    name = F.lower(stem(F.col("path")))
    return code_corpus(spark, d).select("scan_index", name.alias("stem"), scoring.exact_or_partial(name, "s_1").alias("points"))


@query(f"WITH {CODE_SQL}, {_META_SQL} SELECT scan_index, array_to_string(list_filter(exports, lambda e: contains(lower(e), 'pick1')), ',') AS found, len(list_filter(exports, lambda e: contains(lower(e), 'pick1')))::INT * 4 AS points FROM meta")
def export_match(spark, d):
    found = scoring.matching_exports(F.col("exports"), "pick1")
    return structure.file_metadata(code_corpus(spark, d)).select("scan_index", F.array_join(found, ",").alias("found"), (F.size(found) * scoring.EXPORT).alias("points"))


@query(f"WITH {CODE_SQL}, {_META_SQL} SELECT scan_index, round(symbol_count / (lines_of_code / 100.0::DOUBLE), 9) AS density, round(CASE WHEN symbol_count / (lines_of_code / 100.0::DOUBLE) > 1 THEN least(2 * symbol_count / (lines_of_code / 100.0::DOUBLE), 5.0::DOUBLE) ELSE 0 END, 9) AS points FROM meta")
def symbol_density(spark, d):
    of = scoring.density(F.col("symbol_count"), F.col("lines_of_code"))
    return structure.file_metadata(code_corpus(spark, d)).select("scan_index", F.round(of, 9).alias("density"), F.round(scoring.density_points(of), 9).alias("points"))


@query("SELECT doc_id, n::INT AS lines, CASE WHEN n > 50 AND n < 500 THEN 1.0::DOUBLE WHEN n >= 500 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS points FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def size_factor(spark, d):
    lines = F.regexp_count("text", F.lit("\n")) + 1
    return _read(spark, d, "documents").select("doc_id", lines.alias("lines"), scoring.size_points(lines).alias("points"))


def _enhanced(spark: SparkSession, d: str) -> DataFrame:
    read = structure.file_metadata(code_corpus(spark, d))
    s = scoring.enhanced_score(F.col("path"), F.col("content"), CODE_QUESTION, F.col("exports"), F.col("symbol_count"), F.col("lines_of_code"))
    return read.select("scan_index", "path", s.alias("_s")).select("scan_index", "path", "_s.*")


@query(f"WITH {CODE_SQL}, {_META_SQL}, {_SCORED_SQL} SELECT scan_index, round(score, 9) AS score FROM scored")
def enhanced_score(spark, d):
    return _enhanced(spark, d).select("scan_index", F.round("score", 9).alias("score"))


def _reasons_sql() -> str:
    each = [f"CASE WHEN {_STEM} = '{w}' THEN 'Exact filename match: \"{w}\"' WHEN contains({_STEM}, '{w}') THEN 'Filename contains: \"{w}\"' END" for w in _WORDS]
    for w in _WORDS:
        n = f"len(list_filter(string_split(lower(path), '/'), lambda c: contains(c, '{w}')))"
        each.append(f"CASE WHEN {n} > 0 THEN 'Path contains: \"{w}\" (' || {n} || ' times)' END")
    for w in _WORDS:
        n = f"len(regexp_extract_all(lower(content), '\\b{w}\\b'))"
        each.append(f"CASE WHEN {n} > 5 THEN 'High frequency of \"{w}\": ' || {n} || ' occurrences' WHEN {n} > 0 THEN 'Contains \"{w}\": ' || {n} || ' times' END")
    for w in _WORDS:
        x = f"list_filter(exports, lambda e: contains(lower(e), '{w}'))"
        each.append(f"CASE WHEN len({x}) > 0 THEN 'Exports symbols matching \"{w}\": ' || array_to_string({x}, ', ') END")
    tenths = "floor((symbol_count * 2000 + lines_of_code) / (lines_of_code * 2))"  # one symbol in a file: no ties to worry about but these
    each.append(f"CASE WHEN symbol_count * 100 > lines_of_code THEN 'High symbol density: ' || (({tenths})::BIGINT // 10) || '.' || (({tenths})::BIGINT % 10) || ' symbols per 100 LOC' END")
    each.append("CASE WHEN lines_of_code > 50 AND lines_of_code < 500 THEN 'Optimal file size' WHEN lines_of_code >= 500 THEN 'Large file - may need refinement' END")
    return f"array_to_string(list_filter([{', '.join(each)}], lambda r: r IS NOT NULL), '; ')"


@query(f"WITH {CODE_SQL}, {_META_SQL} SELECT scan_index, {_reasons_sql()} AS reasons FROM meta")
def enhanced_reasons(spark, d):
    return _enhanced(spark, d).select("scan_index", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {CODE_SQL}, {_META_SQL}, {_DEPS_SQL} SELECT j AS scan_index, path AS rel_path, 0 AS ord, dep FROM deps JOIN meta ON scan_index = j")
def import_edges(spark, d):
    return imports.edges(code_corpus(spark, d))


@query(f"WITH {CODE_SQL}, {_META_SQL}, {_DEPS_SQL}, {_PAIRS_SQL} SELECT i, j FROM pairs")
def import_join(spark, d):
    return imports.importers(code_corpus(spark, d))


@query(f"WITH {_BOOST_SQL} SELECT scan_index, round(base + boost, 9) AS score, round(boost, 9) AS boost FROM boosted")
def dependency_boost_parallel(spark, d):
    corpus = code_corpus(spark, d)
    boosted = imports.boost_at_once(_enhanced(spark, d), imports.named(corpus), imports.holders(corpus))
    return boosted.select("scan_index", F.round(F.col("score") + F.col("boost"), 9).alias("score"), F.round("boost", 9).alias("boost"))


# importers come later in this scan than what they import, so boosts can't be passed on: both orders agree here
@query(f"WITH {_BOOST_SQL} SELECT scan_index, round(base + boost, 9) AS score, round(boost, 9) AS boost FROM boosted")
def dependency_boost_ordered(spark, d):
    corpus = code_corpus(spark, d)
    boosted = imports.boost_in_order(_enhanced(spark, d), imports.named(corpus), imports.holders(corpus))
    return boosted.select("scan_index", F.round(F.col("score") + F.col("boost"), 9).alias("score"), F.round("boost", 9).alias("boost"))


# the same with the scan turned round, where nations pass on what suppliers give them: layer by layer in SQL
_LAYERS_SQL = f"""{CODE_SQL}, {_META_SQL}, {_SCORED_SQL}, {_DEPS_SQL}, {_PAIRS_SQL},
    l1 AS (SELECT s.scan_index, s.score + coalesce(b, 0.0::DOUBLE) AS now FROM scored s LEFT JOIN (SELECT i, sum(0.1::DOUBLE * score) AS b FROM pairs JOIN scored ON scan_index = j GROUP BY i) ON i = s.scan_index WHERE s.scan_index BETWEEN 100 AND 999),
    l0 AS (SELECT s.scan_index, s.score + coalesce(b, 0.0::DOUBLE) AS now FROM scored s LEFT JOIN (SELECT i, sum(0.1::DOUBLE * now) AS b FROM pairs JOIN l1 ON l1.scan_index = j GROUP BY i) ON i = s.scan_index WHERE s.scan_index < 100)"""


@query(f"WITH {_LAYERS_SQL} SELECT scan_index, round(now, 9) AS score FROM l0 UNION ALL SELECT scan_index, round(now, 9) FROM l1 UNION ALL SELECT scan_index, round(score, 9) FROM scored WHERE scan_index >= 1000")
def dependency_boost_chain(spark, d):
    turned = -F.col("scan_index")
    corpus = code_corpus(spark, d).withColumn("scan_index", turned)
    boosted = imports.boost_in_order(_enhanced(spark, d).withColumn("scan_index", turned), imports.named(corpus), imports.holders(corpus))
    return boosted.select(turned.alias("scan_index"), F.round(F.col("score") + F.col("boost"), 9).alias("score"))


@query(f"WITH {_BOOST_SQL} SELECT scan_index, path, round(base + boost, 9) AS score FROM boosted ORDER BY round(base + boost, 9) DESC, path LIMIT {LIMIT}")
def rank_enhanced_topk(spark, d):
    corpus = code_corpus(spark, d)
    boosted = imports.with_boost(imports.boost_at_once(_enhanced(spark, d), imports.named(corpus), imports.holders(corpus)))
    return scoring.top(boosted.select("scan_index", "path", F.round("score", 9).alias("score")), LIMIT)


# a list of paths, some of which a scan passes over
_ENDS = ["a.ts", "b.tsx", "c.d.ts", "d.js", "E.TS", "_f.ts", ".g.ts", "h.mts"]
_TOPS = ["app", "app/node_modules", "app/dist/x", "lib/.git", "out", "src/_hidden", "src/.dot"]


def _paths(spark: SparkSession, d: str) -> DataFrame:
    array = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    return _read(spark, d, "documents").selectExpr("doc_id", f"element_at({array(_TOPS)}, CAST(doc_id % 7 + 1 AS INT)) || '/' || element_at({array(_ENDS)}, CAST(doc_id % 8 + 1 AS INT)) AS path")


_PATHS_SQL = f"paths AS (SELECT doc_id, {_TOPS}[(doc_id % 7 + 1)::INT] || '/' || {_ENDS}[(doc_id % 8 + 1)::INT] AS path FROM documents)"


@query(f"WITH {_PATHS_SQL} SELECT doc_id, path FROM paths WHERE path LIKE '%.ts' OR path LIKE '%.tsx'")
def scan_filter_suffix(spark, d):
    return _paths(spark, d).where(is_source(F.col("path"), SUFFIXES))


@query(f"WITH {_PATHS_SQL} SELECT doc_id, path FROM paths WHERE len(list_filter(string_split(path, '/')[:-2], lambda c: list_contains({list(IGNORED)}, c))) = 0")
def scan_prune_dirs(spark, d):
    return _paths(spark, d).where(~is_below(F.col("path"), IGNORED))


# the derived modules as files of a real tree, with copies in folders and under names that a scan passes over
_COPIES = [("'lib/.hidden/' || path", True), ("'app/node_modules/' || path", False), ("'dist/' || path", False), ("path || '.js'", False), ("'a.b/' || path", True), ("'a/' || path", True), ("'_x.tsx/' || path || 'x'", True)]


def tree_of(spark: SparkSession, d: str) -> DataFrame:
    """The corpus that a scan finds in a tree of files, which tasks write into the shared folder first."""
    root, code = code_tree.local_folder(spark, "tree"), code_corpus(spark, d).select("path", "content")
    code_tree.write_tree(code.unionByName(code.select(F.explode(F.array(*[F.expr(p) for p, _ in _COPIES])).alias("path"), "content")), root)
    return code_tree.scan(spark, root)


_TREE_SQL = f"{CODE_SQL}, tree AS (SELECT path, content FROM code " + "".join(f"UNION ALL SELECT {p}, content FROM code " for p, kept in _COPIES if kept) + "), numbered AS (SELECT row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS scan_index, path, content FROM tree)"


@query(f"WITH {_TREE_SQL} SELECT scan_index, path AS rel_path, md5(content) AS md5 FROM numbered")
def scan_tree(spark, d):
    return tree_of(spark, d).select("scan_index", "rel_path", F.md5("content").alias("md5"))


@query(f"WITH {_TREE_SQL} SELECT count(*) AS file_count, floor(sum(CASE WHEN scan_index < 50 THEN {_tokens_sql('content')} END) / count(CASE WHEN scan_index < 50 THEN 1 END) * count(*) + 0.5)::BIGINT AS total_tokens, count(*) > 50 AS is_sampled FROM numbered")
def scan_tree_sample(spark, d):
    return benchmark.sampled_tokens(tree_of(spark, d), 50)


_SCOPE = Scope(modules=tuple(Module(k, f"corpus/{k}") for k in ("fr", "de", "en", "es")))


@query(f"WITH {TEXT_SQL} SELECT CASE WHEN path LIKE 'corpus/fr/%' THEN 'fr' ELSE 'es' END AS module, scan_index, path FROM texts WHERE path LIKE 'corpus/fr/%' OR path LIKE 'corpus/es/%'")
def scan_modules(spark, d):
    return scoped(text_corpus(spark, d), _SCOPE, ["es", "fr"]).select("module", "scan_index", "path")


_KEYS = ["es", "xx", "fr"]


# the registry's modules of these keys, and what of the documents lies in them
@query("SELECT key, relative_path, (SELECT count(*) FROM documents WHERE lang = key) AS files FROM (VALUES ('fr', 'corpus/fr'), ('de', 'corpus/de'), ('en', 'corpus/en'), ('es', 'corpus/es')) m(key, relative_path) WHERE key IN ('es', 'xx', 'fr')")
def module_semi_join(spark, d):
    chosen = spark.createDataFrame([(m.key, m.relative_path) for m in _SCOPE.chosen(_KEYS)], "key string, relative_path string")
    files = scoped(text_corpus(spark, d), _SCOPE, _KEYS).groupBy(F.col("module").alias("key")).agg(F.count(F.lit(1)).alias("files"))
    return chosen.join(files, "key", "left").select("key", "relative_path", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


@query("SELECT lang AS module, count(*) AS files FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY lang")
def union_modules(spark, d):
    return scoped(text_corpus(spark, d), _SCOPE).groupBy("module").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {CODE_SQL}, {_META_SQL} SELECT scan_index, array_to_string(imports, ',') AS imports, array_to_string(exports, ',') AS exports, symbol_count, lines_of_code::INT AS lines_of_code FROM meta")
def file_metadata(spark, d):
    return structure.file_metadata(code_corpus(spark, d)).select("scan_index", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), "symbol_count", "lines_of_code")


@query(f"WITH {CODE_SQL} SELECT scan_index, {_skeleton_sql(False)} AS skeleton FROM {_JOINED}")
def skeleton(spark, d):
    return structure.skeletons(code_corpus(spark, d)).select("scan_index", "skeleton")


@query(f"WITH {CODE_SQL} SELECT scan_index, {_skeleton_sql(True)} AS skeleton FROM {_JOINED}")
def skeleton_mapping(spark, d):
    return structure.skeletons(code_corpus(spark, d), mapped=True).select("scan_index", "skeleton")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return structure.symbols(structure.parsed(code_corpus(spark, d)))


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT * FROM symbols")
def symbol_table(spark, d):
    return _symbols(spark, d).select(*_SYMBOL_COLUMNS)


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT * FROM symbols WHERE symbol_id = 'pick7' ORDER BY file_order, symbol_order LIMIT 1")
def symbol_lookup(spark, d):
    return structure.symbol_details(_symbols(spark, d), code_corpus(spark, d), "pick7").select(*_SYMBOL_COLUMNS)


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT symbol_id, file_path, array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)) AS content FROM symbols JOIN code ON scan_index = file_order")
def symbol_source_slice(spark, d):
    files = code_corpus(spark, d).select(F.col("scan_index").alias("_scan"), "content")
    found = _symbols(spark, d)
    return found.join(files, found.file_order == files._scan).select("symbol_id", "file_path", structure.source_lines(F.col("content"), F.col("start_line"), F.col("end_line")).alias("content"))


_FOUND_SQL = "(contains(lower(symbol_name), 'nation') OR contains(lower(file_path), 'nation') OR coalesce(contains(lower(signature), 'nation'), false))"


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT symbol_id, file_order, symbol_order, count(*) OVER () AS matches FROM symbols WHERE {_FOUND_SQL} ORDER BY file_order, symbol_order LIMIT 20")
def symbol_search(spark, d):
    found = structure.search(_symbols(spark, d), "Nation").withColumn("matches", F.count(F.lit(1)).over(Window.partitionBy()))
    return found.orderBy("file_order", "symbol_order").limit(structure.SHOWN).select("symbol_id", "file_order", "symbol_order", "matches")


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT symbol_id FROM symbols WHERE symbol_type = 'arrow-function' AND contains(lower(signature), 'pick1')")
def symbol_search_type(spark, d):
    return structure.search(_symbols(spark, d), "pick1", "arrow-function").select("symbol_id")


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT symbol_type, count(*) AS n FROM symbols GROUP BY symbol_type")
def symbol_stats(spark, d):
    return structure.stats(_symbols(spark, d))


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT count(DISTINCT file_path) AS files, count(*) AS symbols FROM symbols")
def symbol_totals(spark, d):
    return structure.totals(_symbols(spark, d))


@query(f"WITH {CODE_SQL}, {_META_SQL}, {_SYMBOLS_SQL} SELECT path, array_to_string(imports, ',') AS imports, (SELECT string_agg(symbol_id, ',' ORDER BY symbol_order) FROM symbols WHERE file_order = scan_index) AS symbols FROM meta")
def file_dependencies(spark, d):
    named = _symbols(spark, d).groupBy("file_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_order", "symbol_id"))), lambda s: s["symbol_id"]), ",").alias("symbols"))
    files = code_corpus(spark, d).select("scan_index", "path", F.array_join(imports.specifiers(F.col("content")), ",").alias("imports"))
    return files.join(named, files.scan_index == named.file_order, "left").select("path", "imports", "symbols")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def content_md5(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


@query("SELECT doc_id, md5(source || '|' || lang || '|' || 'a,b' || '|' || 'true' || '|' || doc_id) AS cache_key FROM documents")
def cache_key(spark, d):
    return _read(spark, d, "documents").select("doc_id", cache.cache_key_of(F.col("source"), F.col("lang"), F.lit("a,b"), F.lit(True), F.col("doc_id")).alias("cache_key"))


@query(f"WITH {TEXT_SQL}, a AS (SELECT path, md5(content) AS m1 FROM texts WHERE content IS NOT NULL), b AS (SELECT path, md5(CASE WHEN path LIKE '%/src3/%' THEN content || 'x' ELSE content END) AS m2 FROM texts WHERE content IS NOT NULL AND path NOT LIKE '%/es/src5/%') SELECT path, m1 AS stored, m2 AS current FROM a FULL JOIN b USING (path) WHERE m1 IS DISTINCT FROM m2")
def cache_validity(spark, d):
    corpus = text_corpus(spark, d)
    changed = F.when(F.col("path").like("%/src3/%"), F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    later = corpus.where(~F.col("path").like("%/es/src5/%")).withColumn("content", changed)
    return cache.differences(cache.hashes(corpus), cache.hashes(later))


_REDUCED_SQL = f"{CODE_SQL}, r AS (SELECT scan_index, {_tokens_sql('content')} AS original_tokens, {_tokens_sql('skeleton')} AS skeleton_tokens FROM (SELECT scan_index, content, {_skeleton_sql(False)} AS skeleton FROM {_JOINED}))"


@query(f"WITH {_REDUCED_SQL} SELECT *, round(CASE WHEN original_tokens > 0 THEN (original_tokens - skeleton_tokens) / original_tokens * 100 ELSE 0 END, 9) AS reduction FROM r")
def token_reduction(spark, d):
    found = structure.skeletons(code_corpus(spark, d)).select("scan_index", tx.token_count(F.col("content")).alias("original_tokens"), tx.token_count(F.col("skeleton")).alias("skeleton_tokens"))
    return found.withColumn("reduction", F.round(tx.reduction_percent(F.col("original_tokens"), F.col("skeleton_tokens")), 9))


@query(f"WITH {_REDUCED_SQL} SELECT kind, count(*) AS files, sum(original_tokens)::BIGINT AS original_tokens, sum(skeleton_tokens)::BIGINT AS skeleton_tokens, round((sum(original_tokens) - sum(skeleton_tokens)) / sum(original_tokens) * 100, 6) AS pooled_reduction, round(avg((original_tokens - skeleton_tokens) / original_tokens * 100), 6) AS mean_reduction FROM (SELECT *, CASE WHEN scan_index < 100 THEN 'region' WHEN scan_index < 1000 THEN 'nation' ELSE 'supplier' END AS kind FROM r) GROUP BY kind")
def benchmark_summary(spark, d):
    kind = F.when(F.col("scan_index") < 100, "region").when(F.col("scan_index") < 1000, "nation").otherwise("supplier")
    rows = token_reduction(spark, d).withColumn("kind", kind)
    sums = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("original_tokens").alias("original_tokens"), F.sum("skeleton_tokens").alias("skeleton_tokens"), F.round(F.avg(tx.reduction_percent(F.col("original_tokens"), F.col("skeleton_tokens"))), 6).alias("mean_reduction"))
    return sums.withColumn("pooled_reduction", F.round(tx.reduction_percent(F.col("original_tokens"), F.col("skeleton_tokens")), 6))


@query(f"WITH {_REDUCED_SQL}, b AS (SELECT scan_index, path, base + boost AS score FROM boosted) SELECT path, round(score, 9) AS score, original_tokens AS original_token_count, skeleton_tokens AS skeleton_token_count FROM b JOIN r USING (scan_index) ORDER BY round(score, 9) DESC, path LIMIT {LIMIT}".replace("WITH " + CODE_SQL, f"WITH {_BOOST_SQL}"))
def analyze_enhanced(spark, d):
    options = analysis.Options("", CODE_QUESTION, LIMIT, enhanced_ranking=True, boost_in_order=False)
    found = analysis.analyze_corpus(code_corpus(spark, d), "", options)
    return found.select("path", F.round("score", 9).alias("score"), "original_token_count", "skeleton_token_count")


_ANALYZED_SQL = SQL["analyze_enhanced"]


# the second of two runs, which the cache answers
@query(f"SELECT *, 1 AS hits, 1 AS misses FROM ({_ANALYZED_SQL})")
def analyze_cached(spark, d):
    options = analysis.Options("", CODE_QUESTION, LIMIT, enhanced_ranking=True, boost_in_order=False)
    held = cache.ResultCache(spark, code_tree.local_folder(spark, "cache"))
    for _ in range(2):
        found = analysis.analyze_corpus(code_corpus(spark, d), "", options, held)
    return found.select("path", F.round("score", 9).alias("score"), "original_token_count", "skeleton_token_count").withColumns({"hits": F.lit(held.hits), "misses": F.lit(held.misses)})


@query(f"WITH {CODE_SQL} SELECT step, n AS files, hit FROM (SELECT count(*) AS n FROM code), (VALUES ('before', false), ('fresh', true), ('from disk', true), ('after a change', false), ('expired', false)) v(step, hit)")
def cache_steps(spark, d):
    """A result kept for the corpus: found while it is fresh, promoted from disk, and gone with a changed file or after its life."""
    corpus, key, now = code_corpus(spark, d), "0" * 32, datetime(2026, 1, 1, tzinfo=UTC)
    changed = corpus.withColumn("content", F.when(F.col("scan_index") == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    held = cache.ResultCache(spark, code_tree.local_folder(spark, "cache"))
    files = corpus.agg(F.count(F.lit(1)).alias("files"))
    steps = [("before", held.get(key, corpus, now))]
    held.set(key, files, corpus, now)
    steps.append(("fresh", held.get(key, corpus, now)))
    held.clear_memory()
    steps.append(("from disk", held.get(key, corpus, now)))
    steps.append(("after a change", held.get(key, changed, now)))
    steps.append(("expired", held.get(key, corpus, now + cache.LIFE + timedelta(seconds=1))))
    told = spark.createDataFrame([(name, found is not None) for name, found in steps], "step string, hit boolean")
    return told.join(F.broadcast(steps[2][1]), how="left").select("step", "files", "hit")  # one row of the cache


@query(f"WITH {CODE_SQL}, {_SYMBOLS_SQL} SELECT symbol_id, symbol_name, symbol_type, file_path, start_line, end_line, parent_class, signature, symbol_order FROM symbols")
def mapping_round_trip(spark, d):
    file = code_tree.local_folder(spark, "mapping") + ".json"
    artefacts.save_mapping(_symbols(spark, d), file, "/app")
    return artefacts.load_mapping(spark, file).select("symbol_id", "symbol_name", "symbol_type", "file_path", "start_line", "end_line", "parent_class", "signature", "symbol_order")


# nations without content: they are ranked, then left out, so fewer files than the limit come back
@query(f"WITH {_REDUCED_SQL}, s AS (SELECT scan_index, path, {_sql_basic(CODE_QUESTION)} AS score FROM (SELECT scan_index, path, CASE WHEN scan_index >= 100 THEN '' ELSE content END AS content FROM code WHERE scan_index < 1000)), top AS (SELECT * FROM s ORDER BY score DESC, path LIMIT {LIMIT}) SELECT path, round(score, 9) AS score, original_tokens AS original_token_count, skeleton_tokens AS skeleton_token_count FROM top JOIN r USING (scan_index) WHERE scan_index < 100")
def analyze_with_empty_files(spark, d):
    corpus = code_corpus(spark, d).where("scan_index < 1000").withColumn("content", F.when(F.col("scan_index") >= 100, "").otherwise(F.col("content")))
    found = analysis.analyze_corpus(corpus, "", analysis.Options("", CODE_QUESTION, LIMIT))
    return found.select("path", F.round("score", 9).alias("score"), "original_token_count", "skeleton_token_count")


_KEEPER = _code("/** Keeps. */|export class Keeper", "=s_suppkey", " {|  readonly size: number;|  constructor(private readonly first: number, second: string = 'b') {|    this.size = first + second.length;|  }|  grow(by: number): number {|    return this.size + by;|  }|}|")
_KEEPERS_SQL = f"keepers AS (SELECT s_suppkey::BIGINT AS scan_index, 'app/keeper/k_' || s_suppkey || '.ts' AS path, {_KEEPER} AS content FROM supplier)"


def keeper_corpus(spark: SparkSession, d: str) -> DataFrame:
    return from_table(_read(spark, d, "supplier"), F.expr("'app/keeper/k_' || s_suppkey || '.ts'"), F.expr(_KEEPER), F.col("s_suppkey"))


@query(f"WITH {_KEEPERS_SQL} SELECT scan_index, " + _code("/* Skeleton of k_", "=scan_index", ".ts */||/** Keeps. */|export class Keeper", "=scan_index", " {|  readonly size: number;||  grow(by: number): number {|    /* trimmed */|  }||  constructor(private readonly first: number, second?: string) {|    /* trimmed */|  }||}") + " AS skeleton FROM keepers")
def skeleton_constructor(spark, d):
    return structure.skeletons(keeper_corpus(spark, d)).select("scan_index", "skeleton")


@query(f"WITH {_KEEPERS_SQL} SELECT path, 'Keeper' || scan_index || '.' || kind AS symbol_id, kind AS symbol_name, symbol_type, a AS start_line, b AS end_line FROM keepers, (VALUES ('constructor', 'constructor', 4, 6), ('grow', 'method', 7, 9)) v(kind, symbol_type, a, b)")
def symbol_constructors(spark, d):
    return structure.symbols(structure.parsed(keeper_corpus(spark, d))).select(F.col("file_path").alias("path"), "symbol_id", "symbol_name", "symbol_type", "start_line", "end_line")
