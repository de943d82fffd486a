"""Relevance of a file for a question: the basic and the enhanced score, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.paths import components, stem

# The points of each stage.
BASIC_NAME, BASIC_PATH, BASIC_HIT, BASIC_HITS, BASIC_WORD = 5, 3, 0.1, 2, 10
EXACT, PARTIAL, COMPONENT, FREQUENCY, FREQUENCY_CAP, EXPORT, DENSITY, DENSITY_CAP = 10, 5, 3, 2, 10, 4, 2, 5
SMALL, LARGE = 50, 500
NO_WORDS = 0.5
#: Questions that one pass over a corpus scores; more are taken in several passes.
QUESTIONS_A_PASS = 32


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))


def _blank(content: Column) -> Column:
    return content.isNull() | (content == "")


def basic_score(path: Column, content: Column, question: str) -> Column:
    """Between 0 and 1: words in the file's name, in its path, and how often in its content."""
    words = tx.words_of(question)
    name, low_path, low = F.lower(stem(path)), F.lower(path), F.lower(content)
    total = F.lit(0.0)
    for w in words:
        within = F.lit(False) if "/" in w else F.contains(low_path, F.lit(w))
        total = total + _points(F.contains(name, F.lit(w)), BASIC_NAME) + _points(within, BASIC_PATH)
        total = total + F.least(tx.match_count(low, w) * F.lit(BASIC_HIT), F.lit(float(BASIC_HITS)))
    known = F.least(total / float(BASIC_WORD * len(words)), F.lit(1.0)) if words else F.lit(NO_WORDS)
    return F.when(_blank(content), F.lit(0.0)).otherwise(known)


def exact_or_partial(name: Column, word: str) -> Column:
    return F.when(name == word, F.lit(float(EXACT))).when(F.contains(name, F.lit(word)), F.lit(float(PARTIAL))).otherwise(F.lit(0.0))


def component_hits(path: Column, word: str) -> Column:
    """How many parts of the path hold the word."""
    return F.size(F.filter(components(F.lower(path)), lambda c: F.contains(c, F.lit(word))))


def frequency_points(count: Column) -> Column:
    return F.least(F.log2(count + 1) * FREQUENCY, F.lit(float(FREQUENCY_CAP)))


def matching_exports(exports: Column, word: str) -> Column:
    return F.filter(exports, lambda x: F.contains(F.lower(x), F.lit(word)))


def density(symbol_count: Column, lines: Column) -> Column:
    """Symbols in a hundred lines; null where there are none of either."""
    return F.when((symbol_count != 0) & (lines != 0), symbol_count / (lines / F.lit(100.0)))


def density_points(d: Column) -> Column:
    return F.when(d > 1, F.least(d * DENSITY, F.lit(float(DENSITY_CAP)))).otherwise(F.lit(0.0))


def size_points(lines: Column) -> Column:
    return F.when((lines > SMALL) & (lines < LARGE), F.lit(1.0)).when(lines >= LARGE, F.lit(-1.0)).otherwise(F.lit(0.0))


def enhanced_score(path: Column, content: Column, question: str, exports: Column, symbol_count: Column, lines: Column) -> Column:
    """Struct of score and reasons. Without metadata (null columns) the last three stages give nothing.

    A large file that matches nothing scores below 0, as nothing holds the score up.
    """
    words = tx.words_of(question)
    name, low = F.lower(stem(path)), F.lower(content)
    total, reasons = F.lit(0.0), []
    for w in words:
        points = exact_or_partial(name, w)
        total = total + points
        reasons.append(F.when(points == EXACT, F.lit(f'Exact filename match: "{w}"')).when(points > 0, F.lit(f'Filename contains: "{w}"')))
    for w in words:
        n = component_hits(path, w)
        total = total + n * float(COMPONENT)
        reasons.append(F.when(n > 0, F.concat(F.lit(f'Path contains: "{w}" ('), n.cast("string"), F.lit(" times)"))))
    for w in words:
        n = tx.whole_word_count(low, w)
        total = total + frequency_points(n)
        often, some = F.concat(F.lit(f'High frequency of "{w}": '), n.cast("string"), F.lit(" occurrences")), F.concat(F.lit(f'Contains "{w}": '), n.cast("string"), F.lit(" times"))
        reasons.append(F.when(n > 5, often).when(n > 0, some))
    for w in words:
        found = matching_exports(F.coalesce(exports, F.expr("cast(array() as array<string>)")), w)
        total = total + F.size(found) * float(EXPORT)
        reasons.append(F.when(F.size(found) > 0, F.concat(F.lit(f'Exports symbols matching "{w}": '), F.array_join(found, ", "))))
    d = density(symbol_count, lines)
    total = total + F.coalesce(density_points(d), F.lit(0.0)) + F.coalesce(size_points(lines), F.lit(0.0))
    reasons.append(F.when(d > 1, F.concat(F.lit("High symbol density: "), tx.one_decimal(d), F.lit(" symbols per 100 LOC"))))
    reasons.append(F.when((lines > SMALL) & (lines < LARGE), F.lit("Optimal file size")).when(lines >= LARGE, F.lit("Large file - may need refinement")))
    none = F.expr("cast(array() as array<string>)")
    blank = F.struct(F.lit(0.0).alias("score"), none.alias("reasons"))
    if not words:
        return F.when(_blank(content), blank).otherwise(F.struct(F.lit(NO_WORDS).alias("score"), F.array(F.lit("No meaningful keywords")).alias("reasons")))
    most = float((EXACT + COMPONENT + FREQUENCY_CAP) * len(words))
    return F.when(_blank(content), blank).otherwise(F.struct(F.least(total / most, F.lit(1.0)).alias("score"), F.array_compact(F.array(*reasons)).alias("reasons")))


def basic_scores(corpus: DataFrame, questions: list[tuple[str, str]]) -> DataFrame:
    """(query_id, scan_index, path, score) for every file and question, a scan for every ``QUESTIONS_A_PASS`` questions."""
    out = None
    for k in range(0, len(questions), QUESTIONS_A_PASS):
        each = F.array(*[F.struct(F.lit(q).alias("query_id"), basic_score(F.col("path"), F.col("content"), text).alias("score")) for q, text in questions[k : k + QUESTIONS_A_PASS]])
        part = corpus.select("scan_index", "path", F.explode(each).alias("_")).select("_.query_id", "scan_index", "path", "_.score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else corpus.select(F.lit("").alias("query_id"), "scan_index", "path", F.lit(0.0).alias("score")).limit(0)


def by_rank(scored: DataFrame) -> list[Column]:
    """Best score first, then path as a reader sorts it, then scan order."""
    return [F.desc("score"), F.collate("path", "UNICODE"), F.col("scan_index")]


def top(scored: DataFrame, limit: int) -> DataFrame:
    if limit < 0:
        raise ValueError("limit below 0")
    return scored.orderBy(*by_rank(scored)).limit(limit)


def top_each(scored: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` files of each query_id, with their rank; tasks hand on ``limit`` rows a query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_rank(scored)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def rank_basic(corpus: DataFrame, question: str, limit: int = 10) -> DataFrame:
    return top(corpus.withColumn("score", basic_score(F.col("path"), F.col("content"), question)), limit)
