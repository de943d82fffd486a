"""A question's way through a corpus: scan, cache, score, best files, skeletons, token counts, artefacts."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.paths import relative
from quillspark.functions.text import token_count
from quillspark.operators import imports, scoring, structure
from quillspark.operators.cache import ResultCache, cache_key
from quillspark.sources import artefacts, code_tree
from quillspark.sources.scope import Scope

MAPPING_FILE = "symbols.mapping.json"
RESULT = "path string, score double, skeleton string, original_token_count bigint, skeleton_token_count bigint"


@dataclass
class Options:
    root: str
    question: str
    limit: int = 10
    generate_mapping: bool = False
    mapping_output_path: str | None = None
    enhanced_ranking: bool = False
    module_keys: list[str] | None = None
    strict_scope: bool = True
    skip_cache: bool = False
    boost_in_order: bool = True


def rank_enhanced(corpus: DataFrame, question: str, limit: int = 10, root: str = "", in_order: bool = True) -> DataFrame:
    """Best files by the enhanced score with the boost along imports; reasons say why."""
    read = structure.file_metadata(corpus)
    scores = scoring.enhanced_score(F.col("path"), F.col("content"), question, F.col("exports"), F.col("symbol_count"), F.col("lines_of_code"))
    scored = read.select("scan_index", "path", F.col("imports").alias("dependencies"), "symbol_count", scores.alias("_s")).select("scan_index", "path", "dependencies", "symbol_count", "_s.*")
    boosted = (imports.boost_in_order if in_order else imports.boost_at_once)(scored, imports.named(corpus, root), imports.holders(corpus, root))
    # boosts are sums in no order, so scores that differ by less than any sum's error tie
    return scoring.top(imports.with_boost(boosted).withColumn("score", F.round("score", 12)), limit)


def analyses(ranked: DataFrame, corpus: DataFrame, root: str = "", mapped: bool = False) -> DataFrame:
    """The ranked files that have content, with skeletons and token counts, best first; items stay for the symbol table.

    ``ranked`` is a few rows, so only these files are parsed.
    """
    if "content" in ranked.columns:
        files = ranked
    else:
        best = ranked.select(F.col("scan_index").alias("_scan"), "score")
        files = corpus.join(F.broadcast(best), corpus.scan_index == best._scan).drop("_scan")  # limit rows
    read = structure.skeletons(files.where("content <> ''"), mapped)
    counts = {"original_token_count": token_count(F.col("content")), "skeleton_token_count": token_count(F.col("skeleton"))}
    return read.withColumns(counts).withColumn("rel_path", relative(F.col("path"), root)).orderBy(*scoring.by_rank(read))


def corpus_of(spark: SparkSession, options: Options, scope: Scope | None = None) -> tuple[DataFrame, str]:
    scope = scope or Scope()
    root = os.path.abspath(options.root)
    if options.strict_scope:
        scope.warn_unless_root(root)
        return code_tree.scan_modules(spark, root, options.module_keys, scope), scope.resolve_root(root)
    return code_tree.scan(spark, root), root


def analyze(spark: SparkSession, options: Options, cache: ResultCache | None = None, scope: Scope | None = None) -> DataFrame:
    """The best files for the question: path, score, skeleton and token counts. May write a mapping, and uses ``cache``."""
    corpus, root = corpus_of(spark, options, scope)
    return analyze_corpus(corpus, root, options, cache)


def analyze_corpus(corpus: DataFrame, root: str, options: Options, cache: ResultCache | None = None) -> DataFrame:
    """``analyze`` of any corpus, whose paths are taken from ``root`` on. An empty one leaves no cache entry and no mapping."""
    use = cache if cache is not None and not options.skip_cache else None
    if (use or options.generate_mapping) and corpus.isEmpty():
        return corpus.sparkSession.createDataFrame([], RESULT)
    key = cache_key(root, options.question, options.module_keys, options.enhanced_ranking, options.limit, options.generate_mapping)
    if use and (found := use.get(key, corpus)) is not None:
        return found
    if options.enhanced_ranking:
        ranked = rank_enhanced(corpus, options.question, options.limit, root, options.boost_in_order).select("scan_index", "score")
    else:
        ranked = scoring.rank_basic(corpus, options.question, options.limit)
    done = analyses(ranked, corpus, root, options.generate_mapping).persist()
    result = done.select(F.col("rel_path").alias("path"), "score", "skeleton", "original_token_count", "skeleton_token_count")
    if use:
        use.set(key, result, corpus)
    if options.generate_mapping:
        artefacts.save_mapping(structure.symbols(done, root), options.mapping_output_path or os.path.join(root, MAPPING_FILE), root)
    return result


def result_json(result: DataFrame, options: Options) -> dict:
    """The result as the JSON object that tools print; it has ``limit`` files at most."""
    files = [{artefacts.camel(k): v for k, v in row.asDict().items()} for row in result.collect()]
    return {"question": options.question, "root": os.path.abspath(options.root), "limit": options.limit, "files": files}
