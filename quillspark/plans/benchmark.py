"""How many tokens skeletons save: baselines by a prefix of the scan, scenarios, and their averages."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import reduction_percent, rounded, token_count
from quillspark.plans.analysis import Options, analyze, corpus_of
from quillspark.sources import artefacts, code_tree
from quillspark.sources.scope import Scope


@dataclass(frozen=True)
class Scenario:
    module_key: str
    query: str
    limit: int = 10


# The scenarios, and how many files of the scan stand for all.
SCENARIOS = (
    Scenario("lib-server-functions", "send message to room"),
    Scenario("authorization", "user permissions and access control"),
    Scenario("e2e", "end-to-end encryption key management"),
    Scenario("file-upload", "file upload and media handling"),
)
SAMPLE_FILES, BASELINE_FILES, SHOWN = 50, 200, 5


def sampled_tokens(corpus: DataFrame, max_files: int = SAMPLE_FILES) -> DataFrame:
    """One row: file_count, total_tokens and is_sampled. Tokens of the first files of the scan, carried on to all.

    Files that can't be read count as files.
    """
    first = F.col("scan_index") < max_files
    none = F.lit(0).cast("long")
    # content is asked for behind the filter, so only these files are read
    files = corpus.agg(F.count(F.lit(1)).alias("file_count"), F.count_if(first).alias("read")).withColumn("tokens", none)
    tokens = corpus.where(first).agg(F.coalesce(F.sum(token_count(F.col("content"))), none).alias("tokens")).select(none.alias("file_count"), none.alias("read"), "tokens")
    counted = files.unionByName(tokens).agg(*[F.sum(c).alias(c) for c in ("file_count", "read", "tokens")])
    sampled = F.col("file_count") > F.col("read")
    return counted.select("file_count", F.when(sampled, rounded(F.col("tokens") / F.col("read") * F.col("file_count"))).otherwise(F.col("tokens")).cast("long").alias("total_tokens"), sampled.alias("is_sampled"))


def reductions(analyses: DataFrame, all_tokens: int) -> DataFrame:
    """One row: files, original and skeleton tokens, and by how many percent skeletons are below all files and below these."""
    sums = analyses.agg(F.count(F.lit(1)).alias("analyzed_file_count"), F.coalesce(F.sum("original_token_count"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum("skeleton_token_count"), F.lit(0)).alias("skeleton_tokens"))
    return sums.withColumns({"reduction_vs_full_scan": reduction_percent(F.lit(all_tokens), F.col("skeleton_tokens")), "reduction_vs_top": reduction_percent(F.col("original_tokens"), F.col("skeleton_tokens"))})


def run_scenario(spark: SparkSession, root: str, scenario: Scenario, enhanced: bool = True, scope: Scope | None = None) -> dict:
    scope = scope or Scope()
    if scenario.module_key not in {m.key for m in scope.modules}:
        raise ValueError(f"unknown module {scenario.module_key}")
    options = Options(root, scenario.query, scenario.limit, enhanced_ranking=enhanced, module_keys=[scenario.module_key], skip_cache=True)
    corpus, project = corpus_of(spark, options, scope)
    base = sampled_tokens(corpus, BASELINE_FILES).first()
    began = time.time()
    found = analyze(spark, options, scope=scope).persist()
    files = found.collect()
    took = int(1000 * (time.time() - began))
    row = reductions(found, base["total_tokens"]).first()
    top = [{"path": f["path"], "score": f["score"], "originalTokens": f["original_token_count"], "skeletonTokens": f["skeleton_token_count"], "reductionPct": (f["original_token_count"] - f["skeleton_token_count"]) / f["original_token_count"] * 100 if f["original_token_count"] else 0} for f in files]
    return {"projectName": scenario.module_key, "projectRoot": project, "query": scenario.query, "allFilesCount": base["file_count"], "allFilesTotalTokens": base["total_tokens"], "analyzedFileCount": len(files), "analyzedOriginalTokens": row["original_tokens"], "analyzedSkeletonTokens": row["skeleton_tokens"], "tokenReductionVsFullScan": row["reduction_vs_full_scan"], "tokenReductionVsTopN": row["reduction_vs_top"], "enhancedRanking": enhanced, "executionTimeMs": took, "topFiles": top}


def summary(results: list[dict]) -> dict:
    """Averages over scenarios, each counting alike; None without any."""
    mean = lambda k: sum(r[k] for r in results) / len(results) if results else None
    return {"averageReductionVsFullScan": mean("tokenReductionVsFullScan"), "averageReductionVsTopN": mean("tokenReductionVsTopN"), "averageExecutionTimeMs": mean("executionTimeMs")}


def report(results: list[dict]) -> str:
    lines = []
    for r in results:
        lines += [f"{r['projectName']}: {r['query']}", f"  all files: {r['allFilesCount']:,}, {r['allFilesTotalTokens']:,} tokens", f"  analyzed: {r['analyzedFileCount']:,}, {r['analyzedOriginalTokens']:,} -> {r['analyzedSkeletonTokens']:,} tokens", f"  reduction: {r['tokenReductionVsFullScan']:.2f}% of all, {r['tokenReductionVsTopN']:.2f}% of these, {r['executionTimeMs']:,} ms"]
        lines += [f"    {k}. {f['path']} (score {f['score']:.3f}): {f['originalTokens']:,} -> {f['skeletonTokens']:,} ({f['reductionPct']:.1f}%)" for k, f in enumerate(r["topFiles"][:SHOWN], 1)]
    s = summary(results)
    if results:
        lines.append(f"average reduction {s['averageReductionVsFullScan']:.2f}% of all, {s['averageReductionVsTopN']:.2f}% of the best, {s['averageExecutionTimeMs']:.0f} ms")
    return "\n".join(lines)


def run_all(spark: SparkSession, root: str, output: str | None = None, scope: Scope | None = None, scenarios: tuple[Scenario, ...] = SCENARIOS) -> dict:
    scope = scope or Scope()
    whole = sampled_tokens(code_tree.scan(spark, scope.resolve_root(root))).first()
    results = [run_scenario(spark, root, s, scope=scope) for s in scenarios]
    out = {"fullAppBaseline": {"root": root, "fileCount": whole["file_count"], "estimatedTotalTokens": whole["total_tokens"], "isSampled": whole["is_sampled"]}, "benchmarks": results, "summary": summary(results)}
    if output:
        artefacts.save(out, output)
    return out
