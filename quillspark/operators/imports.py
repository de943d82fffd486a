"""The import graph: edges by expression, which file imports which, and the boost along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.paths import base_name, folder, normalized, relative
from quillspark.functions.text import SPACE
from quillspark.operators.contained import contained
from quillspark.operators.prefix import ROWS_A_RANGE, joined_hot, ranges
from quillspark.sources.shared import written

# The expression for imports, its braces escaped for Java, and the share of an importer's score.
IMPORT = rf"import[{SPACE}]+(?:\{{[^}}]*\}}|[^;]+)[{SPACE}]+from[{SPACE}]+['\"]([^'\"]+)['\"]"
SHARE = 0.1


def specifiers(content: Column) -> Column:
    """Module specifiers as they stand, in order, repetitions included."""
    return F.regexp_extract_all(content, F.lit(IMPORT), F.lit(1))


def resolved(path: Column, specifier: Column, root: str = "") -> Column:
    """A relative specifier as a path from the root; any other as it is."""
    return F.when(specifier.startswith("."), relative(normalized(F.concat_ws("/", folder(path), specifier)), root)).otherwise(specifier)


def edges(corpus: DataFrame, root: str = "") -> DataFrame:
    """(scan_index, rel_path, ord, dep): a row for each import of each file that isn't empty."""
    found = corpus.where("content <> ''").select("scan_index", "path", F.posexplode(specifiers(F.col("content"))).alias("ord", "specifier"))
    return found.select("scan_index", relative(F.col("path"), root).alias("rel_path"), "ord", resolved(F.col("path"), F.col("specifier"), root).alias("dep"))


def base_of(rel_path: Column) -> Column:
    """The name by which a file is found in imports: its base name without ``.ts``."""
    return F.regexp_replace(base_name(rel_path), r"(?<=.)\.ts$", "")


def named(corpus: DataFrame, root: str = "") -> DataFrame:
    """(scan_index, base): the name by which each file is found in imports."""
    return corpus.select("scan_index", base_of(relative(F.col("path"), root)).alias("base"))


def holders(corpus: DataFrame, root: str = "", **sizes: int) -> DataFrame:
    """(base, j): file j has an import that holds the name, each pair once.

    Distinct imports are searched for all distinct names at once, by automata (``contained``, whose sizes may be
    given). Files of one name are one here: however many they are, an import meets their name once. An import that very
    many files have is broadcast with the few names it holds.
    """
    bases = named(corpus, root).select(F.col("base").alias("pattern")).distinct()
    deps = written(edges(corpus, root).select(F.col("scan_index").alias("j"), "dep").distinct(), "imports")
    pairs = contained(deps.select(F.col("dep").alias("text")), bases, **sizes).select(F.col("text").alias("dep"), F.col("pattern").alias("base"))
    return joined_hot(deps, written(pairs, "names-in-imports"), "dep").select("base", "j").distinct()


def importers(corpus: DataFrame, root: str = "") -> DataFrame:
    """(i, j): file j has an import that holds the name of file i, itself included, each pair once.

    This is the listing of all pairs; the boosts below don't need it.
    """
    return holders(corpus, root).join(named(corpus, root), "base").select(F.col("scan_index").alias("i"), "j")


def _boosted(scored: DataFrame, sums: DataFrame) -> DataFrame:
    """``scored`` with boost from ``sums`` (i, boost)."""
    boost = F.coalesce("boost", F.lit(0.0))
    return scored.join(sums.withColumnRenamed("i", "_i"), scored.scan_index == F.col("_i"), "left").drop("_i").withColumn("boost", F.when(boost > 0, boost).otherwise(F.lit(0.0)))


def boost_at_once(scored: DataFrame, names: DataFrame, held: DataFrame) -> DataFrame:
    """``scored`` (scan_index, score, …) with boost, from all importers' own scores: no order matters.

    ``names`` as by ``named``, ``held`` as by ``holders``. A boost is of a name: it is summed once for each.
    """
    of = scored.select(F.col("scan_index").alias("j"), F.col("score").alias("score_j"))
    sums = held.join(of, "j").groupBy("base").agg(F.sum(F.col("score_j") * SHARE).alias("boost"))
    return _boosted(scored, joined_hot(names, written(sums, "boosts"), "base").select(F.col("scan_index").alias("i"), "boost"))


def boost_in_order(scored: DataFrame, names: DataFrame, held: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``scored`` with boost, where files earlier in the scan pass on what they were given.

    Each file's boost takes earlier importers' boosted scores and later ones' own: along the scan, a name's importers
    and its files make running sums. They are dealt out by ranges of name and scan (``prefix``), so no task holds a
    name that very many files have or import. The system is strictly lower triangular, and repeating the step settles
    it exactly after as many rounds as the longest chain of imports that follows the scan; each round is cut off by a
    table in the shared folder.
    """
    base = written(scored.select("scan_index", "score"), "scores")
    links = written(held, "holders")
    of = base.select(F.col("scan_index").alias("j"), "score")
    totals = written(links.join(of, "j").groupBy("base").agg(F.sum("score").alias("total")), "totals")
    # a file comes before itself as an importer: its own import counts with its own score
    importers_ = links.select("base", F.col("j").alias("at"), F.lit(True).alias("importer"), F.lit(None).cast("double").alias("total"))
    files = joined_hot(names, totals, "base").select("base", F.col("scan_index").alias("at"), F.lit(False).alias("importer"), "total")
    dealt = ranges(importers_.unionByName(files), "base", "at", "importer", rows_a_range=rows_a_range)
    now = base.select("scan_index", F.col("score").alias("now"))
    while True:
        gains = base.join(now, "scan_index").select(F.col("scan_index").alias("at"), (F.col("now") - F.col("score")).alias("gain"))
        given = dealt.rows.join(gains, "at").withColumn("gain", F.when(F.col("importer"), F.col("gain")))
        sums = dealt.running(given, gained=F.col("gain")).where(~F.col("importer")).select(F.col("at").alias("i"), ((F.col("total") + F.col("gained")) * SHARE).alias("boost"))
        next_ = written(_boosted(base, sums).select("scan_index", (F.col("score") + F.col("boost")).alias("now"), "boost"), "boosts")
        old = now.select("scan_index", F.col("now").alias("old"))
        moved = next_.join(old, "scan_index").where(F.abs(F.col("now") - F.col("old")) > 1e-12).limit(1).count()
        now = next_.select("scan_index", "now")
        if not moved:
            return _boosted(scored, next_.select(F.col("scan_index").alias("i"), "boost"))


def with_boost(boosted: DataFrame) -> DataFrame:
    """Scores with the boost added (not held below 1), and the reason for it."""
    reason = F.concat(F.lit("Imported by "), F.floor(F.col("boost") * 100 + 0.5).cast("string"), F.lit(" highly relevant files"))
    more = F.when(F.col("boost") > 0, F.array_append("reasons", reason)).otherwise(F.col("reasons"))
    return boosted.withColumns({"score": F.col("score") + F.col("boost"), "reasons": more}).drop("boost")
