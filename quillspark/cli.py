"""Command line: ``python -m quillspark.cli --question … --root …``. JSON goes to stdout, notices to stderr."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from quillspark.operators.cache import ResultCache
from quillspark.plans.analysis import Options, analyze, corpus_of, result_json
from quillspark.sources.artefacts import pretty
from quillspark.tools import Toolbox


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description="Which files matter for a question, without their bodies.")
    p.add_argument("--question", "-q")
    p.add_argument("--root", "-r", default=".")
    p.add_argument("--limit", "-l", type=positive, default=10)
    p.add_argument("--modules", "-m", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    p.add_argument("--all-files", action="store_true", help="scan the whole root, not the registry's modules")
    p.add_argument("--enhanced", action="store_true", help="rank by the enhanced score")
    p.add_argument("--mapping", action="store_true", help="write the symbol mapping")
    p.add_argument("--mapping-output")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--clear-cache", action="store_true")
    p.add_argument("--cache-stats", action="store_true")
    p.add_argument("--cache-dir", default=os.path.join(os.path.expanduser("~"), ".cache", "quillspark"))
    p.add_argument("--repl", action="store_true", help="ask the symbol table")
    return p


def repl(box: Toolbox, read=input, write=print) -> None:
    """Lines: ``stats``, ``search WORDS``, ``show SYMBOL``, ``file PATH``, ``exit``."""
    commands = {"search": ("search_symbols", "query"), "show": ("get_symbol_details", "symbolId"), "file": ("analyze_file_dependencies", "filePath")}
    while True:
        try:
            word, _, rest = read("> ").strip().partition(" ")
        except EOFError:
            return
        if word == "exit":
            return
        if word == "stats":
            write(pretty(box.stats()))
        elif word in commands:
            tool, argument = commands[word]
            write(pretty(box.call(tool, {argument: rest.strip()})))
        elif word:
            write("stats, search WORDS, show SYMBOL, file PATH, exit")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    cache = ResultCache(spark, args.cache_dir)
    if args.clear_cache:
        cache.clear()
        print("cache cleared", file=sys.stderr)
    if args.cache_stats:
        print(pretty(cache.stats()), file=sys.stderr)
    options = Options(args.root, args.question or "", args.limit, args.mapping, args.mapping_output, args.enhanced, args.modules, not args.all_files, args.no_cache)
    if args.repl:
        from quillspark.operators.structure import parsed, symbols

        corpus, root = corpus_of(spark, options)
        repl(Toolbox(spark, corpus, root, symbols(parsed(corpus), root).persist()))
        return 0
    if not args.question:
        if args.clear_cache or args.cache_stats:
            return 0
        parser().print_usage(sys.stderr)
        return 1
    try:
        print(pretty(result_json(analyze(spark, options, cache), options)))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
