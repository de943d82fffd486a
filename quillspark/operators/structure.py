"""What is made of a file's declarations: metadata, skeletons, symbols. All are Column expressions over the list that
``functions.declarations`` gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.declarations import declarations
from quillspark.functions.paths import base_name, relative
from quillspark.functions.text import trimmed

# What stands for bodies, and how long a kept initializer may be.
TRIMMED = "/* trimmed */"
KEPT_INIT = 50


def parsed(corpus: DataFrame) -> DataFrame:
    """``corpus`` with items and error; nothing is read of null or empty contents."""
    return corpus.withColumn("_parsed", declarations(F.col("content"))).select(*corpus.columns, "_parsed.items", "_parsed.error")


def _kind(items: Column, *kinds: str) -> Column:
    return F.filter(items, lambda d: d["kind"].isin(*kinds))


def metadata(items: Column, content: Column) -> Column:
    """Struct of imports, exports, symbol_count and lines_of_code; null for an empty file."""
    exported = lambda kind: F.transform(F.filter(_kind(items, kind), lambda d: d["modifiers"].rlike(r"(^| )export( |$)")), lambda d: F.coalesce(d["name"], F.lit("anonymous")))
    known = F.struct(
        F.flatten(F.transform(_kind(items, "import"), lambda d: d["names"])).alias("imports"),
        F.concat(F.flatten(F.transform(_kind(items, "export"), lambda d: d["names"])), exported("function"), exported("class"), exported("variable")).alias("exports"),
        F.size(_kind(items, "function", "class", "interface", "type", "enum")).alias("symbol_count"),
        (F.regexp_count(content, F.lit("\n")) + 1).alias("lines_of_code"),
    )
    return F.when(content.isNotNull() & (content != ""), known)


def file_metadata(corpus: DataFrame) -> DataFrame:
    """``corpus`` with imports, exports, symbol_count and lines_of_code."""
    return parsed(corpus).select(*corpus.columns, metadata(F.col("items"), F.col("content")).alias("_m")).select(*corpus.columns, "_m.*")


def _joined(*parts: Column, by: str = "\n") -> Column:
    """The parts that aren't null, joined."""
    return F.concat_ws(by, *parts)


def _led(words: Column, rest: Column) -> Column:
    """Modifiers, if there are any, before the rest."""
    return F.when(words != "", F.concat(words, F.lit(" "), rest)).otherwise(rest)


def _indented(doc: Column) -> Column:
    return F.concat(F.lit("  "), F.replace(doc, F.lit("\n"), F.lit("\n  ")))


def _mark(symbol: Column) -> Column:
    return F.concat(F.lit("/* [SYMBOL:"), symbol, F.lit("] - Implementation available via get_symbol_details */"))


def _member_id(d: Column, class_name: Column) -> Column:
    return F.concat(class_name, F.lit("."), d["name"])


def _class_name(d: Column) -> Column:
    return F.coalesce(d["name"], F.lit("Anonymous"))


def _method(d: Column, class_name: Column, mapped: bool) -> Column:
    body = _mark(_member_id(d, class_name)) if mapped else F.lit(TRIMMED)
    head = F.when(d["kind"] == "constructor", F.concat(F.lit("constructor("), d["params"], F.lit(") {"))).otherwise(_led(d["modifiers"], F.concat(d["name"], F.lit("("), d["params"], F.lit("): "), d["type"], F.lit(" {"))))
    doc = F.lit(None).cast("string") if mapped else _indented(d["doc"])
    return _joined(doc, F.concat(F.lit("  "), head), F.concat(F.lit("    "), body), F.lit("  }"), F.lit(""))


def _class(d: Column, items: Column, mapped: bool) -> Column:
    of = lambda kind: F.filter(items, lambda m: (m["parent"] == d["ord"]) & (m["kind"] == kind))
    name = _class_name(d)
    properties = F.transform(of("property"), lambda p: F.concat(F.lit("  "), _led(p["modifiers"], F.concat(p["name"], F.lit(": "), p["type"], F.lit(";")))))
    properties = F.when(F.size(properties) > 0, F.array_append(properties, F.lit(""))).otherwise(properties)
    head = F.concat(_led(d["modifiers"], F.concat(F.lit("class "), name)), d["head"], F.lit(" {"))
    opening = F.array(head) if mapped else F.array_compact(F.array(d["doc"], head))
    bodies = lambda kind: F.transform(of(kind), lambda m: _method(m, name, mapped))
    return F.array_join(F.concat(opening, properties, bodies("method"), bodies("constructor"), F.array(F.lit("}"))), "\n")


def _function(d: Column, mapped: bool) -> Column:
    name = F.coalesce(d["name"], F.lit("anonymous" if mapped else "undefined"))
    body = _mark(name) if mapped else F.lit(TRIMMED)
    head = _led(d["modifiers"], F.concat(F.lit("function "), name, F.lit("("), d["params"], F.lit("): "), d["type"], F.lit(" {")))
    return _joined(F.lit(None).cast("string") if mapped else d["doc"], head, F.concat(F.lit("  "), body), F.lit("}"))


def _is_arrow(d: Column) -> Column:
    return F.coalesce(F.contains(d["init"], F.lit("=>")), F.lit(False))


def _variable(d: Column, mapped: bool) -> Column:
    short = (F.length(d["init"]) < KEPT_INIT) & ~F.contains(d["init"], F.lit("{"))
    kept, cut = F.concat(F.lit(" = "), d["init"]), F.lit(f" = {TRIMMED}")
    if mapped:
        value = F.when(d["init"].isNull(), F.lit("")).when(_is_arrow(d), F.concat(F.lit(" = /* [SYMBOL:"), d["name"], F.lit("] */"))).when(short, kept).otherwise(cut)
    else:
        value = F.when(d["init"].isNull(), F.lit("")).when(short & ~_is_arrow(d), kept).otherwise(cut)
    return _led(d["modifiers"], F.concat(d["head"], F.lit(" "), d["name"], F.lit(": "), d["type"], value, F.lit(";")))


def _statements(items: Column, mapped: bool) -> Column:
    """A text for each variable statement: its doc comment, then a line for each declaration."""
    variables = _kind(items, "variable")
    numbers = F.array_distinct(F.transform(variables, lambda d: d["statement"]))

    def statement(n: Column) -> Column:
        own = F.filter(variables, lambda d: d["statement"] == n)
        lines = F.transform(own, lambda d: _variable(d, mapped))
        return F.array_join(lines if mapped else F.concat(F.array_compact(F.array(own[0]["doc"])), lines), "\n")

    return F.transform(numbers, statement)


def skeleton(path: Column, items: Column, error: Column, mapped: bool = False) -> Column:
    """The file without bodies: imports, then by kind classes, interfaces, types, enums, functions, variables, exports.

    ``mapped``: bodies name their symbols, and doc comments are left out.
    """
    spaced = lambda texts: F.flatten(F.transform(texts, lambda t: F.array(t, F.lit(""))))
    verbatim = lambda kind: F.transform(_kind(items, kind), lambda d: d["text"])
    imports = verbatim("import")
    lines = F.concat(
        F.array(F.concat(F.lit("/* Skeleton of "), base_name(path), F.lit(" - Generated with symbol mapping */\n" if mapped else " */\n"))),
        F.when(F.size(imports) > 0, F.array_append(imports, F.lit(""))).otherwise(imports),
        spaced(F.transform(_kind(items, "class"), lambda d: _class(d, items, mapped))),
        spaced(verbatim("interface")),
        spaced(verbatim("type")),
        spaced(verbatim("enum")),
        spaced(F.transform(_kind(items, "function"), lambda d: _function(d, mapped))),
        spaced(_statements(items, mapped)),
        verbatim("export"),
        verbatim("assignment"),
    )
    return F.when(error.isNotNull(), F.concat(F.lit("/* Failed to parse file: "), error, F.lit(" */"))).otherwise(trimmed(F.array_join(lines, "\n")))


def skeletons(corpus: DataFrame, mapped: bool = False) -> DataFrame:
    """``corpus`` with skeleton (and items, for ``symbols``)."""
    return parsed(corpus).withColumn("skeleton", skeleton(F.col("path"), F.col("items"), F.col("error"), mapped))


def symbols(read: DataFrame, root: str = "") -> DataFrame:
    """The symbol table of files with items (``parsed`` or ``skeletons``): a row for each method, constructor, function
    and arrow function, in the order of the skeleton."""
    items = F.col("items")
    found = F.filter(items, lambda d: d["kind"].isin("method", "constructor", "function") | ((d["kind"] == "variable") & _is_arrow(d)))

    def symbol(d: Column) -> Column:
        parent = F.when(d["parent"] >= 0, _class_name(F.get(items, d["parent"])))
        name = F.coalesce(d["name"], F.lit("anonymous"))
        kind = F.when(d["kind"] == "variable", F.lit("arrow-function")).otherwise(d["kind"])
        before_body = F.when(d["kind"] == "variable", F.concat(d["head"], F.lit(" "), d["name"], F.lit(": "), d["type"])).when(d["kind"] != "constructor", trimmed(F.substring_index(d["text"], "{", 1)))
        group = F.when(d["parent"] >= 0, 0).when(d["kind"] == "function", 1).otherwise(2)
        return F.struct(
            F.struct(group.alias("group"), d["parent"].alias("parent"), (d["kind"] == "constructor").alias("last"), d["ord"].alias("ord")).alias("order"),
            F.coalesce(F.concat(parent, F.lit("."), name), name).alias("symbol_id"),
            name.alias("symbol_name"),
            kind.alias("symbol_type"),
            d["start_line"].alias("start_line"),
            d["end_line"].alias("end_line"),
            d["start_pos"].alias("start_pos"),
            d["end_pos"].alias("end_pos"),
            parent.alias("parent_class"),
            before_body.alias("signature"),
        )

    listed = F.array_sort(F.transform(found, symbol))
    exploded = read.select(F.col("scan_index").alias("file_order"), relative(F.col("path"), root).alias("file_path"), F.posexplode(listed).alias("symbol_order", "_"))
    return exploded.select("file_order", "symbol_order", "_.symbol_id", "_.symbol_name", "_.symbol_type", "file_path", "_.start_line", "_.end_line", "_.start_pos", "_.end_pos", "_.parent_class", "_.signature")


def symbol_details(table: DataFrame, corpus: DataFrame, symbol_id: str, root: str = "") -> DataFrame:
    """The first symbol of that id, with content, the whole lines that it covers."""
    first = table.where(F.col("symbol_id") == symbol_id).orderBy("file_order", "symbol_order").limit(1)
    files = corpus.select(relative(F.col("path"), root).alias("_path"), "content")
    return first.join(files, first.file_path == files._path).drop("_path").withColumn("content", source_lines(F.col("content"), F.col("start_line"), F.col("end_line")))


def source_lines(content: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(content, "\n", -1), start, end - start + 1), "\n")


#: Results that a search shows.
SHOWN = 20


def search(table: DataFrame, query: str, symbol_type: str | None = None) -> DataFrame:
    """Symbols whose name, file or signature holds the query, whatever its case."""
    low = query.lower()
    held = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    found = table.where(held("symbol_name") | held("file_path") | held("signature"))
    return found.where(F.col("symbol_type") == symbol_type) if symbol_type else found


def search_shown(table: DataFrame, query: str, symbol_type: str | None = None) -> DataFrame:
    """The first ``SHOWN`` results in mapping order."""
    return search(table, query, symbol_type).orderBy("file_order", "symbol_order").limit(SHOWN)


def stats(table: DataFrame) -> DataFrame:
    """Symbols of each type."""
    return table.groupBy("symbol_type").agg(F.count(F.lit(1)).alias("n"))


def totals(table: DataFrame) -> DataFrame:
    """Files that have symbols, and symbols."""
    return table.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))
