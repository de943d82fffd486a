"""Tools over a symbol table, as an assistant calls them: details of a symbol, search, a file's imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import structure
from quillspark.operators.imports import specifiers
from quillspark.sources import artefacts

DEFINITIONS = [
    {"name": "get_symbol_details", "description": "The source of a symbol.", "parameters": {"type": "object", "properties": {"symbolId": {"type": "string"}}, "required": ["symbolId"]}},
    {"name": "search_symbols", "description": "Symbols whose name, file or signature holds the query.", "parameters": {"type": "object", "properties": {"query": {"type": "string"}, "symbolType": {"type": "string", "enum": ["function", "class", "method", "constructor", "arrow-function"]}}, "required": ["query"]}},
    {"name": "analyze_file_dependencies", "description": "The imports and symbols of a file.", "parameters": {"type": "object", "properties": {"filePath": {"type": "string"}}, "required": ["filePath"]}},
]
_HIDDEN = ("file_order", "symbol_order", "root_path", "content")


def _shown(row) -> dict:
    return {artefacts.camel(k): v for k, v in row.asDict().items() if k not in _HIDDEN and v is not None}


class Toolbox:
    """``model``, if given, answers a prompt and may ask for tools: a callable of (messages, definitions)."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, root: str = "", symbols: DataFrame | None = None, model: Callable | None = None):
        self.spark, self.corpus, self.root, self.symbols, self.model = spark, corpus, root, symbols, model

    def load_mapping(self, path: str) -> None:
        self.symbols = artefacts.load_mapping(self.spark, path)

    def get_symbol_details(self, symbol_id: str) -> dict:
        if self.symbols is None:
            return {"error": "No mapping loaded"}
        row = structure.symbol_details(self.symbols, self.corpus, symbol_id, self.root).first()
        return {"symbolId": symbol_id, "content": row["content"], "location": _shown(row)} if row else {"error": f"Symbol not found: {symbol_id}"}

    def search_symbols(self, query: str, symbol_type: str | None = None) -> dict:
        if self.symbols is None:
            return {"error": "No mapping loaded"}
        found = structure.search(self.symbols, query, symbol_type)
        shown = structure.search_shown(self.symbols, query, symbol_type).collect()
        return {"query": query, "count": found.count(), "results": [_shown(r) for r in shown]}

    def analyze_file_dependencies(self, file_path: str) -> dict:
        if self.symbols is None:
            return {"error": "No mapping loaded"}
        mine = self.symbols.where(F.col("file_path") == file_path).orderBy("symbol_order").collect()
        if not mine:
            return {"error": f"File not found: {file_path}"}
        full = f"{self.root.rstrip('/')}/{file_path}" if self.root else file_path
        row = self.corpus.where(F.col("path") == full).select(specifiers(F.col("content")).alias("imports")).first()
        return {"filePath": file_path, "imports": row["imports"] if row else [], "symbols": [{"id": r["symbol_id"], "name": r["symbol_name"], "type": r["symbol_type"]} for r in mine]}

    def stats(self) -> dict:
        if self.symbols is None:
            return {"files": 0, "symbols": 0, "byType": {}}
        whole = structure.totals(self.symbols).first()
        return {"files": whole["files"], "symbols": whole["symbols"], "byType": {r["symbol_type"]: r["n"] for r in structure.stats(self.symbols).collect()}}

    def call(self, name: str, arguments: dict) -> dict:
        if name == "get_symbol_details":
            return self.get_symbol_details(arguments["symbolId"])
        if name == "search_symbols":
            return self.search_symbols(arguments["query"], arguments.get("symbolType"))
        if name == "analyze_file_dependencies":
            return self.analyze_file_dependencies(arguments["filePath"])
        return {"error": f"Unknown tool: {name}"}

    def chat(self, prompt: str, context: str = "") -> str:
        """Ask the model until it no longer asks for tools."""
        if self.model is None:
            raise RuntimeError("no model")
        messages = [{"role": "system", "text": context}, {"role": "user", "text": prompt}]
        while True:
            answer = self.model(messages, DEFINITIONS)
            if not answer.get("calls"):
                return answer["text"]
            messages.append({"role": "assistant", "calls": answer["calls"]})
            messages += [{"role": "tool", "name": c["name"], "result": self.call(c["name"], c["arguments"])} for c in answer["calls"]]
