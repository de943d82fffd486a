"""A tool server over stdin and stdout: a JSON-RPC message on each line, one tool, ``scan_codebase``."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from quillspark.plans.analysis import Options, analyze, result_json
from quillspark.sources.artefacts import pretty

TOOL = {
    "name": "scan_codebase",
    "description": "The files that matter for a question, without their bodies.",
    "inputSchema": {
        "type": "object",
        "properties": {"question": {"type": "string"}, "root": {"type": "string"}, "limit": {"type": "number", "default": 10}, "modules": {"type": "array", "items": {"type": "string"}}},
        "required": ["question", "root"],
    },
}


def answer(spark: SparkSession, method: str, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillspark", "version": "1"}}
    if method == "tools/list":
        return {"tools": [TOOL]}
    if method == "tools/call":
        if params.get("name") != TOOL["name"]:
            raise ValueError(f"Unknown tool: {params.get('name')}")
        a = params.get("arguments", {})
        options = Options(a["root"], a["question"], int(a.get("limit", 10)), module_keys=a.get("modules") or None)
        return {"content": [{"type": "text", "text": pretty(result_json(analyze(spark, options), options))}]}
    raise ValueError(f"Unknown method: {method}")


def serve(spark: SparkSession, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            continue
        message = json.loads(line)
        if "id" not in message:
            continue
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            reply["result"] = answer(spark, message["method"], message.get("params") or {})
        except Exception as e:  # goes to the caller
            reply["error"] = {"code": -32000, "message": str(e)}
        yield json.dumps(reply)


if __name__ == "__main__":
    session = SparkSession.builder.appName("quillspark").getOrCreate()
    for out in serve(session, sys.stdin):
        print(out, flush=True)
