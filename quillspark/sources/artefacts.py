"""JSON artefacts: symbol mappings and results, in the shape that other tools of this kind read."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SYMBOL = "struct<symbolId:string,symbolName:string,symbolType:string,filePath:string,startLine:int,endLine:int,startPos:int,endPos:int,parentClass:string,signature:string>"
MAPPING = f"generatedAt string, rootPath string, files map<string,struct<originalPath:string,symbols:array<{SYMBOL}>>>"
_COLUMNS = {"symbolId": "symbol_id", "symbolName": "symbol_name", "symbolType": "symbol_type", "filePath": "file_path", "startLine": "start_line", "endLine": "end_line", "startPos": "start_pos", "endPos": "end_pos", "parentClass": "parent_class", "signature": "signature"}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


@dataclass
class _Part(WriterCommitMessage):
    place: int
    file: str
    n: int


class _MappingWriter(DataSourceWriter):
    """Each task renders its files into a part beside the mapping; the commit puts the parts together and into place."""

    def __init__(self, options: dict):
        self.path, self.root, self.stamp = options["path"], options["root"], options["stamp"]
        self.parts = f"{self.path}.{uuid.uuid4().hex[:12]}.parts"

    def write(self, rows: Iterator[Row]) -> _Part:
        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        file = os.path.join(self.parts, f"{context.partitionId()}-{context.taskAttemptId()}")
        n = 0
        with open(file, "w", encoding="utf-8") as f:
            for name, found in groupby(rows, key=lambda r: r["file_path"]):
                held = [{k: r[c] for k, c in _COLUMNS.items() if r[c] is not None} for r in found]
                body = json.dumps({"originalPath": os.path.join(self.root, name), "symbols": held}, indent=2, ensure_ascii=False).replace("\n", "\n    ")
                f.write(("," if n else "") + f"\n    {json.dumps(name, ensure_ascii=False)}: {body}")
                n += 1
        return _Part(context.partitionId(), file, n)

    def commit(self, messages: list[_Part]) -> None:
        whole = f"{self.parts}.whole"
        with open(whole, "wb") as f:
            f.write(("{\n  " + f'"generatedAt": {json.dumps(self.stamp)},\n  "rootPath": {json.dumps(self.root, ensure_ascii=False)},\n  "files": {{').encode())
            for k, part in enumerate(sorted((m for m in messages if m is not None and m.n), key=lambda m: m.place)):
                if k:
                    f.write(b",")
                with open(part.file, "rb") as p:
                    shutil.copyfileobj(p, f, 1 << 20)
            f.write(b"\n  }\n}")
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[_Part]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class SymbolMapping(DataSource):
    """Writes a symbol table (in ranges of files, sorted) as one JSON file. Options: ``path``, ``root`` and ``stamp``."""

    @classmethod
    def name(cls) -> str:
        return "symbol_mapping"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _MappingWriter(self.options)


def save_mapping(symbols: DataFrame, path: str, root: str, now: datetime | None = None) -> None:
    """One pretty JSON file, in mapping order. Without symbols it has no files.

    Tasks write ranges of files, and the driver only copies their bytes one after another. The file is renamed into
    place when it is whole, so a failed task leaves the one that was there.
    """
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    symbols.sparkSession.dataSource.register(SymbolMapping)
    ordered = symbols.select("file_order", "symbol_order", *_COLUMNS.values()).repartitionByRange("file_order").sortWithinPartitions("file_order", "symbol_order")
    ordered.write.format("symbol_mapping").mode("overwrite").option("path", os.path.abspath(path)).option("root", root).option("stamp", stamp).save()


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The symbol table of a mapping file. Files come in the order of their entries, as far as the file keeps one."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    whole = spark.read.schema(MAPPING).option("multiLine", True).json(path)
    files = whole.select("rootPath", F.posexplode(F.map_entries("files")).alias("file_order", "_"))
    rows = files.select("rootPath", "file_order", F.posexplode("_.value.symbols").alias("symbol_order", "s"))
    return rows.select(F.col("file_order").cast("long").alias("file_order"), "symbol_order", *[F.col(f"s.{k}").alias(c) for k, c in _COLUMNS.items()], F.col("rootPath").alias("root_path"))


def pretty(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def save(value: object, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(pretty(value))
