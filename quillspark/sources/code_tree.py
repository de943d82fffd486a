"""Trees of source files as corpora.

Spark's own file sources leave out names that begin with a dot or an underscore, which belong to a source tree. Here
tasks list folders: each goes into the folders it is given until it has found ``ENTRIES`` files and folders, and hands on
those it hasn't come to, which the next round deals out anew. The driver counts what is left, and holds no list. Scan
order is that of a depth-first walk with names in byte order: the order of paths whose dividers are zero bytes, by which
Spark sorts ranges and numbers them. The listing is a table in the shared folder.

``content`` is read by a function of Arrow batches that Spark evaluates last: a query that doesn't ask for it opens no
file, and one with a filter on any other column opens the files that pass. Links are no files; folders that can't be
listed have none. Bytes of names that are no UTF-8 show as replacement characters, and the files are read all the same.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import utf8_text
from quillspark.operators.prefix import numbered
from quillspark.sources.scope import IGNORED, SUFFIXES, Scope
from quillspark.sources.shared import shared_dir, written

#: What a task lists of a tree before it hands the rest on, and what a task reads of its files, in bytes.
ENTRIES, PART_BYTES = 20_000, 8 << 20

_LISTED = "top int, module string, root binary, raw binary, key binary, bytes bigint, folder boolean"
_LISTED_ARROW = pa.schema([("top", pa.int32()), ("module", pa.string()), ("root", pa.binary()), ("raw", pa.binary()), ("key", pa.binary()), ("bytes", pa.int64()), ("folder", pa.bool_())])


def walk(root: str, ignored: frozenset[str] = frozenset(IGNORED), suffixes: tuple[str, ...] = SUFFIXES) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files below ``root`` that end so, in scan order, by one process: what ``listed`` is tested against."""
    try:
        entries = sorted(os.scandir(root), key=lambda e: os.fsencode(e.name))
    except OSError:
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if e.name not in ignored:
                yield from walk(e.path, ignored, suffixes)
        elif e.is_file(follow_symlinks=False) and e.name.endswith(suffixes):
            yield e.path, e.stat(follow_symlinks=False).st_size


def _expand(entries: int, ignored: frozenset[bytes], suffixes: tuple[bytes, ...]):
    """Lists folders, nearest ones first, and after ``entries`` of what it finds gives back those that are left."""

    def expand(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = deque(row for frame in frames for row in frame.to_pylist())
        out, seen = [], 0
        while todo and seen < entries:
            at = todo.popleft()
            try:
                found = [*os.scandir(at["raw"])]
            except OSError:
                continue
            for e in found:
                seen += 1
                try:
                    kind = "d" if e.is_dir(follow_symlinks=False) else "f" if e.is_file(follow_symlinks=False) else ""
                    size = e.stat(follow_symlinks=False).st_size if kind == "f" and e.name.endswith(suffixes) else -1
                except OSError:
                    continue
                key = (at["key"] + b"\0" if at["key"] else b"") + e.name
                if kind == "d" and e.name not in ignored:
                    todo.append(at | {"raw": e.path, "key": key})
                elif size >= 0:
                    out.append(at | {"raw": e.path, "key": key, "bytes": size, "folder": False})
            if len(out) >= 2048:
                yield pa.RecordBatch.from_pylist(out, _LISTED_ARROW)
                out = []
        yield pa.RecordBatch.from_pylist([*out, *todo], _LISTED_ARROW)

    return expand


def listed(spark: SparkSession, tops: list[tuple[str, str]], ignored: tuple[str, ...] = IGNORED, suffixes: tuple[str, ...] = SUFFIXES, entries: int = ENTRIES) -> DataFrame:
    """(top, module, root, raw, key, bytes): the files below each of ``tops`` (module, folder), in no order.

    A round of tasks for every ``entries`` of the deepest way into the tree; the names of the tops themselves don't matter.
    """
    rows = [(k, module, os.fsencode(folder), os.fsencode(folder), b"", 0, True) for k, (module, folder) in enumerate(tops)]
    left = spark.createDataFrame(rows, _LISTED)
    expand = _expand(entries, frozenset(map(os.fsencode, ignored)), tuple(map(os.fsencode, suffixes)))
    files, n = None, len(rows)
    while n:
        deal = left.repartition(min(n, max(spark.sparkContext.defaultParallelism, n // 64)))
        round_ = written(deal.mapInArrow(expand, _LISTED), "listing")
        found, left = round_.where(~F.col("folder")), round_.where("folder")
        files = found if files is None else files.unionByName(found)
        n = left.count()
    return (files if files is not None else left.where(~F.col("folder"))).drop("folder")


@F.arrow_udf(T.BinaryType())
def _bytes(raw: pa.Array) -> pa.Array:
    def read(path: bytes) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError:
            return None

    return pa.array([None if p is None else read(p) for p in raw.to_pylist()], pa.binary())


def _corpus(spark: SparkSession, tops: list[tuple[str, str]], root: str, entries: int = ENTRIES) -> DataFrame:
    """Files of the tops, numbered along them, dealt out by what a task can hold, with content to be read."""
    files = numbered(listed(spark, tops, entries=entries), "scan_index", "top", "key")
    total = files.agg(F.sum(F.col("bytes") + 1024)).first()[0] or 0
    text = lambda c: F.make_valid_utf8(c.cast("string"))
    prefix = os.fsencode(root).rstrip(b"/") + b"/"
    outside = F.substr("raw", F.length("root") + 2)  # of a module that doesn't lie below the root
    relative = F.when(F.startswith("raw", F.lit(prefix)), F.substr("raw", F.lit(len(prefix) + 1))).otherwise(outside)
    dealt = files.repartition(max(1, -(-total // PART_BYTES)), "scan_index")
    return dealt.select("scan_index", text(F.col("raw")).alias("path"), text(relative).alias("rel_path"), "module", utf8_text(_bytes("raw")).alias("content"))


def scan(spark: SparkSession, root: str, entries: int = ENTRIES) -> DataFrame:
    """All source files below ``root`` as (scan_index, path, rel_path, module, content); content is null if unreadable."""
    root = os.path.abspath(root)
    return _corpus(spark, [("", root)], root, entries)


def scan_modules(spark: SparkSession, root: str, keys: list[str] | None = None, scope: Scope | None = None) -> DataFrame:
    """Source files of the scope's modules; a module whose folder is missing has none."""
    scope = scope or Scope()
    root = os.path.abspath(root)
    return _corpus(spark, [(key, folder) for key, folder in scope.folders(root, keys) if os.path.isdir(folder)], scope.resolve_root(root))


def write_tree(corpus: DataFrame, root: str) -> None:
    """Write a corpus (path, content) as files below the folder ``root``, which all executors see, by tasks.

    Paths go down from ``root``; one that leads out of it raises. Null content makes no file. A file is renamed into its
    place when it is complete, so a task that fails leaves no half file, and one that runs again writes the same.
    """
    root = os.path.abspath(root)

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for frame in frames:
            for path, content in zip(frame.column("path").to_pylist(), frame.column("content").to_pylist()):
                place = os.path.normpath(os.path.join(root, path))
                if not place.startswith(root + os.sep):
                    raise ValueError(f"{path} leads out of the tree")
                os.makedirs(os.path.dirname(place), exist_ok=True)
                part = f"{place}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content.encode("utf-8"))
                os.replace(part, place)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    corpus.where("path is not null and content is not null").select("path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def local_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, as a path that ``open`` understands; refused if the shared folder isn't mounted."""
    import uuid

    shared = shared_dir(spark)
    if "://" in shared and not shared.startswith("file:///"):
        raise ValueError(f"{shared} is no mounted folder")
    return os.path.join(shared.removeprefix("file://").replace("file:", "", 1), f"{tag}-{uuid.uuid4().hex[:12]}")


def from_table(table: DataFrame, path: F.Column, content: F.Column, scan_index: F.Column) -> DataFrame:
    """Rows of any table as a corpus."""
    return table.select(scan_index.cast("long").alias("scan_index"), path.alias("path"), content.alias("content"))


def scoped(corpus: DataFrame, scope: Scope, keys: list[str] | None = None) -> DataFrame:
    """Files of a corpus that lie in the scope's modules, with the module's key; paths are from the root on.

    One pass over the corpus: the modules' folders are compared in the registry's order, and a file in two modules
    comes twice, as ``scan_modules`` reads it twice.
    """
    of = F.array_compact(F.array(*[F.when(F.col("path").startswith(m.relative_path + "/"), F.lit(m.key)) for m in scope.chosen(keys)]))
    return corpus.drop("module").select("*", F.explode(of).alias("module"))
