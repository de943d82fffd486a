"""A cache of results that is valid while the scanned files are the ones it was made from.

An entry is a folder of two Parquet tables: the result, and the path and hash of every scanned file. It is valid if it
hasn't expired and joining the stored hashes to the present ones leaves nothing on either side, so no list of files
passes through the driver. Results are a few rows and are kept in memory as well.
"""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIFE = timedelta(hours=24)


def cache_key(root: str, question: str, modules: list[str] | None, enhanced: bool, limit: int, mapping: bool = False) -> str:
    """md5 of the options; the order of modules matters. A mapping is part of the key, so that a result from the cache never stands for one not written."""
    flag = lambda x: "true" if x else "false"
    return md5("|".join([root, question, ",".join(modules or []), flag(enhanced), str(limit), *(["mapping"] if mapping else [])]).encode()).hexdigest()


def cache_key_of(root: Column, question: Column, modules: Column, enhanced: Column, limit: Column) -> Column:
    """``cache_key`` of rows."""
    return F.md5(F.concat_ws("|", root, question, modules, enhanced.cast("string"), limit.cast("string")))


def hashes(corpus: DataFrame) -> DataFrame:
    """(path, md5) of the files that could be read."""
    return corpus.where(F.col("content").isNotNull()).select("path", F.md5(F.col("content")).alias("md5"))


def differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that are only on one side or have another hash: none, if an entry is valid."""
    a, b = stored.select(F.col("path").alias("p1"), F.col("md5").alias("m1")), current.select(F.col("path").alias("p2"), F.col("md5").alias("m2"))
    both = a.join(b, F.col("p1") == F.col("p2"), "full")
    return both.where(~F.col("m1").eqNullSafe(F.col("m2"))).select(F.coalesce("p1", "p2").alias("path"), F.col("m1").alias("stored"), F.col("m2").alias("current"))


@dataclass
class ResultCache:
    spark: SparkSession
    folder: str
    enabled: bool = True
    in_memory: bool = True
    on_disk: bool = True
    hits: int = 0
    misses: int = 0
    invalidations: int = 0
    _held: dict[str, tuple[list, object, datetime]] = field(default_factory=dict)

    def _path(self, key: str, what: str) -> str:
        return os.path.join(self.folder, key, what)

    def _valid(self, key: str, expires: datetime, corpus: DataFrame, now: datetime) -> bool:
        if now > expires:
            return False
        stored = self.spark.read.parquet(self._path(key, "hashes"))
        return differences(stored, hashes(corpus)).limit(1).count() == 0

    def get(self, key: str, corpus: DataFrame, now: datetime | None = None) -> DataFrame | None:
        """The result of this key, if it is valid for the corpus as it is now."""
        now = now or datetime.now(UTC)
        if self.enabled and os.path.isdir(self._path(key, "hashes")):
            rows, schema, expires = self._held.get(key) or self._read(key)
            if self._valid(key, expires, corpus, now):
                if self.in_memory:
                    self._held[key] = rows, schema, expires
                self.hits += 1
                return self.spark.createDataFrame(rows, schema)
            self.invalidations += 1
            self._held.pop(key, None)
        self.misses += 1
        return None

    def _read(self, key: str) -> tuple[list, object, datetime]:
        table = self.spark.read.parquet(self._path(key, "result"))
        times = self.spark.read.parquet(self._path(key, "times")).first()
        return table.collect(), table.schema, times["expires_at"].astimezone(UTC) if times["expires_at"].tzinfo else datetime.fromtimestamp(times["expires_at"].timestamp(), UTC)

    def set(self, key: str, result: DataFrame, corpus: DataFrame, now: datetime | None = None) -> None:
        """Keep ``result``, a few rows, for ``LIFE`` or until a scanned file changes."""
        if not self.enabled:
            return
        now = now or datetime.now(UTC)
        rows = result.collect()
        hashes(corpus).write.mode("overwrite").parquet(self._path(key, "hashes"))
        if self.on_disk:
            self.spark.createDataFrame(rows, result.schema).coalesce(1).write.mode("overwrite").parquet(self._path(key, "result"))
            self.spark.createDataFrame([(now, now + LIFE)], "created_at timestamp, expires_at timestamp").coalesce(1).write.mode("overwrite").parquet(self._path(key, "times"))
        if self.in_memory:
            self._held[key] = rows, result.schema, now + LIFE

    def clear(self) -> None:
        self.clear_memory()
        if os.path.isdir(self.folder):
            for key in os.listdir(self.folder):
                if len(key) == 32:
                    shutil.rmtree(os.path.join(self.folder, key), ignore_errors=True)
        self.hits = self.misses = self.invalidations = 0

    def clear_memory(self) -> None:
        self._held.clear()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.folder) for f in names) if os.path.isdir(self.folder) else 0
        return {"hits": self.hits, "misses": self.misses, "invalidations": self.invalidations, "hitRate": int(100 * self.hits / asked + 0.5) / 100 if asked else 0, "cacheSize": size}
