"""A Parquet cache of ingested logs, refreshed file by file."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tributary.model import LOGS_SCHEMA, Promotion
from tributary.plans.session import Logs
from tributary.sources.datasource import _options, read_logs
from tributary.sources.infer import infer, promote, sample
from tributary.sources.walk import walk_all

#: Raised when what is stored changes.
VERSION = 2
MOST_CACHE_BYTES, MOST_CACHE_DAYS = 2 << 30, 14


_STORED = StructType([*LOGS_SCHEMA.fields, StructField("rec_no", LongType())])


def _name(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def cache_key(paths: list[str], **options) -> str:
    """Identity of an ingest: its version, options and paths, but not the files' sizes."""
    own = json.dumps([VERSION, sorted(os.path.abspath(p) for p in paths), sorted((k, str(v)) for k, v in options.items())])
    return hashlib.sha256(own.encode()).hexdigest()[:24]


@dataclass
class Store:
    """Logs below some paths, kept as Parquet partitioned by file, with ``_meta.json`` written last."""

    spark: SparkSession
    root: str

    def folder(self, key: str) -> str:
        return os.path.join(self.root, key)

    def _meta(self, key: str) -> dict | None:
        try:
            with open(os.path.join(self.folder(key), "_meta.json")) as f:
                meta = json.load(f)
        except (OSError, ValueError):
            return None
        return meta if meta.get("version") == VERSION and meta.get("complete") else None

    def open(self, paths: list[str], zone: str = "UTC", **options) -> Logs:
        """The cached table; files that changed since are ingested anew, those that went are dropped."""
        key = cache_key(paths, **options)
        walk_options = {k: tuple(v.split(",")) if isinstance(v, str) else v for k, v in options.items() if k in ("include", "exclude") and v}
        files = {f.path: f.fingerprint for f in walk_all(paths, **walk_options).files}
        meta = self._meta(key)
        known = meta["files"] if meta else {}
        stale = [p for p, mark in files.items() if known.get(p) != mark]
        gone = [p for p in known if p not in files]
        if meta is None or stale or gone:
            keep = [p for p in files if p in known and p not in stale]
            self._refresh(key, files, stale, keep, options)
            meta = self._meta(key)
        os.utime(self.folder(key))
        promotions = tuple(Promotion(**p) for p in meta["promotions"])
        return Logs(promote(self._base(key, meta["generation"], meta["files"]), list(promotions)), promotions, zone)

    def _base(self, key: str, generation: str, files: dict[str, str]) -> DataFrame:
        """Base columns with a dense seq over the files' order."""
        from pyspark.sql.window import Window

        rows = self.spark.read.schema(_STORED).parquet(os.path.join(self.folder(key), generation))
        order = self.spark.createDataFrame([(p, n) for n, p in enumerate(files)], "file string, file_ord int")
        counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(order, "file")
        before = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
        bases = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        return rows.join(F.broadcast(bases), "file").withColumn("seq", F.col("base") + F.col("rec_no")).select(*LOGS_SCHEMA.names)

    def _refresh(self, key: str, files: dict[str, str], stale: list[str], keep: list[str], options: dict) -> None:
        """Write a new generation next to the old one: kept files are copied as files, changed ones are ingested together."""
        folder, generation = self.folder(key), f"gen-{time.time_ns()}"
        target = os.path.join(folder, generation)
        os.makedirs(target, exist_ok=True)
        old = (self._meta(key) or {}).get("generation")
        for path in keep:
            kept = os.path.join(folder, old, f"name={_name(path)}") if old else ""
            if os.path.isdir(kept):  # a file without records has none
                shutil.copytree(kept, os.path.join(target, f"name={_name(path)}"))
        if stale:
            read_options = {k: v for k, v in options.items() if k not in ("include", "exclude")}
            rows = read_logs(self.spark, stale, **read_options)
            first = rows.groupBy("file").agg(F.min("seq").alias("first"))  # one row a file
            rows = rows.join(F.broadcast(first), "file").withColumn("rec_no", F.col("seq") - F.col("first") + 1).drop("first")
            rows.withColumn("name", F.substring(F.sha2(F.col("file").cast("binary"), 256), 1, 16)).write.mode("append").partitionBy("name").parquet(target)
        meta = {"version": VERSION, "complete": True, "generation": generation, "files": files, "promotions": []}
        if files:
            found = infer(sample(self._base(key, generation, files)))
            meta["promotions"] = [p.__dict__ for p in found]
        partial = os.path.join(folder, "_meta.json.partial")
        with open(partial, "w") as f:
            json.dump(meta, f)
        os.replace(partial, os.path.join(folder, "_meta.json"))
        for name in os.listdir(folder):
            if name.startswith("gen-") and name not in (generation, old):
                shutil.rmtree(os.path.join(folder, name), ignore_errors=True)

    def entries(self) -> list[tuple[str, int, float]]:
        """(key, bytes, last use) of what is cached."""
        out = []
        for key in os.listdir(self.root) if os.path.isdir(self.root) else []:
            folder = self.folder(key)
            size = sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names)
            out.append((key, size, os.path.getmtime(folder)))
        return sorted(out, key=lambda e: -e[2])

    def prune(self, most_bytes: int = MOST_CACHE_BYTES, most_days: float = MOST_CACHE_DAYS) -> list[str]:
        """Drop what has not been used for long, then the least recently used beyond the size."""
        dropped, total = [], 0
        for key, size, used in self.entries():
            total += size
            if total > most_bytes or time.time() - used > most_days * 86400:
                shutil.rmtree(self.folder(key), ignore_errors=True)
                dropped.append(key)
        return dropped

    def clear(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)


__all__ = ["Store", "_options", "cache_key"]
