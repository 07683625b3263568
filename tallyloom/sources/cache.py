"""Prepared tables of uploaded files, kept until a file changes."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyloom.operators.profile import Schema, detect_schema, prepare
from tallyloom.sources.files import read_csv


@dataclass(frozen=True)
class Stamp:
    """What tells a state of the files under a path: how many, the last change, their bytes, and a sum of digests of all three by file."""

    files: int
    changed: str
    size: int
    digest: int


def stamp(spark: SparkSession, path: str) -> Stamp:
    """The state of the files under ``path``, from their listing; none is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.max("modificationTime").alias("t"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return Stamp(row["n"], str(row["t"]), int(row["size"]), int(row["h"]))


class Frames:
    """Prepared frames by path. The same files give the same frame; a changed file is read anew and its old frame released.

    At most ``most`` frames are kept, the longest unused going first. They are persisted in memory and on disk, and what an
    executor loses is computed anew from the files.
    """

    def __init__(self, spark: SparkSession, most: int = 8):
        self.spark, self.most = spark, most
        self._held: OrderedDict[tuple[str, bool], tuple[Stamp, DataFrame, Schema]] = OrderedDict()

    def load(self, path: str, preserve_missing: bool = False) -> tuple[DataFrame, Schema]:
        """The prepared frame of a CSV file or folder, and its schema."""
        key, now = (path, preserve_missing), stamp(self.spark, path)
        held = self._held.get(key)
        if held is not None and held[0] == now:
            self._held.move_to_end(key)
            return held[1], held[2]
        self.release(path, preserve_missing)
        raw = read_csv(self.spark, path)
        schema = detect_schema(raw)
        frame = prepare(raw, schema, preserve_missing).persist(StorageLevel.MEMORY_AND_DISK)
        self._held[key] = (now, frame, schema)
        while len(self._held) > self.most:
            self.release(*next(iter(self._held)))
        return frame, schema

    def release(self, path: str, preserve_missing: bool = False) -> None:
        """Gives up the frame of ``path``, if one is kept."""
        held = self._held.pop((path, preserve_missing), None)
        if held is not None:
            held[1].unpersist()
