"""Hot-reloaded registries: each arriving file replaces the table as a whole and raises its generation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Registry:
    """The rows of the newest good file, and how many loads succeeded."""

    def __init__(self, value_schema: str):
        self.value_schema = value_schema
        self.generation = 0
        self.rows: DataFrame | None = None

    def parse(self, files: DataFrame) -> DataFrame:
        """(path, modified, key, value) of whole-file texts that hold one object; broken files give no rows."""
        parsed = F.from_json("value", f"map<string,{self.value_schema}>")
        return files.select("path", "modified", F.explode(parsed).alias("key", "value")).filter("value is not null")

    def replace(self, batch: DataFrame, _epoch: int) -> None:
        """The newest file of a batch that parses takes the table's place; else the old one stays."""
        rows = self.parse(batch)
        newest = rows.agg(F.max(F.struct("modified", "path")).alias("m"))
        latest = rows.join(F.broadcast(newest), F.struct("modified", "path") == F.col("m"), "left_semi").select("key", "value")
        found = latest.collect()  # a registry: some hundred entries of one file
        if found:
            self.rows = batch.sparkSession.createDataFrame(found, f"key string, value {self.value_schema}")
            self.generation += 1


def watch(spark: SparkSession, folder: str, registry: Registry, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Follow a folder of JSON files. Without an interval all files present are taken once."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    writer = files.writeStream.foreachBatch(registry.replace).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class ResponseCache:
    """Bodies by request and data version; cleared as a whole when full."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, {}

    def get(self, request: str, version: tuple, make: Callable[[], DataFrame]) -> tuple[str, str]:
        """(body, tag). The body is a small result as JSON."""
        key = request, version
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            body = json.dumps([r.asDict(recursive=True) for r in make().collect()], default=str, sort_keys=True)
            self.held[key] = body, hashlib.sha256(body.encode()).hexdigest()[:16]
        return self.held[key]


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, *keys: str) -> DataFrame:
    """An extension: event-time windows with a watermark, which drops what comes later than `late`."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
