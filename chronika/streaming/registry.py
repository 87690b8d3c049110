"""Registries that follow a folder: each newer good file becomes the whole table, as a new generation.

A file holds one JSON object, key to value. Of the files of a micro-batch the newest good one counts, if it is newer than the
one that stands; broken and late files change nothing. A generation's rows are written by Spark, and its line in the
manifest last, so readers see a generation whole or not at all. A batch that runs again finds its own line and does
nothing, or writes the same rows over an unfinished attempt: generations count good loads, not attempts. Only the facts of
a load (path, time, number) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "generation int, batch long, path string, modified timestamp, n long"


@dataclass(frozen=True)
class FollowedRegistry:
    """Rows lie under path/rows/generation=N, the manifest under path/manifest. value_schema: the type of a value."""

    spark: SparkSession
    path: str
    value_schema: str

    def manifest(self) -> DataFrame:
        """(generation, batch, path, modified, n) of each good load."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def generation(self) -> int:
        """The generation that stands; 0 before the first good file."""
        return self.manifest().agg(F.max("generation")).first()[0] or 0

    def rows(self, generation: int | None = None) -> DataFrame:
        """(key, value, generation) of the generation that stands, or of an earlier one."""
        number = self.generation() if generation is None else generation
        schema = f"key string, value {self.value_schema}"
        empty = self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(f"{self.path}/rows/generation={number}") if number else empty
        return found.withColumn("generation", F.lit(number))

    def parsed(self, files: DataFrame) -> DataFrame:
        """(path, modified, entries) of whole-file texts; files that are no object of such values are left out."""
        # Within brackets, as a parser would not look at what follows a whole object.
        held = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<map<string,{self.value_schema}>>")
        good = F.when(F.size(held) == 1, F.try_element_at(held, F.lit(1)))
        return files.select("path", "modified", good.alias("entries")).filter(F.col("entries").isNotNull() & ~F.exists(F.map_values("entries"), lambda v: v.isNull()))

    def load(self, files: DataFrame, batch: int) -> int | None:
        """Take the newest good file of a batch; the new generation, or None if nothing changes."""
        files = files.persist()
        try:
            done = self.manifest()
            if not done.filter(F.col("batch") == batch).isEmpty():
                return None
            newest = self.parsed(files).agg(F.max(F.struct("modified", "path")).alias("m")).first()["m"]
            if newest is None:
                return None
            stands = done.agg(F.max(F.struct("modified", "path")).alias("m"), F.max("generation").alias("g")).first()
            if stands["m"] is not None and (newest["modified"], newest["path"]) <= (stands["m"]["modified"], stands["m"]["path"]):
                return None
            number = (stands["g"] or 0) + 1
            chosen = self.parsed(files).filter((F.col("path") == newest["path"]) & (F.col("modified") == F.lit(newest["modified"]))).limit(1)
            target = f"{self.path}/rows/generation={number}"
            chosen.select(F.explode("entries").alias("key", "value")).write.mode("overwrite").parquet(target)
            line = self.spark.read.schema(f"key string, value {self.value_schema}").parquet(target).agg(F.count("*").alias("n"))
            facts = line.select(F.lit(number).cast("int").alias("generation"), F.lit(batch).cast("long").alias("batch"), F.lit(newest["path"]).alias("path"), F.lit(newest["modified"]).alias("modified"), "n")
            facts.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
            return number
        finally:
            files.unpersist()

    def follow(self, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Follow a folder. Without an interval the files that are there are taken, and the query ends."""
        stream = self.spark.readStream.format("text").option("wholetext", True).load(folder)
        files = stream.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
        writer = files.writeStream.foreachBatch(lambda batch, number: self.load(batch, number) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
