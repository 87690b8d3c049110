"""Written intermediate tables, for jobs that go on until nothing changes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; in local mode without one, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def written(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: later steps read them and carry no lineage on."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


class Steps:
    """Tables of one job in Parquet files of the shared checkpoint folder, for jobs whose tables outgrow their use: each can be dropped."""

    def __init__(self, spark: SparkSession):
        checkpoint_folder(spark)
        self.spark, self.paths = spark, {}
        self.root = f"{spark.sparkContext.getCheckpointDir()}/chronika-{uuid.uuid4().hex}"

    def saved(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that were saved here; other tables are left alone."""
        for table in tables:
            if id(table) in self.paths:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[0])
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def told_once(rows: DataFrame, given: Mapping[str, Column], tell: Callable[[Column], Column], name: str) -> DataFrame:
    """The rows with a column `name`, which tell makes of a struct of the given values: once for each distinct set of values, not for each row.

    For long expressions over values that come again, such as dates. The distinct sets are written, so that their size is known to the join.
    """
    keyed = rows.withColumn("_given", F.struct(*(c.alias(k) for k, c in given.items())))
    each = keyed.select("_given").distinct().select("_given", tell(F.col("_given")).alias(name))
    return keyed.join(Steps(rows.sparkSession).saved(each), "_given", "left").drop("_given")
