"""A registry that follows a folder of whole files made of nations: good, broken and late ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.plans.registry import query, table
from chronika.sources.staging import checkpoint_folder
from chronika.streaming.registry import FollowedRegistry


def write_registry(rows: DataFrame, folder: str, value: Column, broken: bool = False) -> None:
    """One file that holds all rows as one object: the format's own shape."""
    whole = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", value)))))
    told = rows.agg(F.concat(whole, F.lit("" if not broken else "}{")).alias("value"))
    told.coalesce(1).write.mode("append").text(folder)


@query("""select 3 as generation, n_name as key, n_nationkey + 300 as start, 2 as region from nation where n_regionkey = 2 union all
select 3, n_name, n_nationkey + 300, 3 from nation where n_regionkey = 3""")
def followed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after five files: the third good one as a whole; a broken one and one without an object change nothing."""
    checkpoint_folder(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/registry-{uuid.uuid4().hex}"
    registry = FollowedRegistry(spark, f"{root}/table", "struct<start:bigint,region:bigint>")
    nations = table(spark, sf_dir, "nation")
    run = lambda: registry.follow(f"{root}/in", f"{root}/checkpoint").awaitTermination()
    value = lambda k: F.struct((F.col("n_nationkey") + 100 * k).alias("start"), F.col("n_regionkey").alias("region"))
    for k, (some, broken) in enumerate((("n_regionkey = 0", False), ("n_regionkey = 1", False), ("n_regionkey = 4", True), ("n_regionkey in (2, 3)", False))):
        write_registry(nations.filter(some), f"{root}/in", value(k), broken)
        run()
    nations.agg(F.lit("[]").alias("value")).coalesce(1).write.mode("append").text(f"{root}/in")
    run()
    return registry.rows().select("generation", "key", "value.*")
