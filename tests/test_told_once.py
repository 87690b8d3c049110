"""Long expressions are worked out once for each distinct set of values."""

import pandas as pd
from pyspark.sql import functions as F

from chronika.plans import registry
from chronika.sources.staging import told_once

SF = "/root/testdata/sf0.001"


def test_each_set_of_values_is_told_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(s: pd.Series) -> pd.Series:
        seen.add(len(s))
        return s.fillna("none") + "!"

    rows = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("v"))
    found = told_once(rows, {"v": F.col("v"), "n": F.col("id") % 1}, lambda g: F.pandas_udf(tell, "string")(g["v"]), "said")
    assert found.columns == ["id", "v", "said"]
    assert sorted(tuple(r) for r in found.select("id", "said").collect()) == [(i, f"v{i % 3}!" if i % 3 else "none!") for i in range(600)]
    assert seen.value == 3


def test_template_dates_reads_each_input_once(spark):
    plan = registry.queries()["template_dates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
