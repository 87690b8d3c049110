"""Every catalogue query that has SQL equals it on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronika.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, (float, np.floating)) and np.isnan(x):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6)
    return int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, (bool, np.bool_)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def test_every_catalogue_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_results_do_not_depend_on_partitioning(spark, tmp_path):
    for t in ("orders", "customer", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("group_summary", "sessionise_equal_keys", "even_sample", "dense_histogram"):
        q = registry.queries()[name]
        assert rows(q(spark, str(tmp_path)).toPandas()) == rows(q(spark, SF).toPandas())
