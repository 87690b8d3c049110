"""Named catalogue queries on the star-schema tables, with an equivalent SQL text each.

The tables stand in for the catalogue's: orders for events (date, status as type, priority as era), line items for sides,
nations and regions for conflicts and the ones above them, documents for prose, parts for names, embeddings for points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that it equals."""

    def register(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql is not None:
            _sql[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from chronika.plans import catalogue_queries, chain_queries, field_queries, index_queries, reconcile_queries, refresh_queries, registry_queries, replay_queries, relational_queries, source_queries, sourcing_queries, text_queries, time_space_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
