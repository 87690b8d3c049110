"""The event catalogue: four tables, their schemas, flat and nested forms, readers and file sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def schema(text: str) -> T.StructType:
    """A flat schema from 'name type, name type'; needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in text.split(","))])


EVENTS = schema(
    "id string, name string, date string, year int, date_start string, date_end string, lat double, lng double, era string, war string, battle_type string, victor string,"
    "summary string, significance string, source string, source_id string, verified int, wikipedia_title string, wikidata_date string, wikidata_end string, wikidata_precision int,"
    "wikidata_end_precision int, wikidata_conflict string, wikidata_instance_of string, wikidata_checked string, infobox_checked string, coord_checked string, infobox_date string,"
    "infobox_partof string, coord_source string, created_at string, updated_at string"
)
SIDES = schema("battle_id string, side_index int, name string, commander string, strength string, casualties string")
REFERENCES = schema("battle_id string, ref_type string, title string, author string, year int, url string, note string")
ALIASES = schema("battle_id string, alias_index int, name string, by_text string")
REMOVED = schema("qid string, reason string, kept_id string")
LEAN = ("id", "name", "year", "date", "date_start", "date_end", "lat", "lng", "era", "war", "battle_type", "victor", "verified", "wikipedia_title")


def conform(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """The columns of a schema in its order: missing ones added, missing texts as '', missing numbers as 0."""
    have = {c.lower(): c for c in df.columns}

    def column(f: T.StructField) -> Column:
        value = F.col(f"`{have[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        return F.coalesce(value, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)).alias(f.name)

    return df.select(*(column(f) for f in wanted))


@dataclass(frozen=True)
class Catalog:
    """The tables as DataFrames; operators return changed copies."""

    events: DataFrame
    sides: DataFrame
    references: DataFrame
    aliases: DataFrame
    removed: DataFrame

    TABLES = ("events", "sides", "references", "aliases", "removed")

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Catalog:
        schemas = dict(zip(cls.TABLES, (EVENTS, SIDES, REFERENCES, ALIASES, REMOVED)))
        return cls(**{k: conform(tables[k], s) if k in tables else spark.createDataFrame([], s) for k, s in schemas.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls.of(spark, **{t: spark.read.parquet(f"{path}/{t}") for t in cls.TABLES})

    def save(self, path: str) -> None:
        """Events are clustered by year, so that year filters skip files and row groups."""
        self.events.repartitionByRange(F.col("year"), F.col("id")).sortWithinPartitions("year", "id").write.mode("overwrite").parquet(f"{path}/events")
        for t in self.TABLES[1:]:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")

    def with_(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    def without_orphans(self) -> Catalog:
        """Children whose event is gone go too."""
        ids = self.events.select(F.col("id").alias("battle_id"))
        keep = lambda df: df.join(ids, "battle_id", "left_semi")
        return self.with_(sides=keep(self.sides), references=keep(self.references), aliases=keep(self.aliases))


def nest_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str], name: str) -> DataFrame:
    """Parents with an array of their children, ordered by the given columns; an empty array without any."""
    fields = [*order, *(c for c in children.columns if c not in order and c != child_key)]
    arrays = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(arrays.schema[name].dataType)
    return parents.join(arrays, parent_key, "left").withColumn(name, F.coalesce(name, empty))


def nested(catalog: Catalog) -> DataFrame:
    """One document an event, with sides, references and aliases."""
    out = nest_children(catalog.events, catalog.sides, "id", "battle_id", ["side_index"], "sides")
    out = nest_children(out, catalog.references, "id", "battle_id", ["ref_type", "title"], "references")
    return nest_children(out, catalog.aliases, "id", "battle_id", ["alias_index"], "aliases")


def by_id(catalog: Catalog, event_id: str) -> DataFrame:
    one = Catalog(catalog.events.filter(F.col("id") == event_id), *(t.filter(F.col("battle_id") == event_id) for t in (catalog.sides, catalog.references, catalog.aliases)), catalog.removed)
    return nested(one)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """The rows of some keys (position, key) in the order of these."""
    return rows.join(ids.select(position, key), key).orderBy(position)


def random_row(rows: DataFrame, seed: int) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(1)


def lean(rows: DataFrame, columns: Sequence[str] = LEAN) -> DataFrame:
    return rows.select(*columns)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one object or an array of objects each; other keys are ignored."""
    texts = spark.read.text(path, wholetext=True).select(F.btrim("value", F.lit(" \t\r\n\ufeff")).alias("value"))
    many = texts.filter(F.startswith("value", F.lit("["))).select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("d"))
    one = texts.filter(F.startswith("value", F.lit("{"))).select(F.from_json("value", schema).alias("d"))
    return many.union(one).filter("d is not null").select("d.*")


def read_json_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A file that holds one object of objects or arrays, as rows (key, value); a broken file gives no rows."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, "value")).filter("value is not null")


def json_keys(spark: SparkSession, path: str) -> DataFrame:
    """The top-level keys of a file that holds one object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("key"))


def read_replays(spark: SparkSession, path: str, phase_schema: str) -> DataFrame:
    """(id, phase_index, phase) of a replay registry; a phase's index is its position."""
    rows = read_json_map(spark, path, f"struct<title:string,phases:array<{phase_schema}>>", "id")
    return rows.select("id", F.col("value.title").alias("title"), F.posexplode("value.phases").alias("phase_index", "phase"))


def regex_rows(spark: SparkSession, path: str, pattern: str, name: str = "value") -> DataFrame:
    """All first groups of a pattern in text files."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias(name))


def decode_arcs(arcs: DataFrame, scale: tuple[float, float], translate: tuple[float, float]) -> DataFrame:
    """Delta-encoded arcs (arc, i, dx, dy) as points (arc, i, lng, lat): running sums within an arc."""
    from pyspark.sql import Window

    w = Window.partitionBy("arc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return arcs.select("arc", "i", (F.sum("dx").over(w) * scale[0] + translate[0]).alias("lng"), (F.sum("dy").over(w) * scale[1] + translate[1]).alias("lat"))


def query_bindings(responses: Sequence[DataFrame]) -> DataFrame:
    """Recorded responses of graph queries united; the first gives the columns, later ones may lack some."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), responses)


def cached_rows(cache: DataFrame, keys: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of a cache table (namespace, key_hash, value) for keys (key); keys are stored by their SHA-1."""
    asked = keys.withColumn("key_hash", F.sha1("key"))
    mine = cache.filter(F.col("namespace") == namespace)
    return asked.join(mine.select("key_hash", "value"), "key_hash"), asked.join(mine, "key_hash", "left_anti")
