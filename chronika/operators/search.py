"""Full-text, fuzzy, nearest-point and commander search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import text
from chronika.functions.dates import let
from chronika.sources.staging import written


def search_blob(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def sanitize(query: str) -> list[str]:
    """The prefix terms of a query: dashes, slashes and underscores part words; letters, digits and apostrophes stay."""
    kept = re.sub(r"[^A-Za-z0-9'À-ɏ\s]", "", re.sub(r"[-/_]", " ", query))
    return kept.split()


def words(blob: Column) -> Column:
    """The folded tokens of a text, in order."""
    return parted(text.fold(blob))


def parted(folded: Column) -> Column:
    return F.filter(F.split(folded, r"[^\p{L}\p{N}']+"), lambda w: w != "")


def tokens(rows: DataFrame, id_col: str, blob: Column) -> DataFrame:
    """The inverted index (token, id, tf), to be stored sorted by token, so that prefixes skip row groups; a single search over texts needs none."""
    return rows.select(F.col(id_col).alias("id"), F.explode(words(blob)).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def begins(term: str):
    return lambda token: F.startswith(token, F.lit(term))


def folded_terms(terms: Sequence[str]) -> list[str]:
    return sorted({t.lower() for t in terms})


def term_counts(rows: DataFrame, id_col: str, blob: Column, terms: Sequence[str]) -> DataFrame:
    """(id, length, tf0, tf1, ...) of each text: its tokens, and how many of them each prefix term begins. One scan, no shuffle; a text is folded and split once."""
    begun = lambda w, t: F.size(F.filter(w, begins(t))).cast("bigint")
    counted = let(words(blob), lambda w: F.struct(F.size(w).cast("bigint").alias("length"), *(begun(w, t).alias(f"tf{i}") for i, t in enumerate(folded_terms(terms)))))
    return rows.select(F.col(id_col).alias("id"), counted.alias("_c")).select("id", "_c.*")


def prefix_scan(rows: DataFrame, id_col: str, blob: Column, terms: Sequence[str]) -> DataFrame:
    """Ids of the texts in which every term begins some token; none without a term."""
    folded = folded_terms(terms)

    def all_begin(w: Column) -> Column:
        out = F.lit(bool(folded))
        for t in folded:
            out = out & F.exists(w, begins(t))
        return out

    return rows.filter(let(words(blob), all_begin)).select(F.col(id_col).alias("id"))


def prefix_match(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids for which every term begins some token."""
    folded = folded_terms(terms)
    if not folded:
        return index.select("id").limit(0)
    hit = F.lit(False)
    for t in folded:
        hit = hit | F.startswith("token", F.lit(t))
    found = [F.max(F.startswith("token", F.lit(t)).cast("int")).alias(f"t{i}") for i, t in enumerate(folded)]
    rows = index.filter(hit).groupBy("id").agg(*found)
    for i in range(len(folded)):
        rows = rows.filter(F.col(f"t{i}") == 1)
    return rows.select("id")


def bm25(index: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that match all prefix terms; higher is better.

    One aggregation by document gives its length and the terms' frequencies; the totals over it are one broadcast row.
    """
    folded = folded_terms(terms)
    hits = [F.sum(F.when(F.startswith("token", F.lit(t)), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(folded)]
    return ranked(index.groupBy("id").agg(F.sum("tf").alias("length"), *hits), len(folded), k1, b)


def bm25_scan(rows: DataFrame, id_col: str, blob: Column, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same over texts without an index: each text counts its own tokens, and these few numbers are written, as totals come before scores. Texts without a token count for nothing."""
    return ranked(written(term_counts(rows, id_col, blob, terms)).filter("length > 0"), len(folded_terms(terms)), k1, b)


def ranked(docs: DataFrame, n: int, k1: float, b: float, sizes: DataFrame | None = None) -> DataFrame:
    """(id, score) of rows (id, length, tf0, ...) with n terms that all stand in them; nothing without a term.

    sizes: one row (docs, mean) of all documents, if those given are only the ones that hold a term.
    """
    if not n:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    found = [F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(n)]
    if sizes is None:
        totals = docs.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *found)
    else:
        totals = docs.agg(*found).crossJoin(F.broadcast(sizes))
    totals = F.broadcast(totals)
    score, matching = F.lit(0.0), F.lit(True)
    for i in range(n):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("docs") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        matching = matching & (tf > 0)
    return docs.crossJoin(totals).filter(matching).select("id", score.alias("score"))


def name_distance(query: str, name: Column) -> Column:
    """Least normalised edit distance of the query to a name or one of its words; 0 if the name holds it."""
    q = query.lower()
    low = F.lower(name)
    share = lambda x: F.levenshtein(F.lit(q), x) / F.greatest(F.lit(len(q)), F.length(x), F.lit(1))
    return F.when(F.contains(low, F.lit(q)), 0.0).otherwise(F.least(share(low), F.array_min(F.transform(F.split(low, " "), share))))


def fuzzy(rows: DataFrame, query: str, name_col: str, most: float = 0.34) -> DataFrame:
    return rows.withColumn("distance", F.round(name_distance(query, F.col(name_col)), 6)).filter(F.col("distance") <= most)


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows found, or those of the fallback if there are none; decided when it runs."""
    none = found.limit(1).agg((F.count("*") == 0).alias("_none"))
    return found.unionByName(fallback.crossJoin(F.broadcast(none)).filter("_none").drop("_none"))


def nearest(rows: DataFrame, lat: float, lng: float, k: int, lat_col: str = "lat", lng_col: str = "lng", tie: str = "id") -> DataFrame:
    """The k rows nearest in the plane of degrees; a top-k report."""
    d = F.pow(F.col(lat_col) - lat, F.lit(2)) + F.pow(F.col(lng_col) - lng, F.lit(2))
    return rows.withColumn("distance", d).orderBy("distance", tie).limit(k)


def commander_search(sides: DataFrame, name: str) -> DataFrame:
    """(battle_id, role): led if the name stands in the first of any side's commanders, else served."""
    low = F.lower("commander")
    hit = sides.filter(F.contains(low, F.lit(name.lower())))
    led = F.contains(F.split(low, ",")[0], F.lit(name.lower()))
    return hit.groupBy("battle_id").agg(F.when(F.bool_or(led), "led").otherwise("served").alias("role"))


def rewrite(query: Column, nicknames: dict[str, str]) -> Column:
    """A nickname's full form, or the query."""
    if not nicknames:
        return query
    pairs = F.create_map(*(F.lit(x) for p in nicknames.items() for x in p))
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(query))), query)
