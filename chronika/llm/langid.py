"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (one to three characters,
lower case, words set off by a boundary mark), in order of frequency. A document gets the same
list, and its distance to a language is the sum, over its n-grams, of how far each stands out of
place in the profile; an n-gram that the profile lacks costs the length of the profile. The
language at the smallest distance wins; equal distances go to the first in alphabetical order.

Profiles are counted over all training rows. Null texts and texts without a letter are `und` with
score 0. Null languages teach nothing. Without any training row everything is `und`. Repeated
rows count each. Ties in frequency are ordered by the n-gram itself, so results do not depend on
how rows are dealt out. Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.llm.common import free_memory, ship_package, text_chunks

PROFILE_SIZE = 300
UND = "und"
LEAST_SCORE = 0.2
BOUNDARY = 1  # stands for the boundary in codes; no letter has this code point


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def char_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with one boundary between words, and the text that each belongs to."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.append(owner, len(texts) - 1) if len(texts) else np.zeros(len(points), np.int64)
    is_letter = letters()[points]
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]  # a boundary after a letter stays, further ones go
    kept[0] = True
    return np.where(is_letter, points, BOUNDARY)[kept], owner[kept]


def dense(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points in order, and each point's place among them."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[points]


def grams(places: np.ndarray, owner: np.ndarray, size: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all one- to three-grams below size + size^2 + size^3, and their owners.

    A gram belongs to the text of a letter in it; boundaries stand at its ends only.
    """
    solid = places != boundary
    a, b, c = places[:-2], places[1:-1], places[2:]
    mid = solid[1:-1]
    pair = solid[:-1] | solid[1:]
    pair_owner = np.where(solid[1:], owner[1:], owner[:-1])
    codes = [places[solid], size + (places[:-1] * size + places[1:])[pair], size + size * size + ((a * size + b) * size + c)[mid]]
    return np.concatenate(codes), np.concatenate([owner[solid], pair_owner[pair], owner[1:-1][mid]])


def global_codes(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The same grams as 63-bit codes of up to three code points, which do not depend on the batch; they keep the order."""
    size = len(alphabet)
    out = np.empty(len(codes), np.int64)
    one, three = codes < size, codes >= size + size * size
    two = ~(one | three)
    out[one] = alphabet[codes[one]]
    x = codes[two] - size
    out[two] = alphabet[x // size] << 21 | alphabet[x % size]
    x = codes[three] - size - size * size
    out[three] = alphabet[x // (size * size)] << 42 | alphabet[x // size % size] << 21 | alphabet[x % size]
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each stands there."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[at], np.diff(np.append(at, len(values)))


def counted(texts: list[str | None], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, count, alphabet) for each group of texts (each text alone by default), sorted by group and code."""
    points, owner = char_stream(texts)
    alphabet, places = dense(points)
    size = len(alphabet)
    codes, owner = grams(places, owner, size, int(np.searchsorted(alphabet, BOUNDARY)))
    span = size + size * size + size**3
    if group is not None:
        owner = group[owner]
    if (int(owner.max(initial=0)) + 1) * span < 1 << 63:
        key, n = runs(np.sort(owner * span + codes))
        return key // span, key % span, n, alphabet
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])))
    return owner[at], codes[at], np.diff(np.append(at, len(codes))), alphabet


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text): summed within each task first, then across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                code = np.concatenate([c for c, _ in held[lang]])
                n = np.concatenate([x for _, x in held[lang]])
                order = np.argsort(code, kind="stable")
                code, n = code[order], n[order]
                at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
                code, n = code[at], np.add.reduceat(n, at) if len(at) else n
                if len(code) < least:
                    held[lang] = [(code, n)]
                    continue
                del held[lang]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "gram", "n"])

        for part, texts in text_chunks(batches):
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            owner, codes, n, alphabet = counted(texts, np.array([place[x] for x in langs]))
            codes = global_codes(codes, alphabet)
            for i, lang in enumerate(names):
                mine = slice(*np.searchsorted(owner, [i, i + 1]))
                held.setdefault(lang, []).append((codes[mine], n[mine]))
                size += mine.stop - mine.start
            if size > 1_500_000:
                yield from flush(400_000)
                size = sum(len(c) for x in held.values() for c, _ in x)
        yield from flush(0)

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(train: DataFrame, size: int = PROFILE_SIZE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of each language, rank 0 first; `size` rows for each distinct lang."""
    ship_package(train.sparkSession)
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return gram_counts(rows).withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Ranker:
    """The profiles of all languages as arrays; size * number of languages entries at most."""

    def __init__(self, found: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({x[0] for x in found})
        self.grams = np.unique(np.array([x[1] for x in found], np.int64))
        self.rank = np.full((len(self.langs), len(self.grams) + 1), size, np.int64)
        row = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, rank in found:
            self.rank[row[lang], np.searchsorted(self.grams, gram)] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        owner, codes, n, alphabet = counted(texts)
        top = int(n.max(initial=0)) + 1
        span = len(alphabet) + len(alphabet) ** 2 + len(alphabet) ** 3
        if len(texts) * top * span < 1 << 63:
            key = np.sort((owner * top + (top - n)) * span + codes)
            owner, codes = key // (top * span), key % span
        else:
            order = np.lexsort((codes, -n, owner))
            owner, codes = owner[order], codes[order]
        starts = np.searchsorted(owner, np.arange(len(texts)))
        rank = np.arange(len(owner)) - starts[owner]
        keep = rank < self.size
        owner, codes, rank = owner[keep], global_codes(codes[keep], alphabet), rank[keep]
        place = np.searchsorted(self.grams, codes)
        known = place < len(self.grams)
        known[known] = self.grams[place[known]] == codes[known]
        place = np.where(known, place, len(self.grams))
        held = np.bincount(owner, minlength=len(texts))
        distance = np.array([np.bincount(owner, np.where(r[place] == self.size, self.size, np.abs(r[place] - rank)), len(texts)) for r in self.rank])
        if not len(self.langs):
            return [UND] * len(texts), np.zeros(len(texts))
        share = distance / np.maximum(held, 1) / self.size
        best = share.argmin(axis=0)
        has = held > 0
        return [self.langs[b] if h else UND for b, h in zip(best, has)], np.where(has, np.clip(1 - share.min(axis=0), 0, 1), 0.0)


def predict(docs: DataFrame, fitted: DataFrame, size: int = PROFILE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row. score: 1 less the mean distance as a share of the greatest one.

    The profiles are broadcast: `size` rows for each language, whatever the corpus.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranker = spark.sparkContext.broadcast(Ranker([(r.lang, r.gram, r["rank"]) for r in fitted.collect()], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            lang, score = ranker.value.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, fitted: DataFrame, size: int = PROFILE_SIZE, text_col: str = "text", langs: Iterable[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns as they are, whose predicted language is one of langs (any learned one by default) with a score of `least` or more.

    `und` is never accepted. A text in no learned language shares few n-grams with any profile: other
    scripts, hexadecimal digits and random letters score below 0.2 (0.16 at most in the tests), prose of a learned language 0.3 and more. No shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranker = spark.sparkContext.broadcast(Ranker([(r.lang, r.gram, r["rank"]) for r in fitted.collect()], size))
    wanted = None if langs is None else frozenset(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text_col):
            lang, score = ranker.value.predict(texts)
            good = [x != UND and (wanted is None or x in wanted) and s >= least for x, s in zip(lang, score)]
            yield part.filter(pa.array(good, pa.bool_()))
        free_memory()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row's id falls into the fold that is not learned from; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
