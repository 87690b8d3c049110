"""Quality classification by compression.

Zstandard dictionaries are built from labelled good and bad text, a pair for each of three views of a
text: its bytes; its outline (runs of lower-case letters as one letter, capitals as A, digits as 0),
which is alike in all languages; and its novelty, the run lengths of words that are new to the text,
known in other company, or known behind the same word, which shows repetition. A view is cut into
blocks, each block is compressed with either dictionary, and the difference of the summed sizes,
divided by their total, tells which dictionary fits better. Blocks keep a long text from teaching the
compressor its own words, which would drown the dictionaries. A logistic curve over the three
differences and nothing else, fitted on labelled documents that built no dictionary, makes the score.

The classifier is fitted on a bounded sample of the labelled rows: of each label, the
`sample_docs` rows of the smallest hashes of their ids, texts over `sample_bytes` left out. All
texts are scored whole. Null and empty texts get the score that the curve gives a text without
any difference. Without labelled rows of both labels every score is 0.5. A doc_id that is
labelled twice counts twice; a null doc_id is never held out and never learned from. Columns beyond
those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import ship_package, text_chunks

SAMPLE_DOCS = 1500
SAMPLE_BYTES = 32_768
LEVEL = 3
THRESHOLD = 0.7


#: One class for lower case (and all bytes beyond ASCII), one for upper case, one for digits.
OUTLINE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
WORD = re.compile(r"\w+|[^\w\s]+|\n")
RUN = re.compile(rb"n+|o+|r+")


def text_bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def outline(text: str) -> bytes:
    return re.sub(rb"a+", b"a", text_bytes(text).translate(OUTLINE))


def novelty(text: str) -> bytes:
    """For each run of words that are new (n), known behind another word (o) or behind the same one (r) its kind and the magnitude of its length; line breaks as they are."""
    known: set = set()
    out = bytearray()
    before = ""
    for w in WORD.findall(text.lower()):
        if w == "\n":
            out += b"\n"
        elif (pair := (before, w)) in known:
            out += b"r"
        else:
            out += b"o" if w in known else b"n"
            known.add(pair)
            known.add(w)
        before = w
    return RUN.sub(lambda m: m[0][:1] + b"%d" % len(m[0]).bit_length(), bytes(out))


#: Views of a text, each with the bytes of its blocks and of its dictionaries.
VIEWS = ((text_bytes, 1024, 262_144), (outline, 256, 16_384), (novelty, 256, 65_536))


@lru_cache(maxsize=8)
def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)


def difference(raw: bytes, block: int, good: bytes, bad: bytes) -> float:
    """The normalised difference of the summed sizes of the blocks with either dictionary; positive: nearer to good."""
    by_good, by_bad = compressor(good).compress, compressor(bad).compress
    blocks = [raw[k : k + block] for k in range(0, len(raw), block)]
    g, b = sum(len(by_good(x)) for x in blocks), sum(len(by_bad(x)) for x in blocks)
    return (b - g) / (b + g) if blocks else 0.0


def features(texts: list[str | None], good: list[bytes], bad: list[bytes]) -> np.ndarray:
    """One row a text: the difference in each view."""
    return np.array([[difference(view(t or ""), block, g, b) for (view, block, _), g, b in zip(VIEWS, good, bad)] for t in texts]).reshape(-1, len(VIEWS))


def dictionary(raws: list[bytes], most: int) -> bytes:
    """Pieces from all over the sample, up to `most` bytes; raw content, so that every size works."""
    raws = [r for r in raws if r]
    each = max(64, most // max(1, len(raws)))
    out, k = bytearray(), 0
    while len(out) < most and any(len(r) > k for r in raws):
        for r in raws:
            out += r[k : k + each]
        k += each
    return bytes(out[:most])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; x gets a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


SCALE = 50.0  # brings the differences near to 1, so that the ridge is slight


class Model:
    """A pair of dictionaries for each view and the curve: some 700 kB whatever the corpus."""

    def __init__(self, good: list[str], bad: list[str]):
        self.weights = None
        if len(good) < 2 or len(bad) < 2:
            return
        self.good, self.bad = ([dictionary([view(t) for t in texts[::2]], most) for view, _, most in VIEWS] for texts in (good, bad))
        x = features(good[1::2] + bad[1::2], self.good, self.bad)
        self.weights = fit_logistic(SCALE * x, np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        x = SCALE * features(texts, self.good, self.bad)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row's id falls into the fold that is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the rows of docs that labels marks 1 (good) or 0 (bad)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).filter("id is not null and label in (0, 1)")
    found = {}
    for label in (1, 0):
        picked = marks.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(2 * sample_docs)
        rows = texts.filter(F.octet_length("text").between(1, sample_bytes)).join(F.broadcast(picked), "id")
        found[label] = [r.text for r in rows.orderBy(F.xxhash64("id"), "id", "text").limit(sample_docs).collect()]
    return Model(found[1], found[0])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row; one pass without a shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            s = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)
