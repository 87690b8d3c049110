"""Byte-level BPE encoding and decoding with a contiguous rank array per pre-token.

A pre-token is a short byte string. Its parts are held as a contiguous array of token ids with
the merge rank of each adjacent pair beside it. The smallest rank is found by a scan, the
boundary between its two parts is deleted, and the two neighbouring ranks are refreshed, until
no pair has a rank. Pre-tokens over LONG_WORD bytes take the same merges in the same order from
a heap, as repeated scans would cost the square of their length.

Results equal the tokenizers library's for the same file with add_special_tokens=False: special
tokens that stand in a text are recognised, there is no truncation or padding.

Null texts encode as the empty sequence; empty texts too. Repeated rows and repeated doc_ids are
encoded each. Columns beyond the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronika.llm.common import free_memory, ship_package, text_chunks

LONG_WORD = 256
CACHE_WORDS = 300_000
NO_RANK = 1 << 60
#: Fixed: the pre-token pattern that byte-level BPE files with use_regex mean.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of these characters alone (ASCII without separators 1C-1F, Latin letters to U+024F, common
#: punctuation) are split by the same pattern with its classes written out, which is faster.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN_TEXT = re.compile(f"[\x00-\x1b\x20-\x7f{LATIN}\u00a1\u00bf\u2010-\u2027]*")
BLANK = " \\t\\n\\r\\f\\v"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{BLANK}{LATIN}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level BPE files: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class WordCache(dict):
    """Packed ids by pre-token in two generations: a full one becomes the old one, from which words still in use come back."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.merge(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """One tokenizer file; encodes texts to ids and decodes ids to text."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.token_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        of_byte = self.byte_id
        self.first_ranks = [self.merges.get(of_byte[a] << 32 | of_byte[b], NO_RANK) for a in range(256) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.words, self.plain_words = regex.compile(PATTERN), re.compile(PLAIN_PATTERN)
        self.cache = WordCache(self.merge)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        return (self.plain_words if PLAIN_TEXT.fullmatch(text) else self.words).findall(text)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        of_byte, first = self.byte_id, self.first_ranks
        ids = [of_byte[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        rank_of, merged = self.merges.get, self.merged
        ranks = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        ranks.append(NO_RANK)  # of the last part and the end, which nothing joins
        while (lowest := min(ranks)) != NO_RANK:
            at = ranks.index(lowest)
            ids[at] = joined = merged[lowest]
            del ids[at + 1], ranks[at]
            if at + 1 < len(ids):
                ranks[at] = rank_of(joined << 32 | ids[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 32 | joined, NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, k) for i in range(n - 1) if (r := rank_of(k := ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank_of(k := ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, k))
        return [i for i in ids if i >= 0]

    def count(self, word: str) -> int:
        return len(self.cache[word]) // 4

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        packed, out = self.cache.__getitem__, []
        for k, piece in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if k % 2:
                out.append(array("I", [self.special[piece]]).tobytes())
            elif piece:
                out.append(b"".join(map(packed, self.split(piece))))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return list(array("I", self.encode_packed(text)))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One per Python worker and file."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens) of every text; one pass without a shuffle."""
    ship_package(docs.sparkSession)
    path = path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part, texts in text_chunks(batches):
            packed = [bpe.encode_packed(t) for t in texts]
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(counts)], names=["id", "ids", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def encode_rows(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, with ids array<int>, n_tokens and lossless: whether the ids decode to the text.

    A column of docs of one of these names keeps its own; the new one is then called bpe_ids, bpe_n_tokens or bpe_lossless.
    """
    ship_package(docs.sparkSession)
    path = path or default_tokenizer_path()
    made = [(f"bpe_{c}" if c in docs.columns else c, kind) for c, kind in (("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("lossless", T.BooleanType()))]
    schema = T.StructType([*docs.schema, *(T.StructField(name, kind) for name, kind in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part, texts in text_chunks(batches, text_col):
            packed = [bpe.encode_packed(t) for t in texts]
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat)
            same = [bpe.decode(memoryview(x).cast("I")) == (t or "") for x, t in zip(packed, texts)]
            yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(counts), pa.array(same, pa.bool_())], names=[*part.schema.names, *(name for name, _ in made)])
        bpe.cache.clear()  # the worker goes on to other stages
        bpe.cache.old = {}
        free_memory()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give the empty text."""
    ship_package(encoded.sparkSession)
    path = path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and keep only digests of ids and decoded text.

    Columns: id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (UTF-8).
    """
    ship_package(docs.sparkSession)
    path = path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part, texts in text_chunks(batches):
            counts, ids_hex, text_hex = [], [], []
            for t in texts:
                packed = bpe.encode_packed(t)
                ids = memoryview(packed).cast("I")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
