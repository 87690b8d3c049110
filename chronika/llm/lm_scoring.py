"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target text and one of background text, share one vocabulary, order and
smoothing, so only what they were counted on tells them apart. A document's score is its loss a
token under the background model less that under the target model: positive is nearer to the target.
A document is never scored by counts of its own: what it gave to a model is taken off first.

Tokens are runs of letters and digits (ASCII lower-cased; all bytes beyond ASCII) and runs of other
visible characters; the vocabulary is all of them. Every token and every bigram is counted, exactly
but for KEY_BITS-bit hashes, over all rows; nothing is capped, and no table of counts comes to the
driver or goes to a task whole. Documents lie in chunks of CHUNK_BYTES, or one longer document, in
files bucketed by chunk, so texts go through no shuffle. A chunk sends each of its distinct tokens,
contexts and bigrams once, with its counts, to the shards of the count table; a shard adds them up and
answers each chunk with the sums of what it sent, and the chunk is scored with these. Chunks and
shards grow in number with the input; what a chunk sends, as sorted and packed keys, is smaller than
its texts.

Null and empty texts have no tokens and score 0. A model without other documents is smoothed to the
uniform one. Repeated rows count and are scored each, so a row that occurs twice is known by its
copy; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import Scratch, bucketed, free_memory, packed_blocks, partitions, ship_package
from chronika.llm.suffix_dedup import BYTE_VALUE, POWERS, U64, mixed

CHUNK_BYTES = 8 << 20  # of text in a chunk
SHARD_BYTES = 16 << 20
START = np.uint64(0x9E3779B97F4A7C15)
UNIGRAM, CONTEXT, PAIR = 0, 1, 2
KEY_BITS = 52
MIX = 0.6
ALPHA = 0.5
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0: blank, 1: letter or digit, 2: other.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, token hash) of all tokens of some texts."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    kind = KIND[data]
    new = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    start, end = new, np.append(new[1:], len(data))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    up, down = POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[LOWER[data]] * down[: len(data)], out=sums[1:])
    value = mixed((sums[end] - sums[start]) * up[start] ^ (end - start).astype(U64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return np.searchsorted(ends, start, side="right"), value


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Some texts at a time as bytes."""
    for batch in batches:
        raws = [r or b"" for r in batch.column(column).cast(pa.binary()).to_pylist()]
        start = held = 0
        for i, r in enumerate(raws):
            if i > start and held + len(r) > CHUNK:
                yield batch.slice(start, i - start), raws[start:i]
                start, held = i, 0
            held += len(r)
        if start < len(raws):
            yield batch.slice(start), raws[start:]


def keys(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, keys of token, context and bigram) of each token; the low two bits of a key tell which. A text starts after a start mark."""
    found, start, held = [], 0, 0
    for i, r in enumerate([*raws, b""]):
        if i == len(raws) or i > start and held + len(r) > CHUNK:
            if start < i:
                text, value = tokens(raws[start:i])
                found.append((text + start, value))
            start, held = i, 0
        held += len(r)
    text, value = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, U64))
    before = np.append(START, value[:-1])[: len(value)]
    before[np.append(True, text[1:] != text[:-1])[: len(value)]] = START
    kinds = mixed(value, 5), mixed(before, 6), mixed(mixed(before, 7) + value, 8)
    return text, np.stack([k >> U64(64 - KEY_BITS) & ~U64(3) | U64(i) for i, k in enumerate(kinds)])


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each given one among them."""
    distinct, place = np.unique(key.ravel(), return_inverse=True)
    return distinct, place.reshape(key.shape)


def packed(n: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of each, compressed."""
    planes = np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(len(n), 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(n)


SENT = "shard int, chunk long, size int, keys binary, near binary, far binary"
ANSWER = "chunk long, shard int, size int, near binary, far binary"


def arrow(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def sent(chunk: int, key: np.ndarray, near: np.ndarray, far: np.ndarray, shards: int) -> pa.Table:
    """Sorted distinct keys, which are in order of shards, as differences, with their counts in the target (near) and the background (far)."""
    shard = ((key >> U64(KEY_BITS - 32)) * U64(shards) >> U64(32)).astype(np.int64)
    at = np.searchsorted(shard, np.arange(shards + 1))
    return arrow([(s, chunk, b - a, packed(np.diff(key[a:b], prepend=U64(0))), packed(near[a:b]), packed(far[a:b])) for s, (a, b) in enumerate(zip(at, at[1:])) if b > a], SENT)


def counted(chunk: int, raws: list[bytes], near: np.ndarray, far: np.ndarray, shards: int) -> pa.Table:
    """What a chunk sends. near, far: for each text, how often it counts in the target and in the background."""
    text, key = keys(raws)
    distinct, place = places(key)
    sums = [np.bincount(place.ravel(), np.tile(n[text], 3), len(distinct)).astype(np.int64) for n in (near, far)]
    return sent(chunk, distinct, *sums, shards)


def added(table: pa.Table) -> pa.Table:
    """The sums of a shard's counts, back to each chunk that asked; as chunk -1 how many tokens differ and the tokens of both models."""
    sizes = table.column("size").to_pylist()
    key, place = places(np.concatenate([np.cumsum(unpacked(b, n)) for b, n in zip(table.column("keys").to_pylist(), sizes)]))
    sums = []
    for c in ("near", "far"):
        n = np.concatenate([unpacked(b, k) for b, k in zip(table.column(c).to_pylist(), sizes)])
        sums.append(np.bincount(place, n, len(key)).astype(np.int64))
    word = key & U64(3) == UNIGRAM
    shard = table.column("shard")[0].as_py()
    out, at = [(-1, shard, 2, packed(np.array([((sums[0] + sums[1])[word] > 0).sum(), 0])), packed(np.array([n[word].sum() for n in sums])))], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), sizes):
        if chunk >= 0:
            out.append((chunk, shard, n, *(packed(t[place[at : at + n]]) for t in sums)))
        at += n
    return arrow(out, ANSWER)


def own_counts(text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each token and kind of key, how often its text holds the key. n: how many keys there are."""
    both = place + np.int64(n) * text
    _, at, count = np.unique(both.ravel(), return_inverse=True, return_counts=True)
    return count[at].reshape(place.shape)


def score(docs: DataFrame, target: DataFrame | None = None, background: DataFrame | None = None, in_target: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row; losses are nats a token.

    The target is other texts, or the rows of docs whose boolean column in_target is true, or both. The background
    is docs, or other texts if given. A row of docs that is in a model is left out of it for its own loss.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    near = F.lit(False) if in_target is None else F.coalesce(F.col(f"`{in_target}`"), F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), near.alias("near"))
    blocks = bucketed(rows.mapInArrow(packed_blocks("text", CHUNK_BYTES), "b long, id long, near boolean, blob binary"), scratch, "chunks", "b")
    own_far = int(background is None)
    texts = [(df.select(F.col(f"`{text_col}`").cast("string").alias("text")), n) for df, n in ((target, (1, 0)), (background, (0, 1))) if df is not None]
    size = sum(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for df in (rows, *(t for t, _ in texts)))
    shards = max(partitions(spark), -(-size // SHARD_BYTES))

    def read(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
        raws = [pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) if b else b"" for b in table.column("blob").to_pylist()]
        return raws, np.array(table.column("near").to_pylist(), np.int64)

    def ask(table: pa.Table) -> pa.Table:
        try:
            raws, near = read(table)
            return counted(table.column("b")[0].as_py(), raws, near, np.full(len(raws), own_far), shards)
        finally:
            free_memory()

    def tell(near: int, far: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raws, n = [], 0

            def flush() -> list[pa.RecordBatch]:
                return counted(-1, raws, np.full(len(raws), near), np.full(len(raws), far), shards).to_batches()

            for _, more in chunks(batches, 0):
                raws, n = raws + more, n + sum(map(len, more))
                if n > CHUNK_BYTES:
                    yield from flush()
                    raws, n = [], 0
            if raws:
                yield from flush()
            free_memory()

        return run

    def add(table: pa.Table) -> pa.Table:
        try:
            return added(table)
        finally:
            free_memory()

    counts = blocks.groupBy("b").applyInArrow(ask, SENT)
    for df, n in texts:
        counts = counts.union(df.mapInArrow(tell(*n), SENT))
    answers = scratch.saved(counts.groupBy("shard").applyInArrow(add, ANSWER))
    told = answers.filter("chunk = -1").select("near", "far").collect()  # one row a shard
    words = sum(int(unpacked(r.near, 2)[0]) for r in told)
    totals = [sum(int(unpacked(r.far, 2)[i]) for r in told) for i in (0, 1)]

    def losses(n: np.ndarray, total: np.ndarray) -> np.ndarray:
        unigram, context, pair = n
        low = (unigram + ALPHA) / (total + ALPHA * (words + 2))
        mix = np.where(context > 0, MIX, 0.0)
        return -np.log(mix * pair / np.maximum(context, 1) + (1 - mix) * low)

    def judge(docs: pa.Table, found: pa.Table) -> pa.Table:
        try:
            raws, near = read(docs)
            text, key = keys(raws)
            distinct, place = places(key)
            own = own_counts(text, place, len(distinct))
            found = found.sort_by("shard")
            n = np.bincount(text, minlength=len(raws))
            both = []
            for c, total, member in (("near", totals[0], near), ("far", totals[1], np.full(len(raws), own_far))):
                parts = [unpacked(b, k) for b, k in zip(found.column(c).to_pylist(), found.column("size").to_pylist())]
                others = np.concatenate(parts).astype(np.int64)[place] - own * member[text] if parts else np.zeros(place.shape)
                both.append(np.bincount(text, losses(others, (total - n * member)[text]), len(raws)) / np.maximum(n, 1))
            a, b = both
            return pa.table([docs.column("id"), pa.array(n), pa.array(a), pa.array(b), pa.array(b - a)], names=["id", "n_tokens", "target_loss", "background_loss", "score"])
        finally:
            free_memory()

    scored = blocks.groupBy("b").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInArrow(lambda docs, found: judge(docs, found) if len(docs) else EMPTY, "id long, n_tokens long, target_loss double, background_loss double, score double")
    return scratch.kept(scored).withColumnRenamed("id", id_col)


EMPTY = pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())], names=["id", "n_tokens", "target_loss", "background_loss", "score"])
