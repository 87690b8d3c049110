"""Removal of repeated byte strings across documents by prefix-free parsing.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller id
is removed. Strings never cross documents and are judged on the input.

The parse. A rolling hash of `TRIGGER` bytes runs over each text; the trigger of a string of
`length` bytes is the position in it with the smallest hash, the leftmost of equals. Equal strings
have equal triggers, whatever stands around them, and every string has one. The strings of one
trigger follow each other and make up a phrase, and consecutive phrases overlap by `length` - 1
bytes, so each string lies in one phrase. So the order of two suffixes of the corpus to `length`
bytes is decided within the dictionary of distinct phrases: sort the suffixes of the dictionary, and
neighbours that agree in `length` bytes are equal strings. Among equal ones the parse decides, the
places of each phrase in order of documents; its first place is all that is asked for.

1. triggers: which trigger hashes stand in more than one document;
2. phrases: for each phrase at such a trigger, its first place in the parse (later documents lose all
   its strings), and whether another phrase shares the trigger;
3. dictionary: each phrase that shares its trigger is sent once, as bytes, to the part of the
   dictionary of its trigger; there the suffixes that begin strings are sorted by their bytes (a
   suffix array of the part), and the first place of each class of equal strings goes back.

Strings of a trigger that more than CROWDED phrases share are dealt out one by one, by a hash of
their bytes, so that no part of the dictionary grows with a hot passage. Strings are compared by
their bytes; phrases and triggers only meet by hashes, phrases by 96 bits.

Documents lie in blocks of BLOCK_BYTES or one longer document, with the places of their phrases. A
block sends each of its distinct triggers and phrases once, so a passage that stands in a third of
all documents costs one entry a block and step, and a step's answers come back to the blocks that
asked. Blocks are files bucketed by block in the checkpoint folder, so texts are shuffled in no
step. The result is written there too, then the blocks and answers are deleted.

Null texts count as empty. Texts under `length` bytes are kept whole. Rows that repeat a doc_id are
one document with several texts: they never remove from each other. Rows with a null id neither
remove nor lose anything. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronika.llm.common import Scratch, bucketed, free_memory, partitions, ship_package

LENGTH = 50
TRIGGER = 24
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 19
PART_BYTES = 8 << 20  # of input for each part of the dictionary
CROWDED = 4096
NO_DOC = np.iinfo(np.int64).max
U64 = np.uint64
LOW = U64(0xFFFFFFFF)

_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Powers:
    """Powers of the base and of its inverse, as many as the longest piece needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(BASE_INVERSE, k, 1 << 64))])
        return self.up, self.down


POWERS = Powers()


class Sums:
    """Rolling hashes of any piece of some bytes, whatever its place in them."""

    def __init__(self, data: np.ndarray):
        self.up, down = POWERS.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUE[data] * down[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.up[start]

    def grams(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.up[: len(self.sums) - size]


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in columns sorted together."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def least_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the smallest document of each."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    at = starts_of(keys)
    return keys[at], np.minimum.reduceat(docs, at) if len(at) else docs


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and its place."""
    place = np.searchsorted(sorted_keys, keys)
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), place
    place = np.minimum(place, len(sorted_keys) - 1)
    return sorted_keys[place] == keys, place


def counting(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... n[i] - 1 for each i in turn: the i and the number."""
    n = n.astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


# The parse.


def small(length: int) -> type:
    """Type of the number of strings of a phrase and of places in it."""
    return np.uint8 if length - TRIGGER < 255 else np.uint16


def cut(pieces: list[bytes], length: int) -> list[bytes]:
    """For each piece its phrases in order, as two packed arrays: how many strings, and where in the phrase the trigger begins."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    strings = np.maximum(sizes - length + 1, 0)
    if not strings.sum():
        return [b""] * len(pieces)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    grams = mixed(Sums(data).grams(TRIGGER))
    low = U64((1 << max(1, int(len(data)).bit_length())) - 1)
    least = grams & ~low | np.arange(len(grams), dtype=U64)
    del grams
    window, span = length - TRIGGER + 1, 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    piece, offset = counting(strings)
    at = offset + (np.cumsum(sizes) - sizes)[piece]
    owner = (least[at] & low).astype(np.int64)
    first = starts_of(owner, piece)
    n = np.diff(np.append(first, len(at))).astype(small(length))
    lead = (owner[first] - at[first]).astype(small(length))
    bounds = np.searchsorted(piece[first], np.arange(len(pieces) + 1))
    return [n[a:b].tobytes() + lead[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def cut_texts(raws: list[bytes], length: int, chunk: int = CHUNK_BYTES) -> list[bytes]:
    """The phrases of each text. A long text is cut in pieces that overlap by length - 1 bytes."""
    pieces, owner, found, held = [], [], [[] for _ in raws], 0

    def flush() -> None:
        for i, x in zip(owner, cut(pieces, length)):
            found[i].append(x)
        pieces.clear()
        owner.clear()

    for i, raw in enumerate(raws):
        for offset in range(0, max(1, len(raw) - length + 1), chunk):
            piece = raw[offset : offset + chunk + length - 1]
            if pieces and held + len(piece) > 2 * chunk:
                flush()
                held = 0
            pieces.append(piece)
            owner.append(i)
            held += len(piece)
    flush()
    halves = [[(x[: len(x) // 2], x[len(x) // 2 :]) for x in xs] for xs in found]
    return [b"".join(h for h, _ in xs) + b"".join(t for _, t in xs) for xs in halves]


# What goes between blocks and the parts of the dictionary: packed arrays.

PACKED = "bucket int, b long, kind int, h binary, x binary, doc binary, n binary, data binary"
NAMES = [f.split()[0] for f in PACKED.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
ASK_TRIGGER, ASK_SHARED, ASK_PHRASE, ASK_STRINGS = range(4)
SHARED_TRIGGER, SEVERAL, LEAST, STRINGS = range(4)


class Packer:
    """Rows of PACKED."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, bucket: int, b: int, kind: int, **columns) -> None:
        self.rows.append((bucket, b, kind, *(None if (v := columns.get(c)) is None else v if isinstance(v, bytes) else v.tobytes() for c in NAMES[3:])))

    def deal(self, bucket: np.ndarray, b: int, kind: int, **columns) -> None:
        """Entries with their buckets; bytes of the column data come as a list."""
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        data = columns.pop("data", None)
        columns = {c: v[order] for c, v in columns.items()}
        at = starts_of(bucket)
        for s, e in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist()):
            more = {} if data is None else {"data": b"".join(data[i] for i in order[s:e].tolist())}
            self.add(int(bucket[s]), b, kind, **{c: v[s:e] for c, v in columns.items()}, **more)

    def answer(self, bucket: int, kind: int, of: np.ndarray, blocks: np.ndarray, **columns) -> None:
        order = np.argsort(of, kind="stable")
        of = of[order]
        at = starts_of(of)
        for s, e in zip(at.tolist(), np.append(at[1:], len(of)).tolist()):
            self.add(bucket, int(blocks[of[s]]), kind, **{c: v[order[s:e]] for c, v in columns.items()})

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(NAMES)
        return pa.table([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def buffers(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind))


def trigger_keys(said: pa.Table) -> np.ndarray:
    """Bucket and low bits of the triggers in some answers."""
    parts = [np.frombuffer(h, np.uint32).astype(U64) | U64(k << 32) for h, k in zip(said.column("h").to_pylist(), said.column("bucket").to_pylist())]
    return np.concatenate(parts or [np.zeros(0, U64)])


class Block:
    """The documents of one block, their phrases, and what the earlier steps have answered.

    Of each phrase occurrence: text: its place in the block; start: of its first string in the text; n: how
    many strings; key: bucket and low bits of its trigger; phrase: hash of its bytes, trigger included.
    """

    def __init__(self, docs: pa.Table, said: pa.Table | None, length: int, bits: int, chunk: int = CHUNK_BYTES):
        unzip = zstandard.ZstdDecompressor().decompress
        self.length, self.bits, self.chunk = length, bits, chunk
        self.b = docs.column("b")[0].as_py()
        ids = docs.column("id").to_pylist()
        self.raws = [unzip(x) if x else b"" for x in docs.column("blob").to_pylist()]
        self.ids = np.array([NO_DOC if i is None else i for i in ids], np.int64)
        self.said = said
        found = list(self._chunks(docs.column("cuts").to_pylist()))
        kinds = (np.int32, np.int64, small(length), U64, U64)
        self.text, self.start, self.n, self.key, self.phrase = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, k) for k in kinds)

    def _chunks(self, cuts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """The phrases of some texts, or of part of a long one, at a time."""
        kind, held, group = small(self.length), 0, []
        for i, (raw, packed) in enumerate(zip(self.raws, cuts)):
            n, lead = np.frombuffer(packed, kind).reshape(2, -1)
            if not len(n):
                continue
            ends = np.cumsum(n, dtype=np.int64)
            start = ends - n
            parts = starts_of(start // self.chunk)
            for a, b in zip(parts.tolist(), np.append(parts[1:], len(n)).tolist()):
                begin, end = int(start[a]), int(ends[b - 1]) + self.length - 1
                if group and held + end - begin > 2 * self.chunk:
                    yield self._hashed(group)
                    group, held = [], 0
                group.append((i, begin, raw[begin:end], start[a:b], n[a:b], lead[a:b]))
                held += end - begin
        if group:
            yield self._hashed(group)

    def _hashed(self, group: list[tuple]) -> tuple[np.ndarray, ...]:
        texts, begins, raws, starts, ns, leads = zip(*group)
        sums = Sums(np.frombuffer(b"".join(raws), np.uint8))
        sizes = np.array([len(r) for r in raws], np.int64)
        count = [len(x) for x in ns]
        start, n, lead = np.concatenate(starts), np.concatenate(ns), np.concatenate(leads)
        at = start + np.repeat(np.cumsum(sizes) - sizes - np.array(begins, np.int64), count)
        trigger = mixed(sums.at(at + lead, TRIGGER), 0x5851F42D4C957F2D)
        size = n.astype(np.int64) + (self.length - 1)
        phrase = mixed(sums.at(at, size) ^ mixed(trigger, 1) + size.astype(U64))
        key = trigger >> U64(64 - self.bits) << U64(32) | trigger & LOW
        return np.repeat(np.array(texts, np.int32), count), start, n, key, phrase

    def answers(self, kind: int) -> pa.Table:
        return of_kind(self.said, kind)

    def docs(self, which: np.ndarray) -> np.ndarray:
        return self.ids[self.text[which]]

    def repeated(self) -> np.ndarray:
        """The phrases whose trigger stands in several documents."""
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], self.docs(order)
        at = starts_of(key)
        here = key[at][np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)] if len(at) else key
        return np.flatnonzero(member(np.union1d(here, trigger_keys(self.answers(SHARED_TRIGGER))), self.key)[0])

    def dictionary(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases among the chosen ones, the smallest document here and anywhere that has each."""
        phrase, here = least_of(self.phrase[chosen], self.docs(chosen))
        said = self.answers(LEAST)
        x, elsewhere = buffers(said, "x", U64), buffers(said, "doc", np.int64)
        least = here.copy()
        there, place = member(phrase, x)
        least[place[there]] = np.minimum(least[place[there]], elsewhere[there])
        return phrase, here, least

    def shared_by(self, keys: np.ndarray) -> np.ndarray:
        """Of triggers: 0 if one phrase has it, 1 if several have, 2 if it is crowded."""
        said = self.answers(SEVERAL)
        known, flag = trigger_keys(said), buffers(said, "n", np.uint8)
        order = np.argsort(known, kind="stable")
        known, flag = known[order], flag[order]
        there, place = member(known, keys)
        return np.where(there, flag[place], 0) if len(known) else np.zeros(len(keys), np.uint8)

    def bytes_of(self, which: np.ndarray, skip: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of n strings of each phrase after some."""
        start = self.start[which] + skip
        end = start + n + (self.length - 1)
        return [self.raws[t][s:e] for t, s, e in zip(self.text[which].tolist(), start.tolist(), end.tolist())]


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def send_triggers(block: Block) -> pa.Table:
    key = np.unique(block.key)
    out = Packer()
    out.deal((key >> U64(32)).astype(np.int64), block.b, ASK_TRIGGER, h=key.astype(np.uint32))
    return out.table()


def send_phrases(block: Block) -> pa.Table:
    chosen = block.repeated()
    phrase, key, doc = block.phrase[chosen], block.key[chosen], block.docs(chosen)
    order = np.lexsort((phrase, key))
    phrase, key, doc = phrase[order], key[order], doc[order]
    at = starts_of(key, phrase)
    if not len(at):
        return Packer().table()
    least = np.minimum.reduceat(doc, at)
    phrase, key = phrase[at], key[at]
    out = Packer()
    first = starts_of(key)
    last = np.append(first[1:], len(key)) - 1
    out.deal((key[first] >> U64(32)).astype(np.int64), block.b, ASK_SHARED, h=key[first].astype(np.uint32), x=phrase[first], doc=phrase[last], n=(last - first + 1).astype(np.uint32))
    out.deal(bucket_of(phrase, block.bits), block.b, ASK_PHRASE, h=key.astype(np.uint32), x=phrase, doc=least)
    return out.table()


def send_strings(block: Block) -> pa.Table:
    chosen = block.repeated()
    phrase, here, least = block.dictionary(chosen)
    found, first = np.unique(block.phrase[chosen], return_index=True)
    which = chosen[first[here == least]]
    doc = least[here == least]
    flag = block.shared_by(block.key[which])
    out = Packer()
    whole = flag == 1
    w, n = which[whole], block.n[which[whole]]
    none = np.zeros(len(w), n.dtype)
    out.deal((block.key[w] >> U64(32)).astype(np.int64), block.b, ASK_STRINGS, x=block.phrase[w], doc=doc[whole], h=none, n=n, data=block.bytes_of(w, none, n.astype(np.int64)))
    crowded = flag == 2
    of, skip = counting(block.n[which[crowded]])
    w = which[crowded][of]
    data = block.bytes_of(w, skip, np.ones(len(w), np.int64))
    hashed = np.array([xxhash.xxh64_intdigest(s) for s in data], U64)
    out.deal(bucket_of(hashed, block.bits), block.b, ASK_STRINGS, x=block.phrase[w], doc=doc[crowded][of], h=skip.astype(small(block.length)), n=np.ones(len(w), small(block.length)), data=data)
    return out.table()


def removed_strings(block: Block) -> list[np.ndarray]:
    """For each document of the block, the starts of its removed strings."""
    chosen = block.repeated()
    phrase, _, least = block.dictionary(chosen)
    found: list[list[np.ndarray]] = [[] for _ in block.raws]
    if len(chosen):
        place = np.searchsorted(phrase, block.phrase[chosen])
        doc = block.docs(chosen)
        late = chosen[doc > least[place]]
        of, skip = counting(block.n[late])
        text, start = block.text[late][of], block.start[late][of] + skip
        said = block.answers(STRINGS)
        x, skip, elsewhere = buffers(said, "x", U64), buffers(said, "h", small(block.length)), buffers(said, "doc", np.int64)
        order = np.argsort(x, kind="stable")
        x, skip, elsewhere = x[order], skip[order], elsewhere[order]
        first = chosen[doc == least[place]]
        begin = np.searchsorted(x, block.phrase[first])
        of, k = counting(np.searchsorted(x, block.phrase[first], side="right") - begin)
        k += begin[of]
        gone = block.docs(first[of]) > elsewhere[k]
        of, k = first[of[gone]], k[gone]
        text = np.concatenate([text, block.text[of]])
        start = np.concatenate([start, block.start[of] + skip[k]])
        order = np.argsort(text, kind="stable")
        text, start = text[order], start[order]
        at = starts_of(text)
        for s, e in zip(at.tolist(), np.append(at[1:], len(text)).tolist()):
            found[text[s]].append(start[s:e])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def spans(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Maximal runs of covered bytes as rows (begin, end)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    starts = np.unique(starts)
    new = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + length))
    last = np.append(new[1:] - 1, len(starts) - 1)
    return np.column_stack([starts[new], np.minimum(starts[last] + length, size)])


def entries(table: pa.Table, per: str, width: int, *columns: tuple[str, type]) -> tuple[np.ndarray, ...]:
    """Place of the block of each entry among the table's distinct blocks, these blocks, and the packed columns."""
    blocks, place = np.unique(np.array(table.column("b").to_pylist(), np.int64), return_inverse=True)
    sizes = [len(h) // width for h in table.column(per).to_pylist()]
    return (np.repeat(place, sizes), blocks, *(buffers(table, c, k) for c, k in columns))


def meet_triggers(table: pa.Table) -> pa.Table:
    """Back to each block: its triggers that another block has too."""
    of, blocks, h = entries(table, "h", 4, ("h", np.uint32))
    key = np.sort(h.astype(U64) << U64(32) | of.astype(U64))
    h, of = (key >> U64(32)).astype(np.uint32), (key & LOW).astype(np.int64)
    at = starts_of(h)
    n = np.diff(np.append(at, len(h)))
    shared = np.repeat(n > 1, n)
    out = Packer()
    out.answer(table.column("bucket")[0].as_py(), SHARED_TRIGGER, of[shared], blocks, h=h[shared])
    return out.table()


def meet_phrases(table: pa.Table, most: int = CROWDED) -> pa.Table:
    """Back to each block: its triggers that several phrases share, and its phrases that a smaller document elsewhere has."""
    out, bucket = Packer(), table.column("bucket")[0].as_py()
    asked = of_kind(table, ASK_SHARED)
    if len(asked):
        of, blocks, h, lo, hi, n = entries(asked, "h", 4, ("h", np.uint32), ("x", U64), ("doc", U64), ("n", np.uint32))
        order = np.argsort(h, kind="stable")
        of, h = of[order], h[order]
        at = starts_of(h)
        several = np.minimum.reduceat(lo[order], at) != np.maximum.reduceat(hi[order], at)
        flag = np.where(several, 1 + (np.add.reduceat(n[order].astype(np.int64), at) > most), 0)
        flag = np.repeat(flag, np.diff(np.append(at, len(h)))).astype(np.uint8)
        told = flag > 0
        out.answer(bucket, SEVERAL, of[told], blocks, h=h[told], n=flag[told])
    asked = of_kind(table, ASK_PHRASE)
    if len(asked):
        of, blocks, h, x, doc = entries(asked, "h", 4, ("h", np.uint32), ("x", U64), ("doc", np.int64))
        order = np.lexsort((h, x))
        of, h, x, doc = of[order], h[order], x[order], doc[order]
        at = starts_of(x, h)
        least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(x))))
        told = least < doc
        out.answer(bucket, LEAST, of[told], blocks, x=x[told], doc=least[told])
    return out.table()


def suffix_array(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at the given places in order of their first `length` bytes, and where in it a class of equal ones begins.

    Bytes are compared eight at a time, as big-endian numbers.
    """
    words = [np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[at + k].astype(U64) for k in (*range(0, length - 8, 8), length - 8)]
    order = np.lexsort(words[::-1])
    return order, starts_of(*(w[order] for w in words))


def meet_strings(table: pa.Table, length: int) -> pa.Table:
    """Back to each block: its strings that a smaller document has, and the smallest one."""
    kind = small(length)
    of, blocks, x, doc, skip, n = entries(table, "x", 8, ("x", U64), ("doc", np.int64), ("h", kind), ("n", kind))
    data = buffers(table, "data", np.uint8)
    size = n.astype(np.int64) + (length - 1)
    entry, offset = counting(n)
    order, at = suffix_array(data, (np.cumsum(size) - size)[entry] + offset, length)
    entry, offset = entry[order], offset[order]
    doc = doc[entry]
    least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(doc)))) if len(at) else doc
    told = least < doc
    entry, offset = entry[told], offset[told]
    out = Packer()
    out.answer(table.column("bucket")[0].as_py(), STRINGS, of[entry], blocks, x=x[entry], h=(skip[entry] + offset).astype(kind), doc=least[told])
    return out.table()


def write_blocks(docs: DataFrame, id_col: str, text_col: str, length: int, scratch: Scratch, block: int, chunk: int) -> DataFrame:
    """(b, id, blob, cuts, rest) in files bucketed by block: texts as compressed bytes, their phrases, and all other columns as a struct."""
    spark = docs.sparkSession
    others = [docs[f"`{c}`"] for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), F.struct(F.lit(0).alias("_filler"), *others).alias("rest"))
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("id", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("cuts", T.BinaryType()), rows.schema["rest"]])

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Some rows at a time, as many as hold two chunks of bytes."""
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // (2 * chunk)
        at = starts_of(part)
        for a, b in zip(at.tolist(), np.append(at[1:], len(part)).tolist()):
            yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        b, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch):
                raws = part.column(1).cast(pa.binary()).to_pylist()
                cuts = cut_texts([r if r and i is not None else b"" for r, i in zip(raws, part.column(0).to_pylist())], length, chunk)
                number = []
                for r in raws:
                    size = len(r or b"")
                    if held and held + size > block:
                        b, held = b + 1, 0
                    held += size
                    number.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), part.column(0), pa.array([zip_(r) if r else None for r in raws], pa.binary()), pa.array(cuts, pa.binary()), part.column(2)], names=["b", "id", "blob", "cuts", "rest"])
        free_memory()

    return bucketed(rows.mapInArrow(run, schema), scratch, "blocks", "b")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES, crowded: int = CROWDED) -> DataFrame:
    """Each row with n_bytes, n_removed, n_spans and kept_sha256; with keep_text also the columns of the input.

    The text is then what is left, read as UTF-8; a character that a removed run has cut is dropped. The sizes
    change how the work is dealt out, not the result.
    """
    if length < 2 * TRIGGER:
        raise ValueError(f"length must be {2 * TRIGGER} at least")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    table = write_blocks(docs, id_col, text_col, length, scratch, block_bytes, chunk_bytes)
    slim = table.select("b", "id", "blob", "cuts")
    blocks = table.select("b").distinct().count()
    bits = max(6, (max(2 * partitions(spark), blocks * block_bytes // PART_BYTES) - 1).bit_length())

    def freed(fn, *tables: pa.Table) -> pa.Table:
        """A step on one group, which keeps no memory for the next one."""
        try:
            return fn(*tables)
        finally:
            free_memory()

    def ask(fn):
        return lambda docs, said: freed(lambda: fn(Block(docs, said, length, bits, chunk_bytes)) if len(docs) else Packer().table())

    def meet(fn):
        return lambda asked: freed(fn, asked)

    sent = slim.groupBy("b").applyInArrow(lambda docs: freed(send_triggers, Block(docs, None, length, bits, chunk_bytes)), PACKED)
    said = scratch.saved(sent.groupBy("bucket").applyInArrow(meet(meet_triggers), PACKED))
    for send, answer in ((send_phrases, lambda asked: meet_phrases(asked, crowded)), (send_strings, lambda asked: meet_strings(asked, length))):
        sent = slim.groupBy("b").cogroup(said.groupBy("b")).applyInArrow(ask(send), PACKED)
        said = said.union(scratch.saved(sent.groupBy("bucket").applyInArrow(meet(answer), PACKED)))

    rest = table.schema["rest"].dataType
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if keep_text:
        out = out.add("kept", T.StringType()).add("rest", rest)

    def last(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table([pa.array([], f.type) for f in empty], names=out.names)
        block = Block(docs, said, length, bits, chunk_bytes)
        rows = []
        for raw, starts in zip(block.raws, removed_strings(block)):
            gaps = spans(starts, len(raw), length)
            left, at = [], 0
            for s, e in gaps.tolist():
                left.append(raw[at:s])
                at = e
            kept = b"".join([*left, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(gaps), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
        columns = list(zip(*rows))
        arrays = [docs.column("id"), *(pa.array(c, k) for c, k in zip(columns[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string())))]
        if keep_text:
            arrays += [pa.array(columns[4], pa.string()), docs.column("rest")]
        return pa.table(arrays, names=out.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(out)
    result = (table if keep_text else slim).groupBy("b").cogroup(said.groupBy("b")).applyInArrow(lambda docs, said: freed(last, docs, said), out)
    result = scratch.kept(result)
    digest = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if not keep_text:
        return result.select(*digest)
    columns = [F.col("id").alias(c) if c == id_col else F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    made = [F.col(c).alias(c if c not in docs.columns else f"dedup_{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    return result.select(*columns, *made)
