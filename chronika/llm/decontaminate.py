"""Benchmark decontamination by template windows.

Texts become templates: words in lower case, numbers as <num>, a unit after a number as <unit>,
and, in a second template, runs of capitalised words within a sentence as <name>. In a third, capitalised
words that begin a sentence or text are <name> too, so that names may be exchanged there. Windows of
`n` template words are hash-joined with the windows of the benchmark items; an item of fewer words is one
window of its own length, and documents have windows of every length that items have. Windows with fewer than
two plain words say nothing and are left out of both sides, and so is the third template of an item
shorter than a window, as its first word then is a word and not a name. An item is found in a document if, near one alignment, at least `coverage` of its windows
stand there in one of the templates, and the slots agree. Names agree if each name of the item goes
with one in the document and the other way round, without exception. Numbers and units agree if, of
those that come again in the item, at least `coverage` go with the value that each mostly goes with, as
two equal numbers of a question may mean different things and be changed apart. So a question is found
whose numbers, names or units were exchanged throughout, and a text is not that shares a phrase's
shape only.

An item none of whose windows says anything, such as a sum or a bare number, has no template of words to speak
of. It is found where its words, numbers and marks, whatever blanks and case, are a whole line or the
whole text of a document. If it is a sum, that is two numbers and three tokens at least, it is found inside of lines too,
and as a whole line with other numbers, where each number of the item goes with one of the line.

The benchmark goes to the tasks as a hash table in blocks of at most `block_windows` windows, each
of which meets all documents; one block is some 100 MB. Documents are read once a block, not shuffled.

Null and empty texts match nothing, nor do items without any word, number or mark. Repeated
items (item_id) and repeated documents are each judged by themselves. Rows with a null id are
judged too. Columns beyond those named are carried along by `clean` and ignored by `matches`.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import free_memory, ship_package, text_chunks

WINDOW = 5
COVERAGE = 0.8
BLOCK_WINDOWS = 1_000_000
#: Fixed: words that name a unit when they follow a number.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces ton tons tonne tonnes
ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months
year years k c f degree degrees percent pct w kw mw v a hz khz mhz ghz b kb mb gb tb n j kj cal kcal pa kpa bar usd eur gbp dollar dollars
euro euros pound pounds cent cents yen""".split()
SUM = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]")
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:\n]")
U64 = np.uint64
#: Low bits of a token's code: capitalised, unit word, number; a mark has code 0.
CAPITAL, UNIT, NUMBER = 1, 2, 4
FLAGS = U64(7)
PLACE = {"<num>": U64(8 << 8), "<unit>": U64(9 << 8), "<name>": U64(10 << 8)}
FACTORS = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)


def exact(text: str) -> str:
    """A text or line without blanks and case."""
    return "".join(text.lower().split())


def shape(tokens: list[str]) -> tuple[str, ...]:
    """The tokens of a sum with its numbers as slots."""
    return tuple("<num>" if t[0].isdigit() else t for t in tokens)


def one_to_one(pairs: set[tuple[str, str]]) -> bool:
    return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


class TokenCodes(dict):
    """Code of each token: a hash of its lower-case form, low bits telling its kind; the cache is bounded."""

    def __missing__(self, token: str) -> int:
        if token in ".!?:\n":
            code = 0
        else:
            low = token.lower()
            code = xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 7) & ~7 | 1 << 40
            code |= (NUMBER if token[0].isdigit() else 0) | (UNIT if low in UNIT_WORDS else 0) | (CAPITAL if token[0].isupper() else 0)
        if len(self) > 200_000:
            self.clear()
        if len(token) <= 64:
            self[token] = code
        return code


UNIT_WORDS = frozenset(UNITS)
CODES = TokenCodes()


class Template:
    """The templates of a text: codes, and for each position the place of its token."""

    def __init__(self, text: str | None):
        self.tokens = TOKEN.findall(text or "")
        raw = np.fromiter(map(CODES.__getitem__, self.tokens), U64, len(self.tokens))
        word = raw != 0
        starts = np.append(True, ~word[:-1]) if len(raw) else word
        self.at = np.flatnonzero(word)
        raw, starts = raw[word], starts[word]
        number = (raw & U64(NUMBER)) != 0
        unit = (raw & U64(UNIT)) != 0
        unit[1:] &= number[:-1]
        unit[:1] = False
        capital = ((raw & U64(CAPITAL)) != 0) & ~unit
        codes = raw & ~FLAGS
        codes[number] = PLACE["<num>"]
        codes[unit] = PLACE["<unit>"]
        self.plain, self.slot = codes, number | unit
        self.named = self._with(capital & ~starts)
        self.begun = self._with(capital, starts)

    def _with(self, name: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The template with runs of these names; a word at one of the starts stands alone, as it may be no name."""
        if not name.any():
            return None
        follows = np.append(False, name[:-1])
        if starts is not None:
            follows[1:] &= ~(starts[:-1] | starts[1:])
        keep = ~(name & follows)
        return np.where(name, PLACE["<name>"], self.plain)[keep], (self.slot | name)[keep], self.at[keep]

    def kinds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(0: plain, 1: with names, 2: with names at starts too; codes; whether a slot; token places)."""
        yield 0, self.plain, self.slot, self.at
        if self.named is not None:
            yield 1, *self.named
        if self.begun is not None:
            yield 2, *self.begun


def windows(codes: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words, and whether it holds two plain words (one if n is 1)."""
    m = n
    if not m or len(codes) < m:
        return np.zeros(0, U64), np.zeros(0, bool)
    count = len(codes) - m + 1
    value = np.full(count, U64(m))
    plain = np.zeros(count, np.int64)
    for j in range(m):
        value = value + (codes[j : j + count] ^ (codes[j : j + count] >> U64(29))) * FACTORS[j]
        plain += ~slot[j : j + count]
    value ^= value >> U64(31)
    return value, plain >= min(2, m)


class Items:
    """One block of benchmark items as a hash table from window to items and places."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.items = [(i, Template(t)) for i, t in rows]
        self.where: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.total: Counter = Counter()
        lengths = {n}
        for k, (_, t) in enumerate(self.items):
            for kind, codes, slot, _ in t.kinds():
                m = min(n, len(codes))
                if m < n and (kind == 2 or m < 2):
                    continue
                value, says = windows(codes, slot, m)
                self.total[k, kind] = int(says.sum())
                lengths |= {m} if says.any() else set()
                for j in np.flatnonzero(says):
                    self.where[int(value[j])].append((k, kind, int(j)))
        self.exact: dict[str, list[int]] = defaultdict(list)
        for k, (_, text) in enumerate(rows):
            if not any(self.total[k, kind] for kind in range(3)) and (line := exact(text)):
                self.exact[line].append(k)
        self.lengths = sorted(lengths)
        # Sums by their first token, to be found inside of lines, and by their shape, for whole lines with other numbers.
        self.sums: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
        self.shapes: dict[tuple[str, ...], list[tuple[int, list[str]]]] = defaultdict(list)
        for k in sorted({k for ks in self.exact.values() for k in ks}):
            tokens = SUM.findall(rows[k][1].lower())
            if len(tokens) >= 3 and sum(t[0].isdigit() for t in tokens) >= 2:
                self.sums[tokens[0]].append((k, tokens))
                if not any(t[0].isalpha() for t in tokens):
                    self.shapes[shape(tokens)].append((k, tokens))
        self.keys = np.array(sorted(self.where), U64)
        bits = max(16, min(26, 4 + len(self.keys).bit_length()))
        self.low = U64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys & self.low] = True

    def found(self, text: str | None, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item, share of its windows, slots, slots with another value) of each item in the text."""
        t = Template(text)
        best: dict[int, tuple[float, int, int]] = {}
        for kind, codes, slot, at in t.kinds():
            by_item = defaultdict(list)
            for m in self.lengths:
                value, says = windows(codes, slot, m)
                for i in np.flatnonzero(self.table[value & self.low] & says).tolist():
                    for k, kind_, j in self.where.get(int(value[i]), ()):
                        # The plain template of an item without names within sentences may stand in any of the text's.
                        if kind_ == kind or kind_ == 0 and (k, 1) not in self.total:
                            by_item[k, kind_].append((i, j))
            for (k, kind_), hits in by_item.items():
                share, slots, changed = self.aligned(k, kind_, hits, t, at, slot, coverage)
                if share >= coverage and share > best.get(k, (0,))[0]:
                    best[k] = share, slots, changed
        if self.exact and text:
            for line in {exact(text), *map(exact, text.split("\n"))} & self.exact.keys():
                best |= dict.fromkeys(self.exact[line], (1.0, 0, 0))
        if self.sums and text:
            for k, slots, changed in self.sums_in(text):
                if changed < best.get(k, (0.0, 0, slots + 1))[2]:
                    best[k] = 1.0, slots, changed
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]

    def sums_in(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, numbers, changed numbers) of each sum in a line, and of each whole line of a sum's shape."""
        for line in text.lower().split("\n"):
            tokens = SUM.findall(line)
            for i, first in enumerate(tokens):
                for k, wanted in self.sums.get(first, ()):
                    if tokens[i : i + len(wanted)] == wanted:
                        yield k, sum(t[0].isdigit() for t in wanted), 0
            for k, wanted in self.shapes.get(shape(tokens), ()) if self.shapes else ():
                pairs = {(a, b) for a, b in zip(wanted, tokens) if a[0].isdigit()}
                if one_to_one(pairs):
                    slots = [a != b for a, b in zip(wanted, tokens) if a[0].isdigit()]
                    yield k, len(slots), sum(slots)

    def aligned(self, k: int, kind: int, hits: list[tuple[int, int]], t: Template, at: np.ndarray, slot: np.ndarray, coverage: float) -> tuple[float, int, int]:
        """The best alignment: share of windows, and its slots if they agree, else share 0."""
        total = self.total[k, kind]
        if len({j for _, j in hits}) < coverage * total:
            return 0.0, 0, 0
        item = self.items[k][1]
        _, item_codes, _, item_at = next(x for x in item.kinds() if x[0] == kind)
        is_name = item_codes == PLACE["<name>"]
        drift = max(2, total // 5)
        best = (0.0, 0, 0)
        for main, count in Counter(i - j for i, j in hits).most_common():
            if count < coverage * total / (2 * drift + 1):
                break
            near = [(i, j) for i, j in hits if abs(i - j - main) <= drift]
            share = len({j for _, j in near}) / total
            if share < coverage or share <= best[0]:
                continue
            pairs: dict[int, tuple[int, int]] = {}  # of each slot of the item the place in the text that is nearest to the alignment
            for i, j in near:
                off = abs(i - j - main)
                for o in range(min(self.n, len(item_at) - j)):  # an item shorter than a window is one window
                    if slot[i + o] and off < pairs.get(j + o, (drift + 1, 0))[0]:
                        pairs[j + o] = off, i + o
            names, others = set(), defaultdict(Counter)
            changed = 0
            for j, (_, i) in pairs.items():
                a, b = item.tokens[item_at[j]].lower(), t.tokens[at[i]].lower()
                changed += a != b
                if is_name[j]:
                    names.add((a, b))
                else:
                    others[a][b] += 1
            if not one_to_one(names):
                continue
            again = [c for c in others.values() if c.total() > 1]
            if sum(max(c.values()) for c in again) < coverage * sum(c.total() for c in again):
                continue
            best = share, len(pairs), changed
        return best


def benchmark_blocks(benchmark: DataFrame, n: int, block_windows: int, item_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark a block at a time; a block holds at most block_windows words, but for one longer item."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    held, words = [], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        size = r.text.count(" ") + 1
        if held and words + size > block_windows:
            yield Items(held, n)
            held, words = [], 0
        held.append((r.item, r.text))
        words += size
    if held:
        yield Items(held, n)


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(id, item, coverage, n_slots, n_changed): a row for each document and item found in it."""
    spark = docs.sparkSession
    ship_package(spark)
    schema = "id long, item long, coverage double, n_slots int, n_changed int"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    found = spark.createDataFrame([], schema)
    for items in benchmark_blocks(benchmark, n, block_windows, item_col, text_col):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part, texts in text_chunks(batches):
                out = [(i, *x) for i, t in zip(part.column(0).to_pylist(), texts) for x in held.value.found(t, coverage)]
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=["id", "item", "coverage", "n_slots", "n_changed"])

        found = found.union(rows.mapInArrow(run, schema))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item is found; no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    for items in benchmark_blocks(benchmark, n, block_windows, item_col, "text"):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part, texts in text_chunks(batches, text_col):
                yield part.filter(pa.array([not held.value.found(t, coverage) for t in texts], pa.bool_()))
            CODES.clear()  # the worker goes on to other stages
            free_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
