"""Token counts that follow edits without encoding whole texts again.

A counted text is cut into pre-tokens. A segment tree over them holds characters and tokens of
each subtree. An edit finds its pre-tokens by descending the tree, takes up splitting a little
before the edit (far enough that nothing earlier could have looked into the edited part), and
stops as soon as a new boundary falls on an old one behind the edit: from there on splitting goes
as before. Only the pre-tokens between are encoded, and the sums on their paths are updated.

Edits of a document are applied in order; offsets are in characters of the text as it then is.
Offsets beyond the text are cut to it; an edit without effect changes nothing, nor does one whose start
or end is null, which is no edit and is not counted. Null texts count as empty, null edits as none. Each row is counted by itself, repeated ids too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronika.llm.bpe import ByteBpe, default_tokenizer_path, tokenizer
from chronika.llm.common import ship_package, text_chunks

#: Pre-tokens that a leaf may hold after edits; a fuller one is dealt to leaves of its own, without encoding anything.
CROWDED = 256
ADDRESS = re.compile(r"[\w.+-]++@?"), re.compile(r"[\w-]+(?:\.[\w-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses. A run of characters is taken whole, so that long runs without an @ take linear time."""
    local, domain = ADDRESS
    at = 0
    while m := local.search(text, at):
        at = m.end()
        if text[at - 1] == "@" and (rest := domain.match(text, at)):
            at = rest.end()
            yield m.start(), at


#: What a masking pass over personal data and secrets replaces, and by what; addresses go first, as <email>.
MASKS = [
    (re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), "<ip>"),
    (re.compile(r"\b(?=\w*\d)(?=\w*[A-Za-z])[A-Za-z0-9_]{16,}\b"), "<secret>"),
    (re.compile(r"\+?\d[\d() -]{6,}\d"), "<number>"),
]
Edit = tuple[int, int, str]


def mask_edits(text: str) -> list[Edit]:
    """Edits that mask addresses and what MASKS finds, last first, so that the offsets of the input hold."""
    found: list[Edit] = []
    taken = np.zeros(len(text) + 1, bool)
    for spans, by in ((emails(text), "<email>"), *((map(re.Match.span, p.finditer(text)), by) for p, by in MASKS)):
        for start, end in spans:
            if not taken[start:end].any():
                taken[start:end] = True
                found.append((start, end, by))
    return sorted(found, reverse=True)


class SumTree:
    """Sums of two numbers a leaf over all subtrees of a complete binary tree."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = 1 << max(0, (len(chars) - 1).bit_length())
        sums = np.zeros((2, 2 * self.leaves), np.int64)
        sums[0, self.leaves : self.leaves + len(chars)] = chars
        sums[1, self.leaves : self.leaves + len(tokens)] = tokens
        width = self.leaves
        while width > 1:
            level = sums[:, width : 2 * width]
            sums[:, width // 2 : width] = level[:, ::2] + level[:, 1::2]
            width //= 2
        self.chars, self.tokens = sums

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, and where this leaf starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if offset - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.leaves, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


class CountedText:
    """A text, its pre-tokens and its token count under edits."""

    def __init__(self, text: str, bpe: ByteBpe):
        self.bpe = bpe
        self.context = 3 + max([0, *map(len, bpe.special)])
        self.encoded = 0  # characters that were encoded, the first time included
        self._build(text)

    def _pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for k, part in enumerate(self.bpe.special_split.split(text) if self.bpe.special_split else [text]):
            if k % 2:
                out.append(part)
            elif part:
                out += self.bpe.split(part)
        return out

    def _counts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each pre-token."""
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(len, map(self.bpe.cache.__getitem__, pieces)), np.int64, len(pieces)) // 4
        for special in self.bpe.special:
            if special in pieces:
                tokens[[p == special for p in pieces]] = 1
        self.encoded += int(chars.sum())
        return chars, tokens

    def _build(self, text: str) -> None:
        #: What each leaf holds: one pre-token, or after edits several or none; the counts of each of several.
        self.slots: list[str | list[str]] = self._pieces(text) or [""]
        self.several: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tree = SumTree(*self._counts(self.slots))

    def _spread(self) -> None:
        """One leaf for each pre-token again, from the counts at hand."""
        n = len(self.slots)
        first = self.tree.leaves
        single = [sums[first : first + n] for sums in (self.tree.chars, self.tree.tokens)]
        counts, at = ([], []), 0
        slots: list[str | list[str]] = []
        for slot in sorted(self.several):
            for c, whole, parts in zip(counts, single, self.several[slot]):
                c += [whole[at:slot], parts]
            slots += [*self.slots[at:slot], *self.slots[slot]]
            at = slot + 1
        chars, tokens = (np.concatenate([*c, whole[at:]]) for c, whole in zip(counts, single))
        slots += self.slots[at:]
        held = [i for i, s in enumerate(slots) if s]
        self.slots, self.several = [slots[i] for i in held] or [""], {}
        self.tree = SumTree(chars[held], tokens[held])

    @property
    def n_tokens(self) -> int:
        return int(self.tree.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.tree.chars[1])

    @property
    def text(self) -> str:
        return "".join(s if isinstance(s, str) else "".join(s) for s in self.slots)

    def replace(self, start: int, end: int, new: str) -> None:
        total = self.n_chars
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        if not total:
            self._build(new)
            return
        first, begin = self.tree.find(min(max(0, start - self.context), total - 1))
        grow = 4
        while True:
            # Old slots from `first` on, until some lie behind the edit and its context.
            old, at, last, behind = [], begin, first, 0
            edges = {}
            while last < len(self.slots) and behind < grow:
                edges.setdefault(at, last)
                held = self.slots[last]
                old.append(held if isinstance(held, str) else "".join(held))
                at += len(old[-1])
                behind += at >= end + self.context
                last += 1
            before = "".join(old)
            region = before[: start - begin] + new + before[end - begin :]
            pieces = self._pieces(region)
            if last == len(self.slots):
                break
            shift = len(new) - (end - start)
            here, stop = 0, None
            for k, p in enumerate(pieces):
                if here > len(region) - self.context:
                    break
                place = begin + here - shift
                if here >= start - begin + len(new) and place >= end and place in edges and edges[place] > first:
                    stop = k, edges[place]
                    break
                here += len(p)
            if stop:
                pieces, last = pieces[: stop[0]], stop[1]
                break
            grow *= 2
        for slot in range(first + 1, last):
            if self.slots[slot]:
                self.slots[slot] = ""
                self.several.pop(slot, None)
                self.tree.put(slot, 0, 0)
        chars, tokens = self._counts(pieces)
        self.slots[first], self.several[first] = pieces, (chars, tokens)
        self.tree.put(first, int(chars.sum()), int(tokens.sum()))
        if len(pieces) > CROWDED:
            self._spread()


def edited_counts(docs: DataFrame, find_edits: Callable[[str], list[Edit]] = mask_edits, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_chars, n_chars_encoded_again) of every row.

    Edits come from the column edits_col (array of structs start, end, text) or from find_edits(text).
    """
    ship_package(docs.sparkSession)
    path = path or default_tokenizer_path()
    names = ["id", "n_tokens", "n_edits", "n_tokens_after", "n_chars", "n_chars_encoded_again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part, texts in text_chunks(batches):
            given = part.column(2).to_pylist() if edits_col else None
            rows = []
            for i, t in enumerate(texts):
                counted = CountedText(t or "", bpe)
                n, chars, encoded = counted.n_tokens, counted.n_chars, counted.encoded
                edits = [(e["start"], e["end"], e["text"] or "") for e in given[i] or [] if e and e["start"] is not None and e["end"] is not None] if edits_col else find_edits(t or "")
                for e in edits:
                    counted.replace(*e)
                rows.append((n, len(edits), counted.n_tokens, chars, counted.encoded - encoded))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if edits_col:
        columns.append(F.col(edits_col).cast("array<struct<start:int,end:int,text:string>>").alias("edits"))
    return docs.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)
