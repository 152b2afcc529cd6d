"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark item if some region of it is within
``EDIT_RATE`` x (item length) edits of the whole item, both read in lower case
with white space collapsed. An alignment of m characters with at most e edits
keeps at least m + 1 - q(e + 1) of the item's q-grams, all on diagonals that
lie at most e apart; so every such region shows that many shared q-grams in one
of the overlapping bands of 2(e + 1) diagonals, e + 1 apart. Bands that reach the count are the only
regions that are aligned, by banded edit distance with free ends in the
document. q is 8, or 4 or 2 for items so short that the count would not be positive.

The item table is the stated query set: it is read in blocks of at most
``BLOCK_CHARS`` characters, each block is sent to all tasks and run against all
documents, and a second block starts from rows written to the shared folder, so that a worker
holds one index whatever the number of items. Whole texts are searched, in
windows that overlap by the longest region an item can have: memory does not grow
with a text beyond the text itself. Time grows with the number of shared q-grams, so an item of one
repeated character against a text of the same is the slowest case.

Null or empty texts match nothing, nor do null or empty items. Items under 10 characters
allow no edits, as the rate says. Equal items are reported each. Every row is judged by its
own text: rows with a null or repeated doc_id get their own answers. An empty benchmark
leaves all documents clean. Extra columns of ``documents`` pass through ``remove`` unread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.llm.batches import filter_batches, map_batches
from cohesia.session import Scratch

#: Lengths of q-grams; an item uses the first for which the lemma's count is positive.
Q = (8, 4, 2)
EDIT_RATE = 0.10
BLOCK_CHARS = 8_000_000
#: Characters of a window of a text (more where items are so long), and shared q-grams counted at once.
WINDOW, AT_ONCE = 60_000, 1_000_000
#: Counters of a window's bands that are held densely; beyond, the bands that occur are sorted.
_CELLS = 2_000_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
Hit = tuple[int, int, int, int]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _grams(text: str, q: int) -> np.ndarray:
    """One unsigned 64-bit number for each q-gram: its characters, folded to 64 / q bits each."""
    codes = _codes(text)
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    if q == 8:
        raw = (codes ^ (codes >> np.uint32(8)) * np.uint32(31)).astype(np.uint8)
    else:
        raw = codes.astype(np.uint16) if q == 4 else codes
    return np.ascontiguousarray(np.ndarray(len(codes) - q + 1, dtype="<u8", buffer=raw.tobytes(), strides=(8 // q,)))


def edits_allowed(m: int, rate: float = EDIT_RATE) -> int:
    return math.floor(rate * m + 1e-9)


def gram_length(m: int, rate: float = EDIT_RATE) -> int:
    """The q of an item of m characters; 0 if it is found as a whole."""
    e = edits_allowed(m, rate)
    found = next((q for q in Q if m >= q * (e + 1)), 0)
    if not found and e:
        raise ValueError(f"an edit rate of {rate} is too high for items of {m} characters")
    return found


class Index:
    """Items of a block, by the length of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE) -> None:
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        q_of = [gram_length(len(t), rate) for _, t in self.items]
        self.whole = [k for k, q in enumerate(q_of) if not q]
        self.parts = [GramIndex([(k, self.items[k][1]) for k, of in enumerate(q_of) if of == q], q, rate) for q in Q if q in q_of]

    def search(self, raw: str | None, best: bool = True) -> list[Hit]:
        """(item position, start, end, edits) of each item that a whole text has: its best region, or any if not ``best``."""
        text = normal(raw)
        out = {k: (k, at, at + len(self.items[k][1]), 0) for k in self.whole if (at := text.find(self.items[k][1])) >= 0}
        for part in self.parts:
            out |= part.search(text, best)
        return [out[k] for k in sorted(out)]


class GramIndex:
    """Q-grams of items (position, text) for one q."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q, self.names, self.texts = q, [k for k, _ in items], [t for _, t in items]
        self.budget = np.array([edits_allowed(len(t), rate) for t in self.texts], dtype=np.int64)
        size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.needed = size + 1 - q * (self.budget + 1)
        self.reach = int((size + 2 * self.budget).max()) + 2  # longer than any region, and than what a band looks at
        grams = [_grams(t, q) for t in self.texts]
        key = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(key, kind="stable")
        self.item, self.place, key = item[order], place[order], key[order]
        self.first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.distinct = key[self.first]
        self.many = np.diff(np.r_[self.first, len(key)])
        self.bits = np.uint64(64 - min(26, max(20, int(8 * len(self.distinct)).bit_length())))
        self.seen = np.zeros(1 << 64 - int(self.bits), dtype=bool)
        self.seen[self._slot(self.distinct)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * _MULTIPLY >> self.bits).astype(np.int64)

    def search(self, text: str, best: bool) -> dict[int, Hit]:
        found: dict[int, Hit] = {}
        size = max(WINDOW, 4 * self.reach)
        at = 0
        while True:
            self._window(text[at : at + size], at, best, found)
            if at + size >= len(text):
                return found
            at += size - self.reach

    def _entries(self, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, entry of the index) for shared grams."""
        n = self.many[gram]
        return np.repeat(at, n), np.repeat(self.first[gram] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def _window(self, text: str, offset: int, best: bool, found: dict[int, Hit]) -> None:
        grams = _grams(text, self.q)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        if not len(at):
            return
        gram = np.minimum(np.searchsorted(self.distinct, grams[at]), len(self.distinct) - 1)
        real = self.distinct[gram] == grams[at]
        at, gram = at[real], gram[real]
        if not len(at):
            return
        total = np.cumsum(self.many[gram])
        cuts = np.searchsorted(total, np.arange(AT_ONCE, int(total[-1]), AT_ONCE))
        pieces = list(zip(np.split(at, cuts), np.split(gram, cuts), strict=True))

        def strips(some_at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(item, strip) of shared grams: strips are e + 1 diagonals wide, so any e + 1 diagonals lie in two neighbours, a band."""
            pos, entry = self._entries(some_at, some)
            item = self.item[entry]
            return item, (pos - self.place[entry]) // (self.budget[item] + 1)

        known = [strips(*x) for x in pieces] if len(pieces) == 1 else None
        ends = [(int(x.min()), int(x.max())) for _, x in known or map(lambda x: strips(*x), pieces)]
        least, wide = min(x for x, _ in ends), max(x for _, x in ends) - min(x for x, _ in ends) + 3
        dense = len(self.texts) * wide <= _CELLS
        count = np.zeros(len(self.texts) * wide if dense else 0, dtype=np.int64)
        cell, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for item, strip in known or map(lambda x: strips(*x), pieces):
            here = strip + item * wide + (1 - least)
            if dense:
                count += np.bincount(here, minlength=len(count))
            else:
                more, n = np.unique(np.concatenate([here, here - 1]), return_counts=True)
                cell, back = np.unique(np.r_[cell, more], return_inverse=True)
                times = np.bincount(back, np.r_[times, n]).astype(np.int64)
        if dense:
            count[:-1] += count[1:].copy()  # band b: strips b and b + 1
            bands = np.flatnonzero(count >= np.repeat(self.needed, wide))
        else:
            bands = cell[times >= self.needed[cell // wide]]
        codes = None
        for c in bands.tolist():
            k = c // wide
            name, e, m = self.names[k], int(self.budget[k]), len(self.texts[k])
            if name in found and (not best or found[name][3] == 0):
                continue
            exact = text.find(self.texts[k])
            if exact >= 0:
                found[name] = (name, offset + exact, offset + exact + m, 0)
                continue
            lead = (c - k * wide - 1 + least) * (e + 1)  # the band's first diagonal
            # the lemma counts the item's q-grams, each once
            a, b = np.searchsorted(at, (lead, lead + 2 * (e + 1) + m))
            pos, entry = self._entries(at[a:b], gram[a:b])
            mine = (self.item[entry] == k) & ((pos - self.place[entry] - lead) // (2 * (e + 1)) == 0)
            if len(np.unique(self.place[entry[mine]])) < self.needed[k]:
                continue
            if codes is None:
                codes = _codes(text).astype(np.int64)
            hit = align(_codes(self.texts[k]).astype(np.int64), codes, lead - e, lead + 3 * e + 2, e)
            if hit and (name not in found or hit[2] < found[name][3]):
                found[name] = (name, offset + hit[0], offset + hit[1], hit[2])


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of the whole item against any region of text, on diagonals low to high: (start, end, edits)."""
    m, n, width = len(item), len(text), high - low + 1
    far = np.int64(1 << 30)
    diagonal = np.arange(low, high + 1)
    steps = np.arange(width)
    cost = np.where((diagonal >= 0) & (diagonal <= n), 0, far)  # row 0: a region may begin anywhere
    start = diagonal.copy()
    # characters that the band can reach, -1 outside the text; row i uses those from i - 1 on
    reach = np.full(width + m, -1, dtype=np.int64)
    first, last = max(0, low), min(n, high + m)
    reach[first - low : last - low] = text[first:last]
    down, begun = np.full(width, far), np.zeros(width, dtype=np.int64)
    for i in range(1, m + 1):
        near = reach[i - 1 : i - 1 + width]
        cross = cost + (near != item[i - 1])
        cross[near < 0] = far
        down[:-1] = cost[1:] + 1  # an item character is missing from the text
        begun[:-1] = start[1:]
        take = down < cross
        new = np.where(take, down, cross)
        # extra text characters: running minimum along the row
        slope = new - steps
        run = np.minimum.accumulate(slope)
        origin = np.maximum.accumulate(np.where(slope == run, steps, 0))
        cost, start = run + steps, np.where(take, begun, start)[origin]
        if low + i < 0 or high + i > n:
            cost[(diagonal + i < 0) | (diagonal + i > n)] = far
        if cost.min() > budget:
            return None
    k = int(cost.argmin())
    return int(start[k]), int(diagonal[k] + m), int(cost[k])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in order of item_id; one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _by_blocks(rows: DataFrame, benchmark: DataFrame, rate: float, step: Callable[[DataFrame, Callable[[], Index], bool], DataFrame]) -> DataFrame:
    """``step`` for each block of items in turn (and whether it is the last); rows are written between blocks, so that no worker holds two indices."""
    scratch, held = Scratch(rows.sparkSession), None
    blocks = _blocks(benchmark)
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        shared = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS characters and one item at most
        rows = step(rows, lambda shared=shared: Index(shared.value, rate), after is None)
        if after:
            rows = scratch.keep(rows)
            scratch.drop(held)
            held = rows
        block = after
    return rows


def _searched(rows: DataFrame, load: Callable[[], Index], last: bool) -> DataFrame:
    """Adds the items of one block to each row's list of (item_id, start, end, edits); the text goes with the last block."""

    def make():
        index = load()

        def step(batch):
            known, texts = batch.column("found").to_pylist(), batch.column("text")
            more = [[(index.items[k][0], *where) for k, *where in index.search(t)] for t in texts.to_pylist()]
            named = [[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in some] for some in more]
            return {"doc_id": batch.column("doc_id"), "text": texts, "found": [a + b for a, b in zip(known, named, strict=True)]}

        return step

    return map_batches(rows, make, f"doc_id long, {'' if last else 'text string, '}found array<struct<item_id: long, start: long, end: long, edits: long>>")


def found_items(documents: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id and found (an array of item_id, start, end, edits; places are characters of the normalised text) for every row."""
    none = F.array().cast("array<struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>>")
    return _by_blocks(documents.select("doc_id", "text", none.alias("found")), benchmark, rate, _searched).select("doc_id", "found")


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits: the best region of every item found in a document."""
    return found_items(documents, benchmark, rate).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items, item_ids (sorted list). Nothing is shuffled."""
    ids = F.sort_array(F.array_distinct(F.transform("found", lambda f: f["item_id"])))
    return found_items(documents, benchmark).select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def remove(documents: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The documents without any benchmark item, columns unchanged; nothing is shuffled."""

    def step(rows: DataFrame, load: Callable[[], Index], last: bool) -> DataFrame:
        def make():
            index = load()
            return lambda batch: [not index.search(t, best=False) for t in batch.column("text").to_pylist()]

        return filter_batches(rows, make)

    return _by_blocks(documents, benchmark, rate, step)
