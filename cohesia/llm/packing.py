"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document is tokenised, closed by one separator id and, only if longer than
the capacity, cut into pieces of exactly the capacity (the last may be
shorter). Pieces are then packed by *exact-complement hashing*: the lengths
present are indexed by their single, pair and triple sums. A sequence begins with the
longest piece left; a combination that fills its gap exactly is consumed as often as all
its lengths are available, and where there is none the longest piece that fits goes in and the smaller gap
is looked up again. Best fit, longest first, packs the same pieces, and what it leaves unfilled goes through the index once more;
the plan with the fewest sequences is taken, so none needs more than best fit.

The plan is made over the histogram of lengths, which has at most ``capacity``
entries whatever the input: every consumed combination is a *pattern* with a
number of repetitions. Pieces find their place by their rank among the pieces
of their length, so no task ever sees more than its own rows. Ranks come from
a counter within each partition plus per-(length, partition) offsets; the
pieces are written to the shared folder once, so that ranks never change when
an executor is lost.

Null or empty text: one piece of one separator id. Empty table: no rows.
Repeated rows are packed each. Null ``doc_id`` is passed through. A text is held whole, with
its ids (4 bytes each) and about 40 bytes for each token while the library works on it. Columns other than ``doc_id`` and ``text`` are
not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.llm.batches import map_batches
from cohesia.session import Scratch

CAPACITY = 2048
KNOWN = 500_000

# Letters and numbers of the first 0x180 code points as the vocabulary's pre-tokeniser sees them.
_LATIN = [chr(i) for i in range(0x180)]
_L = "".join(c for c in _LATIN if c.isalpha())
_N = "".join(c for c in _LATIN if c.isnumeric())
_S = "\t\n\x0b\x0c\r \x85\xa0"  # white space only separates
_WORDS = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")
_BEYOND = re.compile("[^\x00-ſ]")
_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts within the first 0x180 code points are cut into pre-tokens here and
    each distinct pre-token is given to the vocabulary's model once; other texts
    go through the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        self.model = self.whole.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: "".join(p for p, _ in byte_level.pre_tokenize_str(c)) for c in _LATIN}
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _BEYOND.search(text) or any(a in text for a in self.added) or not _plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = _WORDS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > KNOWN:
                self.known.clear()
            for word in set(words):
                if word not in self.known:
                    tokens = self.model.tokenize("".join(map(self.shown.__getitem__, word)))
                    self.known[word] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
            return b"".join(map(self.known.__getitem__, words))


def _plain(text: str) -> bool:
    """Whether normal form C and lower-casing act on single characters (a capital I with dot does not)."""
    return "İ" not in text


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Pieces of all documents with, in each partition, their rank among pieces of the same length."""

    def make():
        words = tokenizer(tokenizer_path)
        end = np.array([separator], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        wide = 4 * capacity

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = words.ids(text or "") + end
                for k, at in enumerate(range(0, len(raw), wide)):
                    piece = raw[at : at + wide]
                    n = len(piece) // 4
                    for name, value in (("doc_id", doc), ("piece", k), ("start", at // 4), ("length", n), ("ids_crc32", zlib.crc32(piece)), ("part", part), ("local", seen[n])):
                        out[name].append(value)
                    seen[n] += 1
            return out

        return step

    return map_batches(documents.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, repetitions


class SumIndex:
    """Available lengths and their sums: which lengths there are, and for each sum how many pairs of available lengths make it.

    A triple sum is a length and an indexed pair sum. The index changes when the last piece of a length is used.
    """

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for n, count in histogram.items():
            self.left[n] = count
        self.single = self.left > 0
        self.pairs = np.zeros(capacity + 1, dtype=np.int64)  # ordered pairs (a, b) with a + b equal to the sum
        for n in np.flatnonzero(self.single):
            self.pairs[n:] += self.single[: capacity + 1 - n]

    def use(self, combo: tuple[int, ...]) -> int:
        """Take the combination as often as it is available."""
        need = Counter(combo)
        times = min(int(self.left[n]) // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * times
            if times and not self.left[n]:
                self.single[n] = False
                self.pairs[n:] -= 2 * self.single[: len(self.pairs) - n]
                if 2 * n < len(self.pairs):
                    self.pairs[2 * n] -= 1
        return times

    def _enough(self, combo: tuple[int, ...], taken: Counter) -> bool:
        return all(self.left[n] >= k + taken[n] for n, k in Counter(combo).items())

    def filling(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly beside those taken, long ones first."""
        if self.single[gap] and self._enough((gap,), taken):
            return (gap,)
        if self.pairs[gap] and (two := self._pair(gap, gap, taken)):
            return two
        for n in np.flatnonzero(self.single[:gap] & (self.pairs[gap:0:-1] > 0))[::-1].tolist():
            if 3 * n < gap:  # n is the longest of the three
                return None
            taken[n] += 1
            two = self._pair(gap - n, n, taken) if self._enough((), taken) and self.left[n] >= taken[n] else None
            taken[n] -= 1
            if two:
                return (n, *two)
        return None

    def _pair(self, gap: int, most: int, taken: Counter) -> tuple[int, int] | None:
        half, top = (gap + 1) // 2, min(gap - 1, most)
        if top < half:
            return None
        both = self.single[half : top + 1] & self.single[gap - top : gap - half + 1][::-1]
        for a in (np.flatnonzero(both)[::-1] + half).tolist():
            if self._enough((a, gap - a), taken):
                return a, gap - a
        return None

    def longest(self, gap: int, taken: Counter) -> int:
        """The longest available length that fits, 0 if there is none."""
        for n in np.flatnonzero(self.single[: gap + 1])[::-1].tolist():
            if self.left[n] > taken[n]:
                return n
        return 0


def exact_fills(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences begun with the longest piece left and filled exactly where the index has a filling, else by the longest that fits."""
    index = SumIndex(histogram, capacity)
    out: list[Pattern] = []
    for first in range(capacity, 0, -1):
        while index.left[first]:
            combo, gap, taken = (first,), capacity - first, Counter((first,))
            while gap:
                more = index.filling(gap, taken) or ((n,) if (n := index.longest(gap, taken)) else ())
                if not more:
                    break
                combo += more
                taken.update(more)
                gap -= sum(more)
            out.append((combo, index.use(combo)))
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Each length, longest first, goes to the smallest gap that holds it."""
    gaps: dict[int, list[Pattern]] = defaultdict(list)
    order: list[int] = []  # gaps that have sequences, ascending

    def put(bins: Pattern, gap: int) -> None:
        if not gaps[gap]:
            insort(order, gap)
        gaps[gap].append(bins)

    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        while count:
            at = bisect_left(order, n)
            if at == len(order):
                combo, times, gap = (), count, capacity
            else:
                gap = order[at]
                combo, times = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            fit = min(gap // n, count)
            full = min(times, count // fit)
            if times > full and combo:
                put((combo, times - full), gap)
            put((combo + (n,) * fit, full), gap - n * fit)
            count -= full * fit
    return [b for bins in gaps.values() for b in bins if b[1]]


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every length exactly as often as it occurs.

    Of three plans that with the fewest sequences: exact fills of everything, best fit, and best fit whose sequences with a gap
    are taken apart and filled anew by the index.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    fit = best_fit(left, capacity)
    full = [p for p in fit if sum(p[0]) == capacity]
    again: Counter[int] = Counter()
    for combo, times in fit:
        if sum(combo) != capacity:
            for n in combo:
                again[n] += times
    plans = (exact_fills(left, capacity), full + exact_fills(again, capacity), fit)
    return min(plans, key=lambda plan: sum(times for _, times in plan))


class Places:
    """Where the pieces of each length go, by their rank: ranges of ranks in order of length and rank."""

    def __init__(self, patterns: list[Pattern], capacity: int) -> None:
        ranks: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for combo, times in patterns:
            offset, at = 0, 0
            while at < len(combo):
                n, run = combo[at], 1
                while at + run < len(combo) and combo[at + run] == n:
                    run += 1
                rows.append((n, ranks[n], base, run, offset))
                ranks[n] += run * times
                offset += n * run
                at += run
            base += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.low, self.base, self.run, self.offset = table.T[1:]
        self.first = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        by = np.argsort(length, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(length[by]) != 0]) if len(by) else []
        for some in np.split(by, heads[1:]) if len(by) else []:
            n = int(length[some[0]])
            a, b = self.first[n], self.first[n + 1]
            at = a + np.searchsorted(self.low[a:b], rank[some], side="right") - 1
            step = rank[some] - self.low[at]
            sequence[some] = self.base[at] + step // self.run[at]
            offset[some] = self.offset[at] + step % self.run[at] * n
        return sequence, offset


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.keep(cut_pieces(documents, tokenizer_path, capacity, separator))
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # one window key per length: at most ``capacity`` keys with one row for each partition of the input
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    # the plan is bounded by the capacity alone: each pattern uses up a length, and has no more than capacity pieces
    shared = spark.sparkContext.broadcast(Places(plan_patterns(histogram, capacity), capacity))
    # offsets grow with the partitions of the input, so they are never sent to all tasks
    ranked = pieces.join(offsets.select("length", "part", "before").hint("shuffle_hash"), ["length", "part"])
    kept = ("doc_id", "piece", "start", "length", "ids_crc32")

    def make():
        places = shared.value

        def step(batch):
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            return {c: batch.column(c) for c in kept} | {"sequence_id": sequence, "offset": offset}

        return step

    rows = ranked.select(*kept, (F.col("before") + F.col("local")).alias("rank"))
    return map_batches(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
