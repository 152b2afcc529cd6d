"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens that no vocabulary piece can span (before a run
of spaces and around line breaks), and those between two characters that stand
side by side in no piece. Distinct pre-tokens that are not yet known
to the worker are held as one ragged numpy array of piece numbers; in each
round every sequence, whatever its length, merges its lowest-rank adjacent pair, all sequences at once,
until no pair is left. All places of that pair are merged in one round, from
the left up to the first whose merge brings a pair of lower rank, which has to go
first. Surviving symbols are counted; a
character outside the vocabulary counts its UTF-8 bytes (byte fallback).

Null or empty text: 0 bytes, 0 tokens. Null ``doc_id`` is passed through.
Repeated rows give repeated rows. Columns other than ``doc_id`` and ``text``
are not read. A text is held whole, with some 100 bytes for each character of the pre-tokens
that are new in it; a run of letters without any break takes one round for each rank that occurs in it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from cohesia.llm.batches import map_batches

#: Known pre-tokens a worker holds before it starts anew, and characters of new ones that are merged in one go.
KNOWN, TOGETHER = 400_000, 400_000
SPACE = "▁"
_NONE = np.iinfo(np.int64).max
_COUNTERS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the pieces of one sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.by_code = np.full(0x110000, -1, dtype=np.int32)
        self.by_code[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.width = model.vocab_size()
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        keys, ranks, merged = [], [], []
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ranks.append(order[model.get_score(i)])
                    merged.append(i)
        at = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[at]
        self.ranks = np.array(ranks, dtype=np.int64)[at]
        self.merged = np.array(merged, dtype=np.int64)[at]
        beside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(ord(a) << 21 | ord(b) for a, b in beside), dtype=np.int64)
        self.known: dict[str, int] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of adjacent pairs; the rank is _NONE where they do not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def merge(self, sym: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence; sym: all piece numbers in a row, counts: lengths, 1 at least."""
        counts = counts.copy()
        seq = np.repeat(np.arange(len(counts)), counts)
        rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        at = np.flatnonzero(seq[:-1] == seq[1:])
        rank[at], into[at] = self._lookup(sym[at], sym[at + 1])
        while True:
            live = np.flatnonzero(rank != _NONE)
            if not len(live):
                return counts
            owner = seq[live]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank[live], first)
            wins = live[rank[live] == np.repeat(best, np.diff(np.r_[first, len(live)]))]
            # of places in a row, which share a symbol, every other one
            run = np.r_[True, wins[1:] != wins[:-1] + 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(wins)), 0))
            wins = wins[(np.arange(len(wins)) - begin) % 2 == 0]
            wins = self._undisturbed(sym, seq, rank, into, wins)
            sym[wins] = into[wins]
            counts -= np.bincount(seq[wins], minlength=len(counts))
            stays = np.zeros(len(counts), dtype=bool)
            stays[owner] = True
            keep = stays[seq]
            keep[wins + 1] = False
            wins = (np.cumsum(keep) - 1)[wins]
            sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
            # only the pairs beside a merged symbol change
            at = np.unique(np.r_[wins, wins[wins > 0] - 1])
            rank[at] = _NONE
            at = at[at + 1 < len(sym)]
            at = at[seq[at] == seq[at + 1]]
            rank[at], into[at] = self._lookup(sym[at], sym[at + 1])

    def _undisturbed(self, sym: np.ndarray, seq: np.ndarray, rank: np.ndarray, into: np.ndarray, wins: np.ndarray) -> np.ndarray:
        """The places of each sequence up to the first whose merge makes a pair of lower rank than its own."""
        new, own, of = into[wins], rank[wins], seq[wins]
        again = np.r_[False, (wins[1:] == wins[:-1] + 2) & (of[1:] == of[:-1])]  # the symbol to the left is merged in this round, too
        left = np.maximum(wins - 1, 0)
        before = np.where(again, np.r_[new[:1], new[:-1]], sym[left])
        after = np.minimum(wins + 2, len(sym) - 1)
        low = (wins > 0) & ((seq[left] == of) | again) & (self._lookup(before, new)[0] < own)
        low |= (wins + 2 < len(sym)) & (seq[after] == of) & (self._lookup(new, sym[after])[0] < own)
        if not low.any():
            return wins
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        sizes = np.diff(np.r_[heads, len(of)])
        passed = np.cumsum(low) - low  # such places before each
        return wins[passed == np.repeat(passed[heads], sizes)]

    def learn(self, words: set[str]) -> None:
        """Count pre-tokens not yet known, those of like length together."""
        if len(self.known) > KNOWN:
            self.known.clear()
        part: list[str] = []
        size = 0
        for w in sorted((w for w in words if w not in self.known), key=len):
            part.append(w)
            size += len(w)
            if size >= TOGETHER:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _learn(self, part: list[str]) -> None:
        counts = np.array([len(w) for w in part], dtype=np.int64)
        codes = np.frombuffer("".join(part).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sym = self.by_code[codes].astype(np.int64)
        # a character outside the vocabulary never merges: its UTF-8 bytes are what survives
        more = np.where(sym < 0, (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF), 0)
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        # sequences end with their pre-token, and where two characters stand side by side in no piece
        pair = codes[:-1] << 21 | codes[1:]
        met = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] == pair
        head = np.r_[True, ~met]
        head[starts] = True
        heads = np.flatnonzero(head)
        total = self.merge(sym, np.diff(np.r_[heads, len(sym)]))
        total = np.add.reduceat(total, np.searchsorted(heads, starts)) + np.add.reduceat(more, starts)
        self.known.update(zip(part, total.tolist(), strict=True))

    def pretokens(self, text: str) -> tuple[int, list[str]]:
        """Line breaks (always one byte token each) and the pre-tokens of a text that is not empty."""
        if SPACE not in text and "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
            words: list[str] = []
            for k, line in enumerate((" " + text).split("\n")):
                first, *rest = line.replace(" ", " " + SPACE).split(" ")
                if first:
                    words.append(first)
                words += rest
            return k, words
        marked = SPACE + text.replace(" ", SPACE)
        return text.count("\n"), _RUNS.findall(marked)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) if t else (0, []) for t in texts]
        self.learn(set().union(*(w for _, w in cut)))
        get = self.known.__getitem__
        return [n + sum(map(get, words)) for n, words in cut]


_RUNS = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+")


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text."""

    def make():
        model = counter(model_path)

        def step(batch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = model.count(texts)
            return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_batches(documents.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
