"""Near copies for filtering: Jaccard of 5-word shingles at least 0.8, from covering SimHash and an exact completion.

SimHash alone cannot give this: two texts that reach the threshold differ in some 10 of 64 bits, and covering tables
for that radius would be 2^11 and more. So links come from two sides, and each is verified with whole shingle sets:

1. *Covering locality-sensitive hashing* (``simhash.near_links``) over SimHash fingerprints of the 5-word shingles links
   texts that differ in at most 3 bits, and texts of one fingerprint.
2. *A prefix join* finds what is left. Every set is sorted by one order (rare shingles first, by counts of all shingles of the
   corpus in ``1 << BITS`` counters; any shared order is exact). Of two sets that reach the threshold, the smaller one (or equal)
   has a shared shingle among its first n - ceil(8n/9) + 1, the larger one among its first n - ceil(4n/5) + 1; only those are dealt out.
   Sets that meet are proposed in rounds, one candidate for each text, then one for each two components that meet
   (that with most shared shingles), until a round joins nothing. So a large group of near copies
   is joined by about as many pairs as it has members. What still meets in different components is compared by
   pairs, under the filters of size and position. Shingles that the same sets have in front count as one, by the first of them.
   Each set carries the parities of its shingles by ``MARKS`` classes; no more of them differ than shingles do, so pairs
   that differ in too many cannot reach the threshold. A pair is verified once.

Texts with equal sets are one node. Groups are connected components. One row of each stays: that with the smallest
doc_id (nulls last), then the smallest hash of its text; rows equal in both doc_id and text count as one. Null ids
join nothing by themselves. Null or empty texts, or texts of white space only, are one group. A text of under five words is
one shingle. Columns other than ``doc_id`` and ``text`` pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohesia.llm.batches import map_batches
from cohesia.llm.components import connected_components
from cohesia.llm.simhash import near_links, with_row_key, words
from cohesia.session import Scratch, ship

SHINGLE = 5
SEED = 42
#: The threshold as a fraction of integers, so that no rounding decides.
NUM, DEN = 4, 5
#: Counters of shingles (by the first bits of their hashes), and how many of them make one row of counts.
BITS, CHUNK = 18, 4096
#: Parities that a set carries, a multiple of 64.
MARKS = 1024
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SLOT = np.uint64(64 - BITS)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    found = words(text or "")
    digest = xxhash.xxh64_intdigest
    if len(found) < SHINGLE:
        return np.array([digest(" ".join(found).encode(), SEED)] if found else [], dtype=np.uint64)
    known = {w: digest(w.encode(), SEED) for w in set(found)}
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, dtype=np.uint64)
    for k, m in enumerate(_MIX):
        out = (out ^ (h[k : k + n] * m)) * _MIX[0]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def front(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: one of them at least is shared with any set that reaches the threshold."""
    n = len(found)
    many = n - -(-n * NUM // DEN) + 1 if n else 0
    return found[np.argsort(order[found >> _SLOT] << np.uint64(52) | found >> np.uint64(12), kind="stable")[:many]]


def sketch(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes."""
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 65_536):
        ones += np.unpackbits(found[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def parities(found: np.ndarray) -> np.ndarray:
    """For each class of shingle hashes whether the set has an odd number of them, as 64-bit words."""
    odd = np.bincount((found & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _alike(a: str, b: str, na: Column, nb: Column) -> Column:
    """Whether the parities of two sets allow that they reach the threshold: (NUM + DEN) x differing shingles <= (DEN - NUM) x (na + nb)."""
    differ = _sum([F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(MARKS // 64)])
    return (NUM + DEN) * differ <= (DEN - NUM) * (na + nb)


def shingle_order(texts: DataFrame) -> np.ndarray:
    """For each counter the logarithm of its shingles in the whole corpus, as a small integer.

    A task hands on its counters once, in chunks; chunks are added up where they meet, one batch at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(shingles(t))
                size += len(held[-1])
                if size >= 1 << BITS:
                    total += np.bincount((np.concatenate(held) >> _SLOT).astype(np.int64), minlength=1 << BITS)
                    held, size = [], 0
        if held:
            total += np.bincount((np.concatenate(held) >> _SLOT).astype(np.int64), minlength=1 << BITS)
        chunks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([chunks[k].tobytes() for k in some], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])

    ship(texts.sparkSession)
    schema = "chunk long, counts binary"
    parts = texts.select("text").mapInArrow(count, schema)
    whole = np.zeros((1 << BITS) // CHUNK * CHUNK, dtype=np.int64).reshape(-1, CHUNK)
    for r in parts.repartition("chunk").mapInArrow(add, schema).collect():  # one row for each chunk, 2 MB in all
        whole[r["chunk"]] += np.frombuffer(bytes(r["counts"]), np.int64)
    return np.floor(64 * np.log2(whole.ravel() + 1.0)).astype(np.uint64)


def _rows(keyed: DataFrame, order: np.ndarray) -> DataFrame:
    """Each row's key, the hash of its shingle set (rid), the set's size and fingerprint, and its front."""
    shared = keyed.sparkSession.sparkContext.broadcast(order)  # 2 MB

    def make():
        known = shared.value

        def step(batch):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            out = {c: batch.column(c) for c in ("doc_id", "r1", "r2")}
            out["rid"] = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], dtype=np.uint64).view(np.int64)
            out["n"] = [len(s) for s in found]
            out["fp"] = [sketch(s) for s in found]
            out["odd"] = [parities(s) for s in found]
            out["front"] = [front(s, known).view(np.int64) for s in found]
            return out

        return step

    return map_batches(keyed, make, "doc_id long, r1 long, r2 long, rid long, n long, fp long, odd array<long>, front array<long>")


def _is_short(n: Column, at: Column) -> Column:
    """Whether a place is in the front that the smaller of two sets is found by."""
    return (NUM + DEN) * (n - at) >= 2 * NUM * n


def _may_reach(a: str, b: str) -> Column:
    """Whether two sets (the first no larger) that first meet at these places can reach the threshold."""
    na, nb, pa_, pb = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"p{a}"), F.col(f"p{b}")
    sizes = (na < nb) | ((na == nb) & (F.col(a) < F.col(b)))
    return sizes & (DEN * na >= NUM * nb) & _is_short(na, pa_) & ((NUM + DEN) * F.least(na - pa_, nb - pb) >= NUM * (na + nb))


class _Verifier:
    """Compares whole sets. The texts of all sets that meet others are written once, which is half the size of the sets; pairs are joined to them."""

    def __init__(self, keyed: DataFrame, groups: DataFrame, ids: DataFrame, scratch: Scratch) -> None:
        wanted = groups.join(ids.hint("shuffle_hash"), "rid", "left_semi").select("rid", "first.r1", "first.r2")
        self.texts = scratch.keep(keyed.select("r1", "r2", "text").join(wanted.hint("shuffle_hash"), ["r1", "r2"]).select("rid", "text"))
        self.scratch = scratch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets that reach the threshold."""

        def compare():
            def step(batch):
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True))
                known: dict[int, np.ndarray] = {}  # many pairs of a slice have one side in common

                def of(rid: int, text: str) -> np.ndarray:
                    if rid not in known:
                        known[rid] = shingles(text)
                    return known[rid]

                good = [(a, b) for a, b, x, y in rows if similar(of(a, x), of(b, y))]
                return {"a": [a for a, _ in good], "b": [b for _, b in good]}

            return step

        # a text may stand there more than once, where rows are repeated; pairs are made distinct afterwards
        side = lambda c: self.texts.select(F.col("rid").alias(c), F.col("text").alias(f"t{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        return self.scratch.keep(map_batches(met, compare, "a long, b long"))


def _fingerprint_pairs(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): texts of one SimHash fingerprint with the first of them, and firsts of fingerprints that covering tables link."""
    firsts = scratch.keep(groups.where("n > 0").groupBy("fp").agg(F.min("rid").alias("head")))
    links = near_links(firsts.select("fp"), scratch)
    same = groups.where("n > 0").join(firsts, "fp").where("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b"))
    ends = links.join(firsts.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _proposals(met: DataFrame, by: list[str]) -> DataFrame:
    """Of the pairs (a, b) of ``met`` the one that meets most often, for each value of ``by``."""
    often = met.groupBy(*by, *(x for x in ("a", "b") if x not in by)).agg(F.sum("weight").alias("times"))
    return often.groupBy(*by).agg(F.max(F.struct("times", "a", "b")).alias("m")).select("m.a", "m.b")


def near_copies(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Row keys (r1, r2) of the one row of each group that stays, and whether any row is repeated."""
    keyed = with_row_key(documents.select("doc_id", "text"))
    rows = scratch.keep(_rows(keyed, shingle_order(documents)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("first")
    groups = scratch.keep(rows.groupBy("rid").agg(first, F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("odd").alias("odd")))
    # the front of each set once
    own = groups.select("rid", "first.r1", "first.r2")
    whole = rows.select("rid", "r1", "r2", "n", "front").join(own.hint("shuffle_hash"), ["rid", "r1", "r2"], "left_semi")
    repeated = _repeated(rows)
    if repeated:
        whole = whole.dropDuplicates(["rid"])
    dealt = whole.select("rid", "n", F.posexplode("front").alias("p", "s")).repartition("s")
    # a shingle counts if several sets have it, one of them among the shingles that the smaller set is found by
    pivot = F.min(F.when(_is_short(F.col("n"), F.col("p")), F.struct("rid", "n"))).alias("pivot")
    counts = dealt.groupBy("s").agg(F.count(F.lit(1)).alias("m"), pivot, *_members()).where("m > 1 and pivot is not null")
    buckets = scratch.keep(dealt.join(_leading(counts), "s"))
    scratch.drop(rows)

    fits = (DEN * F.col("n") >= NUM * F.col("pivot.n")) & (DEN * F.col("pivot.n") >= NUM * F.col("n"))
    to_pivot = buckets.where(fits & (F.col("rid") != F.col("pivot.rid"))).select(F.col("rid").alias("a"), F.col("pivot.rid").alias("b"), "weight")
    by_hash = scratch.keep(_fingerprint_pairs(groups, scratch))
    by_front = scratch.keep(_proposals(to_pivot, ["a"]))
    ends = by_hash.select(F.col("a").alias("rid")).unionByName(by_hash.select(F.col("b").alias("rid"))).unionByName(buckets.select("rid")).distinct()
    verified = _Verifier(keyed, groups, ends, scratch)
    tried = scratch.keep(_in_order(by_hash.unionByName(by_front)))
    links = verified(tried)
    component = _components(links, scratch)

    while True:  # each round joins components, so their number falls until none is joined
        open_ = scratch.keep(_open(buckets, component, groups))
        least = open_.groupBy("s").agg(F.min(F.struct("c", "rid", "n", "odd")).alias("pivot"))
        met = open_.join(least, "s").where((F.col("c") != F.col("pivot.c")) & fits & _alike("odd", "pivot.odd", F.col("n"), F.col("pivot.n")))
        pairs = _proposals(met.select("c", F.col("pivot.c").alias("d"), F.col("rid").alias("a"), F.col("pivot.rid").alias("b"), "weight"), ["c", "d"])
        pairs = scratch.keep(_in_order(pairs).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        more = verified(pairs)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        component = _components(links, scratch)

    one, two = (open_.select(F.col("s").alias(f"s{x}"), F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"), F.col("c").alias(f"c{x}"), F.col("odd").alias(f"odd{x}")) for x in ("a", "b"))
    rest = one.join(two, (F.col("sa") == F.col("sb")) & (F.col("ca") != F.col("cb")) & _may_reach("a", "b") & _alike("odda", "oddb", F.col("na"), F.col("nb")))
    more = verified(scratch.keep(_in_order(rest).join(tried, ["a", "b"], "left_anti")))
    if not more.isEmpty():
        component = _components(links.unionByName(more), scratch)
    in_group = groups.join(component, groups.rid == component.node, "left").select(F.coalesce("component", "rid").alias("c"), "first")
    return scratch.keep(in_group.groupBy("c").agg(F.min("first").alias("first")).select("first.r1", "first.r2")), repeated


def _components(links: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.keep(connected_components(links, Scratch(scratch.spark)))


def _in_order(pairs: DataFrame) -> DataFrame:
    """Each unordered pair (a, b) once, the smaller first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members() -> list[Column]:
    """Aggregates that know the sets of a shingle by 128 bits, and the place of the shingle in the first of them."""
    return [F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(SEED))).alias("y"), F.min(F.struct("rid", "p")).alias("lead")]


def _leading(counts: DataFrame) -> DataFrame:
    """(s, pivot, weight): of the shingles that the same sets have in front the first one by the common order, and how many they are.

    Two sets meet first at such a shingle: an earlier one with the same members would be shared by both.
    """
    same = counts.groupBy("m", "x", "y", "lead.rid").agg(F.min(F.struct("lead.p", "s", "pivot")).alias("e"), F.count(F.lit(1)).alias("weight"))
    return same.select("e.s", "e.pivot", "weight")


def _open(buckets: DataFrame, component: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of shingles that several components share, with their component c and the parities of their sets."""
    labelled = buckets.drop("pivot").join(component, F.col("rid") == F.col("node"), "left").select("s", "rid", "n", "p", "weight", F.coalesce("component", "rid").alias("c"))
    several = labelled.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s")
    return labelled.join(several, "s").join(groups.select("rid", "odd"), "rid")


def _repeated(rows: DataFrame) -> bool:
    """Whether any doc_id has one text in several rows."""
    return not rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).isEmpty()


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, columns unchanged."""
    scratch = Scratch(documents.sparkSession, tidy=True)
    stay, repeated = near_copies(documents, scratch)
    names = documents.columns
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    keyed = with_row_key(plain, at["doc_id"], at["text"])
    out = keyed.join(stay.hint("shuffle_hash"), ["r1", "r2"], "left_semi")
    if repeated:
        out = out.dropDuplicates(["r1", "r2"])
    return out.drop("r1", "r2").toDF(*names)
