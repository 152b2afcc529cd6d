"""SimHash near-duplicates by covering locality-sensitive hashing.

Each whole text becomes a 64-bit fingerprint of its 3-word shingles. To find
all fingerprints that differ in at most ``radius`` bits, every bit gets a
non-zero code of ``radius + 1`` bits, dealt in turn; table *v* (one for each
non-zero v) keeps the bits whose code has an odd overlap with v. For any
``radius`` bits some v is orthogonal to all their codes, so two fingerprints
within the radius always agree in a whole table: none is missed, whatever the
bits.

Equal fingerprints are collapsed first (a group of copies is one row). Buckets
of a table are compared with vectorised bit counts; a large
bucket is split by blocks of its remaining bits (one of radius + 1 blocks must
agree), over many tasks where a worker could not hold it, so a bucket of near copies is never compared pair by pair. Each bucket
hands on a spanning forest of its links, not all pairs; that keeps every
component whole.

Null or empty texts, or texts of white space only, have fingerprint zero and
are linked like any other. A text of one or two words is one shingle. Empty
table: no rows. Repeated rows (same doc_id) count as members of one group.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.llm.batches import map_batches
from cohesia.llm.components import connected_components
from cohesia.session import Scratch, ship

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of one bucket that are compared at once; larger buckets are split.
BUCKET = 1500
#: Fingerprints of one bucket that a worker holds, and how often larger ones are dealt anew: 64 bits leave 32, 24, 18 and then 14 free.
SPLIT, LEVELS = 20_000, 3
_UPPER = {i: i + 32 for i in range(65, 91)}
_BREAKS = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}


def words(text: str) -> list[str]:
    """Words between space and the controls from tab to carriage return, A-Z lower-cased."""
    return [w for w in text.translate(_BREAKS | _UPPER).split(" ") if w]


def fingerprint(text: str | None) -> int:
    found = words(text or "")
    if not found:
        return 0
    raw = [w.encode() for w in found]
    shingles = [b" ".join(g) for g in zip(*(raw[i:] for i in range(SHINGLE)), strict=False)] or [b" ".join(raw)]
    digest, total = xxhash.xxh64_intdigest, len(shingles)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, 65_536):
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + 65_536]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def make():
        def step(batch):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

        return step

    return map_batches(documents.select("doc_id", "text"), make, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero v of radius + 1 bits: bits whose code has an odd overlap with v."""
    codes = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def bucket_links(values: np.ndarray, free: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct ``values`` (uint64) that differ in at most radius of the free bits."""
    n = len(values)
    if n < 2:
        return []
    if n > BUCKET and free.bit_count() > radius:
        places = [i for i in range(64) if free >> i & 1]
        found: list[tuple[int, int]] = []
        for block in np.array_split(places, radius + 1):
            mask = sum(1 << int(i) for i in block)
            keys = values & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(order, cuts):
                found += bucket_links(values[part], free & ~mask, radius)
        return found
    # the remaining bits differ in every pair at most as often as there are bits: compare row by row
    parent = np.arange(n)
    links = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1
        if len(near):
            roots = _roots(parent)
            mine, theirs = roots[i], roots[near]
            new, first = np.unique(theirs[theirs != mine], return_index=True)
            picked = near[theirs != mine][first]
            links += [(int(values[i]), int(values[j])) for j in picked]
            roots[new] = mine
            parent = roots
    return links


def _solved(batches: Iterator[pa.RecordBatch], free: list[int], radius: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Links (a, b, -1) of sorted buckets (path, b, fp); the rows of a bucket over SPLIT are handed on as (fp, b, path) instead."""

    def rows(a: np.ndarray, b: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(path, pa.int32())], names=["a", "b", "path"])

    def whole(path: np.ndarray, b: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.r_[np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (b[1:] != b[:-1])]), len(fp)]
        links: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(starts) > 1):
            at, end = starts[k], starts[k + 1]
            links += bucket_links(fp[at:end].view(np.uint64), free[path[at]], radius)
        pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return rows(pairs[:, 0], pairs[:, 1], np.full(len(pairs), -1))

    held: list[tuple[np.ndarray, ...]] = []
    wide: tuple[int, int] | None = None  # the bucket that is being handed on
    for batch in batches:
        now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "b", "fp"))
        if not len(now[0]):
            continue
        if wide:
            more = np.flatnonzero((now[0] != wide[0]) | (now[1] != wide[1]))
            cut = more[0] if len(more) else len(now[0])
            yield rows(now[2][:cut], now[1][:cut], now[0][:cut])
            now = tuple(x[cut:] for x in now)
            if not len(more):
                continue
            wide = None
        now = tuple(np.concatenate(x) for x in zip(*held, now, strict=True))
        ends = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = ends[-1] + 1 if len(ends) else 0
        if cut:
            yield whole(*(x[:cut] for x in now))
        held = [tuple(x[cut:].copy() for x in now)]
        if not last and len(held[0][0]) > SPLIT:
            wide = int(held[0][0][0]), int(held[0][1][0])
            yield rows(held[0][2], held[0][1], held[0][0])
            held = []
    if held:
        yield whole(*held[0])


def near_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that join every pair within the radius into one component.

    A bucket over SPLIT is never held: its rows are dealt anew by each of radius + 1 blocks of its free bits (two of them within
    the radius agree in a whole block). After LEVELS of that a bucket has no more free bits than fingerprints fit in a worker.
    """
    free = [(1 << 64) - 1 & ~m for m in covering_masks(radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    key = lambda m: F.col("fp").bitwiseAND(m)
    first = (F.struct(F.lit(v).alias("path"), F.xxhash64(key(F.lit(signed((1 << 64) - 1 & ~m)))).alias("b")) for v, m in enumerate(free))
    rows = distinct.select("fp", F.explode(F.array(*first)).alias("t")).select("t.path", "t.b", "fp")
    ship(distinct.sparkSession)
    found = []
    for level in range(LEVELS + 1):

        def run(batches: Iterator[pa.RecordBatch], free=free, last=level == LEVELS) -> Iterator[pa.RecordBatch]:
            return _solved(batches, free, radius, last)

        done = scratch.keep(rows.repartition("path", "b").sortWithinPartitions("path", "b").mapInArrow(run, "a long, b long, path int"))
        found.append(done.where("path = -1").select("a", "b"))
        wide = done.where("path >= 0")
        if level == LEVELS or wide.isEmpty():
            break
        blocks = [[sum(1 << int(i) for i in part) for part in np.array_split([i for i in range(64) if f >> i & 1], radius + 1)] for f in free]
        masks = F.array(*(F.array(*(F.lit(signed(m)) for m in some)) for some in blocks))
        parts = F.posexplode(masks[F.col("path")]).alias("k", "mask")
        again = wide.select(F.col("a").alias("fp"), "b", "path", parts)
        rows = again.select((F.col("path") * (radius + 1) + F.col("k")).cast("int").alias("path"), F.xxhash64("b", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("b"), "fp")
        free = [f & ~m for f, some in zip(free, blocks, strict=True) for m in some]
    return reduce(DataFrame.unionByName, found)


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    scratch = Scratch(documents.sparkSession)
    prints = scratch.keep(fingerprints(documents))
    groups = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(groups.select("fp"), scratch, radius)
    members = scratch.keep(connected_components(links, scratch))
    linked = members.join(groups, members.node == groups.fp).select("component", "first", "fp")
    least = scratch.keep(linked.groupBy("component").agg(F.min("first").alias("least")))
    of_linked = members.join(least, "component").select(F.col("node").alias("fp"), "least")
    of_all = scratch.keep(groups.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(of_all, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_row_key(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Two hashes of doc_id and text beside the columns: never null, and equal only for rows equal in both."""
    return documents.withColumn("r1", F.xxhash64(doc_id, text)).withColumn("r2", F.xxhash64(text, F.lit(SEED), doc_id))
