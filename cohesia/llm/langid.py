"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed byte n-grams (2 to 4 bytes of
the lower-cased text, everything that is not a letter read as one break). Each
language has several centroids from spherical k-means; a text gets the
language of its most similar centroid by cosine. A text whose cosine distance
to every centroid is beyond a limit is *rejected*; the limit is learned from a
tenth of the sampled texts, which the centroids are not learned from (from all
of them where no language has ten).

Training takes at most ``PER_LANG`` distinct labelled texts of a language (those
with the smallest text hash) from rows whose crc32(doc_id as text) mod 4 is not
2. Every language that has a label there is learned, however many there are; the
centroids of each are fitted where its sample is. Prediction reads the whole text and nothing else.

Null texts, empty texts and texts without a letter: ``und``, score 0, rejected.
Rows with null ``lang`` are predicted but not learned from. Without any labelled
row every text is ``und``. Ties between centroids go to the alphabetically first
language. Repeated rows get equal answers. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.llm.batches import filter_batches, map_batches
from cohesia.session import Scratch, ship

PER_LANG = 600
#: Parts in which a language is thinned, and sampled rows (some 40 bytes each) that are sent to all tasks; more are joined by a shuffle.
SALTS, BROADCAST_ROWS = 32, 400_000
BUCKETS = 1 << 13
CENTROIDS = 4
#: A text is rejected if its cosine is below this quantile of labelled texts of its size that no centroid was learned from.
REJECT_QUANTILE, SIZES, CALIBRATE = 0.01, 12, 500
#: Every so many-th sampled text of a language is left out of its centroids, to set the limit.
ASIDE = 10
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([i if i >= 128 or chr(i).isalpha() else 32 for i in range(256)], dtype=np.uint32)


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    codes = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    out = np.zeros(BUCKETS, dtype=np.float32)
    gram = codes
    for n in range(2, 5):
        gram = (gram[:-1] << np.uint32(8)) | codes[n - 1 :]
        if len(gram):
            out += np.bincount((gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(19), minlength=BUCKETS)
    return out


def unit(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of n-gram counts."""
    x = np.sqrt(raw) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray  # by the binary logarithm of a text's n-gram count

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        return unit(raw, self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            raw = np.stack([counts(texts[i]) for i in part])
            limit = self.limits[_size(raw.sum(axis=1))].tolist()
            near = self.vectors(raw) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, k, c, low in zip(part, best.tolist(), near[np.arange(len(part)), best].tolist(), limit, strict=True):
                lang[i], score[i], rejected[i] = self.langs[k], float(min(max(c, 0.0), 1.0)), bool(c < low)
        return lang, score, rejected


def _size(total: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(total, 1)).astype(int), 0, SIZES - 1)


def _calibrate(model: Model, raw: np.ndarray) -> np.ndarray:
    """Limits for each size: the n-grams of texts set aside are thinned to that many and compared."""
    rng = np.random.default_rng(7)
    share = raw.astype(np.float64)
    share /= share.sum(axis=1, keepdims=True)
    out = []
    for b in range(SIZES):
        thin = rng.multinomial(2**b, share).astype(np.float32)
        out.append(np.quantile((model.vectors(thin) @ model.centroids.T).max(axis=1), REJECT_QUANTILE))
    return np.array(out)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(12):
        of = (x @ c.T).argmax(axis=1)
        c = np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _sample(documents: DataFrame, per_lang: int) -> DataFrame:
    """(lang, h, doc_id): the distinct labelled texts with the smallest hashes of each language."""
    learn = documents.where("lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    once = learn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    # a language with a third of all rows is first thinned in SALTS parts; what meets in one task is bounded
    for by in (Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))), Window.partitionBy("lang")):
        once = once.withColumn("k", F.row_number().over(by.orderBy("h"))).where(F.col("k") <= per_lang).drop("k")
    return once


def _features(documents: DataFrame, picked: DataFrame) -> DataFrame:
    """lang, h and the sparse n-gram counts (at, n) of the sampled texts that have a letter."""

    def make():
        def step(batch):
            texts = zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True)
            rows = [(la, h, counts(t)) for la, h, t in texts if _LETTER.search(t)]
            at = [np.flatnonzero(r) for *_, r in rows]
            return {
                "lang": [r[0] for r in rows],
                "h": [r[1] for r in rows],
                "at": [i.astype(np.uint16).tobytes() for i in at],
                "n": [r[2][i].tobytes() for r, i in zip(rows, at, strict=True)],
            }

        return step

    small = picked.count() <= BROADCAST_ROWS
    texts = documents.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("text").alias("h"), "text")
    met = texts.join(F.broadcast(picked) if small else picked, ["lang", "h", "doc_id"]).select("lang", "h", "text")
    return map_batches(met, make, "lang string, h long, at binary, n binary").dropDuplicates(["lang", "h"])


def _document_frequencies(features: DataFrame) -> np.ndarray:
    def make():
        def step(batch):
            places = np.frombuffer(b"".join(batch.column("at").to_pylist()), np.uint16)
            n = np.bincount(places, minlength=BUCKETS)
            return {"bucket": np.flatnonzero(n), "n": n[n > 0]}

        return step

    out = np.zeros(BUCKETS)
    for r in map_batches(features.select("at"), make, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def _dense(at: list[bytes], n: list[bytes]) -> np.ndarray:
    out = np.zeros((len(at), BUCKETS), dtype=np.float32)
    for row, i, v in zip(out, at, n, strict=True):
        row[np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float32)
    return out


def _centroids(features: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, j, centroid) for each language, fitted where its sample is: a task holds PER_LANG texts of one language."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        x = unit(_dense(table["at"].to_pylist(), table["n"].to_pylist()), idf)
        kept = [k for k in range(len(x)) if (k + 1) % ASIDE]
        found = [c.astype(np.float32).tobytes() for c in _cluster(x[kept], CENTROIDS)]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(found), pa.string()), "j": pa.array(range(len(found)), pa.int32()), "centroid": pa.array(found, pa.binary())})

    ship(features.sparkSession)
    return features.groupBy("lang").applyInArrow(learn, "lang string, j int, centroid binary")


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from a bounded sample of labelled rows that are not held out.

    The driver gets the centroids, the document frequencies and ``CALIBRATE`` texts set aside, never the sample.
    """
    nothing = Model([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(SIZES))
    scratch = Scratch(documents.sparkSession)
    features = scratch.keep(_features(documents, scratch.keep(_sample(documents, per_lang))))
    total = features.count()
    if not total:
        return nothing
    idf = (np.log((1 + total) / (1 + _document_frequencies(features))) + 1).astype(np.float32)
    rows = _centroids(features, idf).toArrow().sort_by([("lang", "ascending"), ("j", "ascending")])
    centroids = np.stack([np.frombuffer(c, np.float32) for c in rows["centroid"].to_pylist()])
    # the texts that no centroid was learned from (all, where no language has ASIDE of them), in an order by hash
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h")) % ASIDE
    numbered = features.withColumn("aside", place == 0).select("aside", "at", "n", F.xxhash64("lang", "h").alias("by"))
    some = numbered.where("aside").orderBy("by").limit(CALIBRATE).toArrow()
    if not some.num_rows:
        some = numbered.orderBy("by").limit(CALIBRATE).toArrow()
    model = Model(rows["lang"].to_pylist(), idf, centroids, nothing.limits)
    return Model(model.langs, idf, centroids, _calibrate(model, _dense(some["at"].to_pylist(), some["n"].to_pylist())))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # centroids x buckets, a bounded size

    def make():
        known = shared.value

        def step(batch):
            lang, score, rejected = known.predict(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "rejected": rejected}

        return step

    return map_batches(documents.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learn from the rows not held out, predict all."""
    out = predict(documents, fit(documents))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents that are not rejected, columns unchanged; learns as ``identify`` does."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def make():
        known = shared.value
        return lambda batch: [not r for r in known.predict(batch.column("text").to_pylist())[2]]

    return filter_batches(documents, make)
