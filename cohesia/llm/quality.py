"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows. The method's verdict is a *minimum-covariance-determinant* estimate for
each language and source: from three robust starts, concentration steps take mean and
covariance of the ``KEEP`` share of documents that lie closest and measure all distances anew;
the start of least determinant goes on until no determinant falls any more (``STEPS`` at most), and the
estimate is reweighted once by all documents within the 97.5 % ellipsoid. A document is rejected if its
transformed statistics lie beyond the chi-square cutoff by Mahalanobis distance.

Statistics that are constant in clean text would make every determinant zero, so covariances are
regularised: ``FLOORS`` squared is added to the variances, in the determinants as well.

Order statistics (medians, the share to keep) come from counts of narrow fixed
bins, so every pass is a partial aggregation: a language or source with a third of
all rows never meets in one task, and results do not depend on the order of
rows. Statistics are written to the shared folder once; texts are read once.

Null or empty text: no words, base_failed. Null ``lang`` or ``source`` is a group of
its own. Groups of fewer than ``LEAST`` documents that pass the base rules are
judged with the other such groups of their language, or, where these are too few
together, of all languages; ``level`` says which. If even these are fewer than ``LEAST``, none of them is
rejected. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesia.session import Scratch

KEEP = 0.75
#: Concentration steps at most, and the fall of the determinant's logarithm under which a group has settled.
STEPS, SETTLED = 15, 1e-3
#: Five documents for each statistic.
LEAST = 25
#: Chi-square with five degrees of freedom: the quantile of 1 - 1e-5, and the factor that makes the kept share's covariance consistent.
CUTOFF, CONSISTENT = 30.856, 1.41
#: The same for reweighting: the quantile of 0.975, and its factor.
REWEIGHT, CONSISTENT_ALL = 12.833, 1.06
STATS = ("word_len", "symbols", "capitals", "dup_lines", "repeats")
FLOORS = {"word_len": 0.08, "symbols": 0.04, "capitals": 0.06, "dup_lines": 0.08, "repeats": 0.08}
#: Bins of a statistic, and bins of the logarithm of a distance, to one unit.
FINE, LOG_FINE = 200.0, 50.0
WINDOW = 8
#: Groups whose estimates are sent to all tasks; with more, they are joined by a shuffle.
BROADCAST_GROUPS = 20_000
_BREAK = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more, the first occurrence included."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"])) | ((k < F.size(pairs) - 1) & (F.get(pairs, k + 1)["h"] == e["h"])))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def of_hashes(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, covered))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(_let(windows, of_hashes))

    return _let(words, of_words)


def statistics(documents: DataFrame) -> DataFrame:
    """Base counts and transformed statistics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.regexp_replace(text, _BREAK, "")
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, _BREAK))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    base = documents.select(
        "doc_id", "lang", "source",
        F.length(solid).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-ZÀ-ÖØ-Þ]+", "")).alias("n_capitals"),
        of_lines.alias("of_lines"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeat"), F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).alias("echo"))).alias("of_words"),
    )
    flat = base.select(
        "doc_id", "lang", "source", F.col("of_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("of_lines.dup").cast("long").alias("n_dup_lines"), F.col("of_words.repeat").alias("n_repeat_words"),
        F.col("n_capitals"), F.col("of_lines.n").alias("n_lines"), (F.col("of_words.repeat") + F.col("of_words.echo")).alias("n_again"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return flat.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.log(share("word_chars", "n_words") + 1e-3).alias("word_len"), F.sqrt(share("n_symbols", "word_chars")).alias("symbols"), F.sqrt(share("n_capitals", "word_chars")).alias("capitals"),
        share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_again", "n_words").alias("repeats"),
    )


def _share_bin(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """by, bin and part: the bin up to which the share of each key's rows lies, and the part of that bin that is needed for it.

    counts has by, bin and n, a bounded number of bins for each key.
    """
    w = Window.partitionBy(*by)
    up, most = F.sum("n").over(w.orderBy("bin")), F.ceil(share * F.sum("n").over(w))
    full = counts.select(*by, "bin", "n", up.alias("up"), most.alias("most")).where("up >= most")
    part = (F.col("most") - F.col("up") + F.col("n")) / F.col("n")
    return full.groupBy(*by).agg(F.min(F.struct("bin", part.alias("part"))).alias("at")).select(*by, F.col("at.bin").alias("bin"), F.col("at.part").alias("part"))


def _join(rows: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, on)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _moments(values: list[Column], weight: Column) -> list[Column]:
    """Weighted means a_* and covariances c_i_j as aggregates of values that are centred already."""
    total = F.sum(weight)
    mean = [F.sum(weight * v) / total for v in values]
    return [m.alias(f"a_{i}") for i, m in enumerate(mean)] + [(F.sum(weight * values[i] * values[j]) / total - mean[i] * mean[j]).alias(f"c_{i}_{j}") for i, j in _pairs()]


def _factored(rows: DataFrame, add: list[float], factor: float) -> DataFrame:
    """From c_i_j the inverse Cholesky factor w_i_j of factor x covariance + diag(add), and the logarithm of its determinant (log_det)."""
    least = [x * 0.25 for x in add]
    for j in range(len(STATS)):
        rest = sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") * factor + add[j] - rest, F.lit(least[j]))))
        for i in range(j + 1, len(STATS)):
            inner = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            rows = rows.withColumn(f"l_{i}_{j}", (F.col(f"c_{i}_{j}") * factor - inner) / F.col(f"l_{j}_{j}"))
    for i, j in _pairs():
        inner = sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0))
        rows = rows.withColumn(f"w_{i}_{j}", ((1.0 if i == j else 0.0) - inner) / F.col(f"l_{i}_{i}"))
    log_det = sum((2 * F.log(f"l_{j}_{j}") for j in range(len(STATS))), F.lit(0.0))
    return rows.withColumn("log_det", log_det).drop(*(f"l_{i}_{j}" for i, j in _pairs()), *(f"c_{i}_{j}" for i, j in _pairs()))


def _distance(values: list[Column]) -> Column:
    """Squared Mahalanobis distance of centred values."""
    return sum((sum((F.col(f"w_{i}_{k}") * values[k] for k in range(i + 1)), F.lit(0.0)) ** 2 for i in range(len(STATS))), F.lit(0.0))


def _centred() -> list[Column]:
    return [F.col(s) - F.col(f"m_{s}") for s in STATS]


_ADD = [FLOORS[s] ** 2 for s in STATS]
_STATE = ["log_det", *(f"m_{s}" for s in STATS), *(f"w_{i}_{j}" for i, j in _pairs())]


def _starts(rows: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Three robust estimates of each group, as gid, start, m_* and w_*: all centred on the medians, scattered by the median
    deviations alone, by those with the correlations of tanh scores, and with those of spatial signs."""
    binned = lambda value: F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.floor(value(s) * FINE).alias("bin")) for s in STATS))).alias("e")

    def median(df: DataFrame, value) -> DataFrame:
        counts = df.select("gid", binned(value)).groupBy("gid", "e.stat", "e.bin").agg(F.count(F.lit(1)).alias("n"))
        return _share_bin(counts.toDF("gid", "stat", "bin", "n"), ["gid", "stat"], 0.5).groupBy("gid").pivot("stat", list(STATS)).agg(F.first((F.col("bin") + 0.5) / FINE))

    centre = scratch.keep(median(rows, F.col).toDF("gid", *(f"m_{s}" for s in STATS)))
    spread = median(_join(rows, centre, ["gid"], few), lambda s: F.abs(F.col(s) - F.col(f"m_{s}"))).toDF("gid", *(f"s_{s}" for s in STATS))
    wide = spread.select("gid", *(F.greatest(F.col(f"s_{s}") * 1.4826, F.lit(FLOORS[s])).alias(f"s_{s}") for s in STATS))
    robust = scratch.keep(_join(centre, wide, ["gid"], few))
    scored = _join(rows, robust, ["gid"], few).select("gid", *(((F.col(s) - F.col(f"m_{s}")) / F.col(f"s_{s}")).alias(s) for s in STATS))
    size = F.sqrt(sum((F.col(s) ** 2 for s in STATS), F.lit(0.0)))
    kinds = {1: [F.tanh(s) for s in STATS], 2: [F.when(size > 0, F.col(s) / size).otherwise(0.0) for s in STATS]}
    one = scored.groupBy("gid").agg(*(m.alias(f"k{k}_{n}") for k, values in kinds.items() for m, n in zip(_moments(values, F.lit(1.0)), _names(), strict=True)))
    shapes = [one.select("gid", F.lit(k).alias("start"), *(F.col(f"k{k}_{n}").alias(n) for n in _names())) for k in kinds]
    plain = robust.select("gid", F.lit(0).alias("start"), *(F.lit(0.0).alias(f"a_{i}") for i in range(len(STATS))), *(F.lit(float(i == j)).alias(f"c_{i}_{j}") for i, j in _pairs()))
    shape = _factored(plain.unionByName(scratch.keep(shapes[0].unionByName(shapes[1]))), [0.02] * len(STATS), 1.0)
    scaled = shape.join(robust, "gid").select("gid", "start", "log_det", *(f"m_{s}" for s in STATS), *((F.col(f"w_{i}_{j}") / F.col(f"s_{STATS[j]}")).alias(f"w_{i}_{j}") for i, j in _pairs()))
    return scratch.keep(scaled)


def _names() -> list[str]:
    return [*(f"a_{i}" for i in range(len(STATS))), *(f"c_{i}_{j}" for i, j in _pairs())]


def _concentrated(rows: DataFrame, state: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """One concentration step: mean and covariance of the KEEP share of each group's rows that lie closest to its state.

    The share is exact: of the bin of distances that it ends in, every row counts by the part that is needed.
    """
    near = _join(rows, state, ["gid"], few).withColumn("bin", F.floor(F.log(_distance(_centred()) + 1e-9) * LOG_FINE))
    counts = near.groupBy("gid", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    limit = scratch.keep(_share_bin(counts, ["gid", "start"], KEEP)).withColumnRenamed("bin", "last")
    kept = _join(near, limit, ["gid", "start"], few).where("bin <= last")
    return _estimate(kept, F.when(F.col("bin") < F.col("last"), 1.0).otherwise(F.col("part")), CONSISTENT, scratch)


def _estimate(kept: DataFrame, weight: Column, factor: float, scratch: Scratch) -> DataFrame:
    found = kept.groupBy("gid", "start", *(f"m_{s}" for s in STATS)).agg(*_moments(_centred(), weight))
    moved = found.select("gid", "start", *((F.col(f"m_{s}") + F.col(f"a_{i}")).alias(f"m_{s}") for i, s in enumerate(STATS)), *(f"c_{i}_{j}" for i, j in _pairs()))
    return scratch.keep(_factored(moved, _ADD, factor).select("gid", "start", *_STATE))


def robust_estimates(rows: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """gid, log_det_raw, m_* and w_i_j (inverse Cholesky factor) of each group's minimum covariance determinant, reweighted.

    Two steps from each start; the start of least determinant goes on until no group's determinant falls any more.
    """
    state = _starts(rows, scratch, few)
    for _ in range(2):
        state = _concentrated(rows, state, scratch, few)
    state = scratch.keep(state.groupBy("gid").agg(F.min(F.struct("log_det", "start", *_STATE[1:])).alias("b")).select("gid", "b.*"))
    for _ in range(STEPS):
        new = _concentrated(rows, state, scratch, few)
        old = state.select("gid", F.col("log_det").alias("before"))
        fell = _join(new, old, ["gid"], few).select(F.max(F.col("before") - F.col("log_det")).alias("x")).first()["x"]
        state = scratch.keep(_lower(new, state, few))
        if fell is None or fell < SETTLED:
            break
    near = _join(rows, state, ["gid"], few).where(_distance(_centred()) <= REWEIGHT)
    final = _estimate(near, F.lit(1.0), CONSISTENT_ALL, scratch)
    return scratch.keep(_join(final, state.select("gid", F.col("log_det").alias("log_det_raw")), ["gid"], few))


def _lower(new: DataFrame, old: DataFrame, few: bool) -> DataFrame:
    """Of two states of each group that of lower determinant."""
    both = new.unionByName(old.select(new.columns))
    return both.groupBy("gid").agg(F.min(F.struct("log_det", "start", *_STATE[1:])).alias("b")).select("gid", "b.*")


def _levels(sizes: DataFrame) -> DataFrame:
    """lang, source, level and gid of every group: small ones are judged with the other small ones of their language, and
    where these are few together, with those of all languages (level 2); of too few even then, nobody is judged (level 3)."""
    small = F.col("n") < LEAST
    by_lang = sizes.where(small).groupBy(F.col("lang").alias("g_lang")).agg(F.sum("n").alias("pooled"))
    met = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("g_lang")), "left").drop("g_lang")
    level = F.when(~small, 0).when(F.col("pooled") >= LEAST, 1).otherwise(2)
    some = met.withColumn("level", level)
    rest = some.where("level = 2").agg(F.sum("n").alias("n")).first()["n"] or 0
    if rest < LEAST:
        some = some.withColumn("level", F.when(F.col("level") == 2, 3).otherwise(F.col("level")))
    lang, source = F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") == 0, F.col("source"))
    # nulls are told apart from each other: a hash passes over them
    return some.select("lang", "source", "level", F.xxhash64("level", lang.isNull(), lang, source.isNull(), source).alias("gid"))


def judge(documents: DataFrame) -> DataFrame:
    """Base counts, base_failed, kept, the squared distance of every document and the level of the group that judged it
    (0: language and source, 1: small sources of a language, 2: those of all languages, 3: none)."""
    scratch = Scratch(documents.sparkSession)
    stats = scratch.keep(statistics(documents))
    sizes = scratch.keep(stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")))
    few = sizes.count() <= BROADCAST_GROUPS
    levels = scratch.keep(_levels(sizes)).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    same = stats.lang.eqNullSafe(levels.g_lang) & stats.source.eqNullSafe(levels.g_source)
    rows = stats.join(F.broadcast(levels) if few else levels, same).drop("lang", "source", "g_lang", "g_source")
    found = robust_estimates(rows.where("not base_failed and level < 3").select("gid", *STATS), scratch, few)
    judged = rows.join(F.broadcast(found) if few else found, "gid", "left").withColumn("d2", _distance(_centred()))
    outlier = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), F.col("d2").alias("distance2"), "level",
    )
