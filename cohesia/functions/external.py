"""External indices: agreement of two labellings, from their contingency table alone.

One row with ``value``, or one for each combination of ``keys``. Labels may be of any
type; rows where either is null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesia.operators.stats import contingency, majority

C = F.col
#: Terms of the expected mutual information that one row stands for.
STRETCH = 65_536
METHODS = ("macro", "weighted", "sqrt_weighted", "harmonic")
_ONE = "_all"


def _keyed(table: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """At least one key, so that joins of sums are equi-joins."""
    return (table, keys) if keys else (table.withColumn(_ONE, F.lit(1)), [_ONE])


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _margins(table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table.groupBy(*keys, "t").agg(F.sum("nij").alias("ai"))
    columns = table.groupBy(*keys, "p").agg(F.sum("nij").alias("bj"))
    return rows, columns, table.groupBy(*keys).agg(F.sum("nij").alias("n"))


def rand_value(cells: Column, a: Column, b: Column, n: Column) -> Column:
    """Adjusted Rand from sums of pairs in cells, rows and columns; 1 or 0 where it has no spread."""
    expected = F.coalesce(F.try_divide(a * b, _pairs(n)), F.lit(0.0))
    top, bottom = cells - expected, (a + b) / 2 - expected
    return F.when(F.abs(bottom) < 1e-10, F.when(F.abs(top) < 1e-10, 1.0).otherwise(0.0)).otherwise(F.try_divide(top, bottom))


def ari_of(table: DataFrame, keys: list[str]) -> DataFrame:
    asked = keys
    table, keys = _keyed(table, keys)
    rows, columns, whole = _margins(table, keys)
    s = table.groupBy(*keys).agg(F.sum(_pairs(C("nij"))).alias("s"))
    a = rows.groupBy(*keys).agg(F.sum(_pairs(C("ai"))).alias("a"))
    b = columns.groupBy(*keys).agg(F.sum(_pairs(C("bj"))).alias("b"))
    return whole.join(s, keys).join(a, keys).join(b, keys).select(*asked, rand_value(C("s"), C("a"), C("b"), C("n")).alias("value"))


def ari(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index."""
    return ari_of(contingency(df, truth, pred, keys), keys or [])


def _stirling(m: Column) -> Column:
    """ln m!: exact sums below 16, the Stirling series above (relative error under 1e-14)."""
    x = m.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    exact = F.log(F.element_at(F.array(*(F.lit(float(_FACTORIAL[i])) for i in range(16))), (F.least(m, F.lit(15)) + 1).cast("int")))
    return F.when(m < 16, exact).otherwise(series)


_FACTORIAL = [1]
for _i in range(1, 16):
    _FACTORIAL.append(_FACTORIAL[-1] * _i)


def ami_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted mutual information with the arithmetic mean of entropies.

    The expected information sums over possible cell counts; margins are grouped by
    their value first, so the sum runs over distinct pairs of margins only.
    """
    asked = keys
    table, keys = _keyed(table, keys)
    rows, columns, whole = _margins(table, keys)
    joined = table.join(rows, [*keys, "t"]).join(columns, [*keys, "p"]).join(whole, keys)
    mi = joined.groupBy(*keys).agg(F.sum(C("nij") / C("n") * F.log(C("n") * C("nij") / (C("ai") * C("bj").cast("double")))).alias("mi"))
    entropy = lambda m, c: m.join(whole, keys).groupBy(*keys).agg((-F.sum(C(c) / C("n") * F.log(C(c) / C("n")))).alias(f"h_{c}"))
    ra = rows.groupBy(*keys, "ai").agg(F.count(F.lit(1)).alias("ca"))
    cb = columns.groupBy(*keys, "bj").agg(F.count(F.lit(1)).alias("cb"))
    grid = ra.join(cb, keys).join(whole, keys)
    low = F.greatest(F.lit(1).cast("long"), C("ai") + C("bj") - C("n"))
    # a pair of margins has as many terms as points: they are dealt out in stretches before they are listed
    stretches = grid.withColumn("from", F.explode(F.sequence(low, F.least("ai", "bj"), F.lit(STRETCH).cast("long")))).repartition(*keys, "ai", "bj", "from")
    each = stretches.withColumn("m", F.explode(F.sequence("from", F.least(C("from") + STRETCH - 1, "ai", "bj"))))
    f, m = _stirling, C("m")
    log_p = f(C("ai")) + f(C("bj")) + f(C("n") - C("ai")) + f(C("n") - C("bj")) - f(C("n")) - f(m) - f(C("ai") - m) - f(C("bj") - m) - f(C("n") - C("ai") - C("bj") + m)
    term = C("ca") * C("cb") * m / C("n") * F.log(C("n") * m / (C("ai") * C("bj").cast("double"))) * F.exp(log_p)
    emi = each.groupBy(*keys).agg(F.sum(term).alias("emi"))
    all_of = mi.join(entropy(rows, "ai"), keys).join(entropy(columns, "bj"), keys).join(emi, keys)
    mean = (C("h_ai") + C("h_bj")) / 2
    bottom = mean - C("emi")
    safe = F.when(bottom < 0, F.least(bottom, F.lit(-2.220446049250313e-16))).otherwise(F.greatest(bottom, F.lit(2.220446049250313e-16)))
    trivial = (C("h_ai") == 0) & (C("h_bj") == 0)
    return all_of.select(*asked, F.when(trivial, 1.0).otherwise((C("mi") - C("emi")) / safe).alias("value"))


def ami(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    return ami_of(contingency(df, truth, pred, keys), keys or [])


def class_tables(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, t, p, nij, size): for each true class the 2 x 2 table of class against its best cluster.

    Made from cells and margins: the points are not read again.
    """
    rows, columns, whole = _margins(table, keys)
    best = majority(table, keys).join(rows, [*keys, "t"])
    cell = best.join(table.withColumnRenamed("p", "best"), [*keys, "t", "best"]).join(columns.withColumnRenamed("p", "best"), [*keys, "best"]).join(whole, keys)
    cells = {(1, 1): C("nij"), (1, 0): C("ai") - C("nij"), (0, 1): C("bj") - C("nij"), (0, 0): C("n") - C("ai") - C("bj") + C("nij")}
    rows4 = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), c.alias("nij")) for (t, p), c in cells.items()))
    return cell.select(*keys, C("t").alias("class"), C("ai").alias("size"), F.explode(rows4).alias("e")).select(*keys, "class", "size", "e.*").where("nij > 0")


def balance(scores: DataFrame, keys: list[str], method: str = "macro") -> DataFrame:
    """Class scores (value, size) to one value."""
    weight = {"macro": F.lit(1.0), "weighted": C("size").cast("double"), "sqrt_weighted": F.sqrt(C("size")), "harmonic": 1.0 / C("size")}.get(method)
    if weight is None:
        raise ValueError(f"Unknown method: {method}")
    return scores.groupBy(*keys).agg((F.sum(C("value") * weight) / F.sum(weight)).alias("value"))


def balanced_external(df: DataFrame, truth: str, pred: str, score=ari_of, method: str = "macro", keys: list[str] | None = None) -> DataFrame:
    """The score of each true class against its best cluster, combined; 1 for a single class.

    score: any function of a contingency table (keys, t, p, nij) and its keys.
    """
    table, own = _keyed(contingency(df, truth, pred, keys), keys or [])
    binary = class_tables(table, own)
    sizes = binary.select(*own, "class", "size").distinct()
    scores = score(binary.drop("size"), [*own, "class"]).join(sizes, [*own, "class"])
    classes = sizes.groupBy(*own).agg(F.count(F.lit(1)).alias("classes"))
    out = balance(scores, own, method).join(classes, own)
    return out.select(*own, F.when(C("classes") == 1, 1.0).otherwise(C("value")).alias("value")).drop(_ONE)


def pairwise_classes(df: DataFrame, truth: str, pred: str, mode: str = "all_pairs", keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index over pairs of true classes, each on its own points (a class is also paired with itself).

    ``all_pairs``: the mean of all; ``within_between``: the mean of the averages of equal and of different pairs.
    Pairs of fewer than two points are left out.
    """
    if mode not in ("all_pairs", "within_between"):
        raise ValueError(f"Unknown mode: {mode}")
    table, own = _keyed(contingency(df, truth, pred, keys), keys or [])
    classes = table.select(*own, "t").distinct()
    pairs = classes.withColumnRenamed("t", "one").join(classes.withColumnRenamed("t", "two"), own).where("one <= two")
    cells = table.join(pairs, own).where((C("t") == C("one")) | (C("t") == C("two")))
    enough = cells.groupBy(*own, "one", "two").agg(F.sum("nij").alias("w")).where("w >= 2")
    scores = ari_of(cells, [*own, "one", "two"]).join(enough, [*own, "one", "two"])
    average = lambda when: F.coalesce(F.avg(F.when(when, C("value"))), F.lit(0.0))
    value = F.avg("value") if mode == "all_pairs" else (average(C("one") == C("two")) + average(C("one") < C("two"))) / 2
    return scores.groupBy(*own).agg(value.alias("value")).drop(_ONE)


def minmax_balanced(df: DataFrame, truth: str, pred: str, alpha: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """alpha times the mean class score and the rest times the worst, over classes of two points or more."""
    table, own = _keyed(contingency(df, truth, pred, keys), keys or [])
    binary = class_tables(table, own)
    scores = ari_of(binary.where("size >= 2").drop("size"), [*own, "class"])
    return scores.groupBy(*own).agg((alpha * F.avg("value") + (1 - alpha) * F.min("value")).alias("value")).drop(_ONE)


def stratified_subsample(df: DataFrame, truth: str, pred: str, row_id: str, per_class: int | None = None, rounds: int = 10, seed: int = 42) -> DataFrame:
    """Mean adjusted Rand index over rounds of equal numbers of points from each class (the smallest class's if not given).

    Points are drawn by the order of a seeded hash, so a lost task draws the same again.
    """
    sizes = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("size"))
    take = sizes.agg(F.min("size")).first()[0] if per_class is None else per_class
    rounds_of = df.select(F.col(truth).alias("t"), F.col(pred).alias("p"), F.col(row_id).alias("row_id"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).where("t is not null and p is not null")
    # points far from the front of the order cannot be drawn: most are left out before classes meet
    h = F.pmod(F.xxhash64("row_id", "round", F.lit(seed)), F.lit(1 << 40))
    near = rounds_of.join(sizes, "t").withColumn("h", h).where(C("h") <= (1 << 40) * F.least(F.lit(1.0), (3.0 * take + 60) / C("size")))
    drawn = near.withColumn("k", F.row_number().over(Window.partitionBy("round", "t").orderBy("h", "row_id"))).where(C("k") <= take)
    return ari_of(contingency(drawn, "t", "p", ["round"]), ["round"]).agg(F.avg("value").alias("value"))


def weighted_bootstrap(df: DataFrame, truth: str, pred: str, row_id: str, rounds: int = 10, seed: int = 42) -> DataFrame:
    """Mean adjusted Rand index over bootstrap rounds in which every class has the same expected weight.

    Each point is drawn a Poisson number of times whose mean is inverse to its class size.
    """
    sizes = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k")).first()
    rate = F.lit(float(whole["n"] or 0) / max(whole["k"], 1)) / C("size")
    # a large mean is drawn in parts of at most 8, each with its own hash; their number adds up to no more than the points and an eighth
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(rate / 8), F.lit(1))).withColumn("rate", rate / C("parts"))
    # Poisson distribution function of a part, as far as the 52 bits of a hash can tell
    term = F.exp(-C("rate"))
    step = lambda s, k: F.struct((s["below"] + s["term"]).alias("below"), (s["term"] * C("rate") / (k + 1)).alias("term"), F.concat(s["all"], F.array(s["below"] + s["term"])).alias("all"))
    below = F.aggregate(F.sequence(F.lit(0), F.lit(59)), F.struct(F.lit(0.0).alias("below"), term.alias("term"), F.array().cast("array<double>").alias("all")), step, lambda s: s["all"])
    sizes = sizes.withColumn("below", below)
    seeds = F.when(C("part") == 0, F.xxhash64("row_id", "round", F.lit(seed))).otherwise(F.xxhash64("row_id", "round", F.lit(seed), "part"))
    u = (F.pmod(seeds, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = df.select(F.col(truth).alias("t"), F.col(pred).alias("p"), F.col(row_id).alias("row_id"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).where("t is not null and p is not null").join(sizes, "t")
    drawn = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), (C("parts") - 1).cast("int")))).withColumn("u", u)
    table = drawn.withColumn("w", F.size(F.filter("below", lambda x: C("u") > x))).where("w > 0").groupBy("round", "t", "p").agg(F.sum("w").alias("nij"))
    return ari_of(table, ["round"]).agg(F.avg("value").alias("value"))
