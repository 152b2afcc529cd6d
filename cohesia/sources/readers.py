"""Readers for labelled point sets: whitespace text with label files, ARFF, header-less CSV, and the relational tables.

Text lines get their place by file offsets of a single ordered pass (``zipWithIndex`` over the file's
splits in order), so files of any size are read in parallel; blank lines do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohesia.operators.frames import points

C = F.col


def _lines(spark: SparkSession, path: str, skip: str = "") -> DataFrame:
    """(pos, value): the non-blank lines of a file in order, without those that begin with a character of skip."""
    text = spark.read.text(path).where((F.trim("value") != "") & ~F.substring(F.trim("value"), 1, 1).isin(list(skip)))
    # splits of one file are read in order: the id's upper bits number them, so ranks follow from counts a split
    marked = text.select("value", F.monotonically_increasing_id().alias("mid")).withColumn("part", F.shiftright("mid", 33)).withColumn("at", C("mid").bitwiseAND((1 << 33) - 1))
    sizes = marked.groupBy("part").agg((F.max("at") + 1).alias("n"))
    offset = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))  # one row a split
    return marked.join(F.broadcast(offset), "part").select((C("at") + C("o")).alias("pos"), F.trim("value").alias("value"))


def read_points(spark: SparkSession, data_path: str, labels_path: str, dataset: str = "data") -> DataFrame:
    """Whitespace-separated coordinates and one integer label a line; raises if their numbers differ."""
    x = _lines(spark, data_path).select("pos", F.transform(F.split("value", r"\s+"), lambda v: v.cast("double")).alias("x"))
    y = _lines(spark, labels_path).select("pos", F.split("value", r"\s+")[0].cast("double").cast("int").alias("label"))
    both = x.join(y, "pos", "full")
    checked = both.select(
        F.coalesce("pos", F.raise_error(F.lit("no position"))).alias("pos"),
        F.when(C("x").isNull() | C("label").isNull(), F.raise_error(F.lit(f"{data_path} and {labels_path} have different numbers of rows")).cast("array<double>")).otherwise(C("x")).alias("x"), "label",
    )
    return points(checked, C("pos"), C("x"), C("label"), dataset)


def _coded(df: DataFrame, value: str) -> DataFrame:
    """label: the place of each class name in lexicographic order; only distinct names are ranked."""
    names = df.select(value).distinct()
    codes = names.withColumn("label", (F.row_number().over(Window.orderBy(value)) - 1).cast("int"))
    return df.join(codes, value)


def read_arff(spark: SparkSession, path: str, dataset: str = "data") -> DataFrame:
    """ARFF with numeric attributes and the class last."""
    rows = _lines(spark, path, "@%").withColumn("cells", F.transform(F.split("value", ","), lambda v: F.trim(v)))
    cut = rows.select("pos", F.transform(F.slice("cells", 1, F.size("cells") - 1), lambda v: v.cast("double")).alias("x"), F.element_at("cells", -1).alias("name"))
    return points(_coded(cut, "name"), C("pos"), C("x"), C("label"), dataset)


def read_csv(spark: SparkSession, path: str, dataset: str = "data") -> DataFrame:
    """Header-less CSV with the label last."""
    rows = _lines(spark, path).withColumn("cells", F.transform(F.split("value", ","), lambda v: F.trim(v)))
    cut = rows.select("pos", F.transform(F.slice("cells", 1, F.size("cells") - 1), lambda v: v.cast("double")).alias("x"), F.element_at("cells", -1).cast("double").cast("int").alias("label"))
    return points(cut, C("pos"), C("x"), C("label"), dataset)


def catalogue(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Many data sets of one folder (name.data with name.labels0) as one frame."""
    out = None
    for name in names:
        one = read_points(spark, f"{root}/{name}.data", f"{root}/{name}.labels0", name.rsplit("/", 1)[-1])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a catalogue needs names")
    return out


#: Catalogues of data sets by the folder they lie in.
SETS = {
    "s": ["s/s1", "s/s2", "s/s3", "s/s4"], "a": ["a/a1", "a/a2", "a/a3"], "g": [f"g2mg/g2mg_2_{n}" for n in range(10, 100, 10)],
    "graves": ["graves/parabolic", "graves/ring", "graves/zigzag", "graves/ring_noisy", "graves/ring_outliers", "graves/zigzag_noisy", "graves/zigzag_outliers"],
    "sipu": ["sipu/aggregation", "sipu/compound", "sipu/d31", "sipu/jain", "sipu/pathbased", "sipu/spiral", "sipu/unbalance"],
    "uci": ["uci/ecoli", "uci/glass", "uci/ionosphere", "uci/sonar", "uci/wdbc", "uci/wine", "uci/yeast"], "wut": ["wut/x1", "wut/x2", "wut/x3", "wut/trajectories"],
}


def read_set(spark: SparkSession, root: str, name: str) -> DataFrame:
    return catalogue(spark, root, SETS[name])


# Point frames over the relational tables.


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _codes(df: DataFrame, value: str) -> DataFrame:
    """df with code: the dense rank of a column's values, ranked over distinct values only."""
    ranked = df.select(value).distinct().withColumn("code", F.row_number().over(Window.orderBy(value)) - 1)
    return df.join(ranked, value)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(_table(spark, sf_dir, "embeddings"), C("vec_id"), C("embedding"), C("label"), "embeddings")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(_codes(_table(spark, sf_dir, "part"), "p_brand"), C("p_partkey"), F.array(C("p_size").cast("double"), C("p_retailprice")), C("code"), "part")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = _table(spark, sf_dir, "supplier").join(nation, C("s_nationkey") == C("n_nationkey"))
    return points(joined, C("s_suppkey"), F.array(C("s_acctbal"), C("s_nationkey").cast("double")), C("n_regionkey"), "supplier")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear indices only: row_id tells the rows of a table apart but has no order to rely on."""
    t = _table(spark, sf_dir, "lineitem")
    codes = t.select("l_returnflag").distinct().withColumn("code", F.row_number().over(Window.orderBy("l_returnflag")) - 1)
    return points(t.join(codes, "l_returnflag"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.array(C("l_quantity"), C("l_extendedprice")), C("code"), "lineitem")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(_codes(_table(spark, sf_dir, "customer"), "c_mktsegment"), C("c_custkey"), F.array(C("c_acctbal"), C("c_nationkey").cast("double")), C("code"), "customer")


