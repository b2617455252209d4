"""Cosine search over weighted feature profiles by a weighted prefix index.

Units with equal profiles are one class, and classes are compared. All features have one order, those that few classes have first. With
profiles of length 1, the dot product of two of them is at most the product of what is left of each from their first common
feature on. So a feature is indexed only while the rest of its profile, itself included, is as long as the limit, and two classes meet
on it only if the product of their rests is. The common features come last and are hardly ever indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as ms
from .dealing import dealt_join
from .similarity import _kept, linked_sets

#: Features of which two units must share one.
TELLING = "^(ret|form|cflowseq|target):"
_SLACK = 1e-9


def classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (unit_id, cls), and classes (cls, head: its smallest unit, vector: feature and weight, of length 1). profiles: unit_id,
    features (array of feature and weight; repeated features add up)."""
    rows = profiles.select("unit_id", F.explode("features").alias("x")).groupBy("unit_id", "x.feature").agg(F.sum("x.weight").alias("weight"))
    whole = rows.filter("weight > 0").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("feature", F.round("weight", 9).alias("weight")))).alias("features"))
    held = _kept(whole.select("unit_id", F.sha2(F.to_json("features"), 256).alias("cls"), "features"))
    heads = held.groupBy("cls").agg(F.min("unit_id").alias("head"), F.first("features").alias("features"))
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    vector = F.transform("features", lambda x: F.struct(x["feature"].alias("feature"), (x["weight"] / F.col("norm")).alias("w")))
    return held.select("unit_id", "cls"), _kept(heads.withColumn("norm", norm).select("cls", "head", vector.alias("vector")))


def prefix_index(heads: DataFrame, least: float) -> DataFrame:
    """feature, cls, rest: the indexed features of each class, and the length of its profile from there on."""
    rows = heads.select("cls", F.explode("vector").alias("x")).select("cls", "x.feature", "x.w")
    counts = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    # one row a feature in counts; a common feature's rows are dealt
    ordered = Window.partitionBy("cls").orderBy(F.desc("df"), F.desc("feature"))
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = dealt_join(rows, counts, "feature", "cls").withColumn("rest", rest)
    return ranked.filter(F.col("rest") >= least - _SLACK).select("feature", "cls", "rest")


def candidates(index: DataFrame, least: float) -> DataFrame:
    """Classes ca < cb that meet on an indexed feature where the bound still allows the limit."""
    one = index.select("feature", F.col("cls").alias("ca"), F.col("rest").alias("ra"))
    two = index.select("feature", F.col("cls").alias("cb"), F.col("rest").alias("rb"))
    met = dealt_join(one, two, "feature", "ca").filter((F.col("ca") < F.col("cb")) & (F.col("ra") * F.col("rb") >= least - _SLACK))
    return met.select("ca", "cb").distinct()


def class_links(heads: DataFrame, least: float, telling: str = TELLING) -> DataFrame:
    """ca, cb, score of classes with a cosine of `least` and a telling feature in common; a class with itself scores 1."""
    pairs = _kept(candidates(_kept(prefix_index(heads, least)), least))
    left = heads.select(F.col("cls").alias("ca"), F.col("vector").alias("va"))
    right = heads.select(F.col("cls").alias("cb"), F.map_from_entries("vector").alias("vb"))
    both = dealt_join(dealt_join(pairs, left, "ca", "cb"), right, "cb", "ca", pairs)
    dot = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.col("vb")[x["feature"]], F.lit(0.0)))
    told = F.exists("va", lambda x: x["feature"].rlike(telling) & F.map_contains_key("vb", x["feature"]))
    scored = both.filter(told).select("ca", "cb", dot.alias("score")).filter(F.col("score") >= least - _SLACK)
    same = heads.filter(F.exists("vector", lambda x: x["feature"].rlike(telling))).select(F.col("cls").alias("ca"), F.col("cls").alias("cb"), F.lit(1.0).alias("score"))
    return scored.unionByName(same)


def structural_pairs(profiles: DataFrame, least: float, telling: str = TELLING) -> DataFrame:
    """All pairs a < b of units, with score and bucket. A class of n equal profiles has n (n - 1) / 2 of them; structural_sets() has
    its units once."""
    members, heads = classes(profiles)
    first, second = members.select(F.col("cls").alias("ca"), F.col("unit_id").alias("x")), members.select(F.col("cls").alias("cb"), F.col("unit_id").alias("y"))
    out = class_links(heads, least, telling).join(first, "ca").join(second, "cb").filter((F.col("ca") != F.col("cb")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score").withColumn("bucket", ms.similarity_bucket(F.col("score"), 0.90, 0.80))


def structural_sets(profiles: DataFrame, least: float, telling: str = TELLING) -> DataFrame:
    """unit_id, root, size, weakest, bucket: the sets that pairs make, a row a unit; root is the set's smallest unit, weakest the least
    score of a pair in it. Units without a partner have no row."""
    members, heads = classes(profiles)
    members = _kept(members)
    links = _kept(class_links(heads, least, telling))
    head = heads.select("cls", "head")
    named = links.filter("ca <> cb").join(head.select(F.col("cls").alias("ca"), F.col("head").alias("a")), "ca").join(head.select(F.col("cls").alias("cb"), F.col("head").alias("b")), "cb")
    pairs = _kept(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"))
    roots = _kept(linked_sets(pairs).withColumnRenamed("node", "head"))
    telling_class = links.filter("ca = cb").select(F.col("ca").alias("cls"), F.lit(True).alias("telling"))
    placed = dealt_join(members, head.join(telling_class, "cls", "left").join(roots, "head", "left"), "cls", "unit_id")
    # a class of several units is a set even if no other class is like it
    placed = _kept(placed.select("unit_id", "telling", F.coalesce("root", "head").alias("root"), F.col("root").isNotNull().alias("linked")))
    weakest = pairs.join(roots, F.col("a") == F.col("head")).groupBy("root").agg(F.min("score").alias("weakest"))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.max("linked").alias("linked"), F.max("telling").alias("telling")).filter((F.col("size") > 1) & (F.col("linked") | F.col("telling")))
    out = dealt_join(placed.select("unit_id", "root"), sizes.select("root", "size").join(weakest, "root", "left"), "root", "unit_id")
    out = out.withColumn("weakest", F.coalesce("weakest", F.lit(1.0)))
    return out.withColumn("bucket", ms.similarity_bucket(F.col("weakest"), 0.90, 0.80))
