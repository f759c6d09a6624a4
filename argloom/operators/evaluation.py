"""Calibration, research dynamics, soft matching, Pareto frontier, perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calibration_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Of ``confidence, label``: per bin its count, mean confidence (its middle if empty), accuracy and gap; the last bin is closed."""
    spark = pairs.sparkSession
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    of = pairs.select(c.alias("c"), "label").withColumn("bin", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int"))
    found = of.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg("label").alias("accuracy"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("mean_confidence", (F.col("bin") + 0.5) / bins).alias("mean_confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
    return joined.withColumn("gap", F.when(F.col("n") > 0, F.abs(F.col("accuracy") - F.col("mean_confidence"))).otherwise(0.0))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error and Brier score; all 0 without pairs."""
    b = calibration_bins(pairs, bins)
    errors = b.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("gap")), F.sum("n")), F.lit(0.0)).alias("ece"), F.max("gap").alias("mce"))
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))) - F.col("label")
    return errors.join(F.broadcast(pairs.agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier"))), F.lit(True))


def degeneration(snapshots: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Of ``epoch, kind, item`` (consecutive epochs): per step the new auxiliary and empirical items, the anomalies, and the degeneration index."""
    before = snapshots.select((F.col("epoch") + 1).alias("epoch"), "kind", "item")
    new = snapshots.join(before, ["epoch", "kind", "item"], "left_anti")
    count = lambda df, kind, name: df.filter(F.col("kind") == kind).groupBy("epoch").agg(F.count("*").alias(name))
    first = snapshots.agg(F.min("epoch").alias("_first"))
    steps = snapshots.select("epoch").distinct().join(F.broadcast(first), F.col("epoch") > F.col("_first")).drop("_first")
    for part in (count(new, "auxiliary", "new_auxiliary"), count(new, "empirical", "new_empirical"), count(snapshots, "anomaly", "anomalies")):
        steps = steps.join(part, "epoch", "left")
    steps = steps.na.fill(0)
    return steps.withColumn("di", (F.col("new_auxiliary") + F.col("anomalies")) / (F.col("new_empirical") + eps))


def dropped_core(snapshots: DataFrame) -> DataFrame:
    """``epoch, n_dropped``: how many core items of the first epoch a later epoch lacks (violations of core invariance), where it lacks any.

    What is there is counted, so the work follows the rows and not the product of items and epochs.
    """
    first = snapshots.agg(F.min("epoch").alias("_first"))
    items = snapshots.filter("kind = 'core'").join(F.broadcast(first), F.col("epoch") == F.col("_first")).select("item").distinct()
    later = snapshots.join(F.broadcast(first), F.col("epoch") > F.col("_first"))
    kept = later.filter("kind = 'core'").select("epoch", "item").distinct().join(items, "item", "left_semi").groupBy("epoch").agg(F.count("*").alias("kept"))
    whole = items.agg(F.count("*").alias("whole"))
    counts = later.select("epoch").distinct().join(kept, "epoch", "left").join(F.broadcast(whole), F.lit(True))
    return counts.select("epoch", (F.col("whole") - F.coalesce("kept", F.lit(0))).alias("n_dropped")).filter("n_dropped > 0")


def pareto(points: DataFrame, most: str, least: str, parts: int = 32) -> DataFrame:
    """Points that no other dominates on the axes ``most`` (the more the better) and ``least``: at least as good on both and better on one.  Equal points stand for each other; a point without a value on an axis is left out.

    Of each distinct value of ``most`` only the least cost counts.  These are dealt to ranges from the best down; a range's
    best cost so far follows from the ranges before it, and within it from a running minimum.
    """
    from argloom.operators.iterate import cut

    given = points.filter(F.col(most).isNotNull() & F.col(least).isNotNull())
    best = given.groupBy(F.col(most).alias("_q")).agg(F.min(least).alias("_c"))
    dealt = cut(best.repartitionByRange(parts, F.desc("_q")).withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy("_part").agg(F.min("_c").alias("_m"))  # a row per range
    before = ranges.withColumn("_m", F.min("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("_part").orderBy(F.desc("_q")).rowsBetween(Window.unboundedPreceding, -1)
    front = dealt.join(F.broadcast(before), "_part").withColumn("_so_far", F.least(F.col("_m"), F.min("_c").over(within))).filter(F.col("_so_far").isNull() | (F.col("_c") < F.col("_so_far")))
    return given.join(front.select("_q", "_c"), (F.col(most) == F.col("_q")) & (F.col(least) == F.col("_c"))).drop("_q", "_c")


def sampled(rows: DataFrame, key: str, rate: float, salt: str = "") -> DataFrame:
    """A repeatable share of the rows, by the MD5 of their key."""
    share = F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(salt), F.col(key).cast("string")), "UTF-8")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.filter(share < rate)


def greedy_matching(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matching of ``ref, pred, score`` in the order of score, then ids: rounds of pairs that are each other's best, as greedy choice makes them."""
    from argloom.operators.iterate import cut

    left = cut(scores.filter(F.col("score") >= least))
    order = [F.desc("score"), "ref", "pred"]
    matched = None
    while not left.isEmpty():
        ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy("ref").orderBy(*order))).withColumn("_p", F.row_number().over(Window.partitionBy("pred").orderBy(*order)))
        best = cut(ranked.filter("_r = 1 AND _p = 1").select("ref", "pred", "score"))
        matched = best if matched is None else matched.unionByName(best)
        left = cut(left.join(best.select("ref"), "ref", "left_anti").join(best.select("pred"), "pred", "left_anti"))
    return matched if matched is not None else left.select("ref", "pred", "score")
