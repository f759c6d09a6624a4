"""Mixing sources to target weights by Pfair scheduling.

Each source has a whole number of shares as its target weight.  Documents of a
source are dealt into blocks; a source with ``a`` of ``D`` shares has its k-th block
(from 0) of a round released at slot ``floor(k * D / a)`` and due at
``ceil((k + 1) * D / a)``.  A round has D slots; each slot goes to the released block
with the earliest deadline.  On one sequence this schedule meets every deadline, so
after every slot each source is within less than one block of its target.  The
pattern repeats with each round, so only one round is laid out: a fold over D slots.
When a source has no more blocks, the rest go on in proportion to their shares, with
a pattern of their own (one row, and so one fold, per set of sources that remain).

Only DataFrame functions are used.  Documents are numbered within (source, bucket)
and moved by the counts of earlier buckets, so a source with a third of all rows is
spread over all tasks.  No document is dropped, repeated or sampled.

Defined results: a null source is a source of its own; documents of a source are in
order of a hash of their id, then the id, and repeated rows follow each other; a
source without given shares gets one share; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.llm._spark import broadcast_if_small, cut, shuffle_partitions

BLOCK_ROWS = 8
TOTAL_SHARES = 1000


def default_shares(counts: DataFrame, power: float = 0.5, total: int = TOTAL_SHARES) -> DataFrame:
    """Shares in proportion to a power of each source's rows, at least one each: ``source_key, shares``."""
    whole = counts.agg(F.sum(F.pow("n_rows", F.lit(power))).alias("_whole"))
    share = F.greatest(F.lit(1), F.round(F.pow("n_rows", F.lit(power)) / F.col("_whole") * total)).cast("bigint")
    return counts.join(F.broadcast(whole), F.lit(True)).select("source_key", share.alias("shares"))


def _one_round(shares: Column) -> Column:
    """Earliest deadline first over one round: for each slot, the index (into ``shares``) of the source that gets it."""
    n = F.size(shares)
    total = F.aggregate(shares, F.lit(0).cast("bigint"), lambda a, x: a + x)
    zero = F.struct(F.transform(shares, lambda _: F.lit(0).cast("bigint")).alias("given"), F.array().cast("array<int>").alias("order"))

    def slot(acc: Column, t: Column) -> Column:
        def key(a: Column, i: Column) -> Column:
            k = acc["given"][i]
            due = F.floor(((k + 1) * total + a - 1) / a)
            return F.when((k < a) & (F.floor(k * total / a) <= t), due * n + i)

        first = F.array_min(F.transform(shares, key)) % n
        return F.struct(F.transform(acc["given"], lambda g, i: F.when(i == first, g + 1).otherwise(g)).alias("given"), F.concat(acc["order"], F.array(first.cast("int"))).alias("order"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), total - 1), zero, slot, lambda acc: acc["order"])


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))


def mix_order(docs: DataFrame, shares: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row: ``doc_id, source, shares, block, round, slot, release, deadline``; the mixed sequence is ordered by (round, slot, doc_id).

    ``shares``: ``source, shares`` (whole numbers from 1); by default in proportion to the square root of a source's rows.
    """
    spark = docs.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(source_col).alias("source_key")).withColumn("_h", F.xxhash64("doc_id")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    by_bucket = cut(rows.groupBy("source_key", "_bucket").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = by_bucket.select("source_key", "_bucket", before.alias("_before"))

    counts = by_bucket.groupBy("source_key").agg(F.sum("n").alias("n_rows"))
    target = default_shares(counts) if shares is None else counts.join(shares.select(_key("source").alias("source_key"), F.greatest(F.lit(1), "shares").cast("bigint").alias("shares")), "source_key", "left").select("source_key", F.coalesce("shares", F.lit(1).cast("bigint")).alias("shares"))
    rounds = F.ceil(F.ceil(F.col("n_rows") / block_rows) / F.col("shares")).cast("bigint")
    sources = counts.join(target, "source_key").withColumn("rounds", rounds).drop("n_rows")

    # The sources are one short array: what depends on which of them remain is worked out within its row.
    one = sources.agg(F.sort_array(F.collect_list(F.struct("rounds", "source_key", "shares"))).alias("s"))
    one = one.withColumn("ends", F.array_distinct("s.rounds"))
    remain = lambda until: F.filter("s", lambda x: x["rounds"] >= until)
    span = lambda until, i: F.struct(
        F.when(i > 0, F.col("ends")[F.greatest(i - 1, F.lit(0))]).otherwise(F.lit(0).cast("bigint")).alias("from"),
        until.alias("until"),
        F.aggregate(remain(until), F.lit(0).cast("bigint"), lambda total, x: total + x["shares"]).alias("total"),
    )
    one = cut(one.withColumn("spans", F.transform("ends", span)))
    spans = one.select(F.explode("s").alias("x"), "spans").select("x.source_key", "x.shares", "spans")
    patterns = one.select(F.explode("ends").alias("until"), "s").select("until", F.sort_array(F.transform(remain(F.col("until")), lambda x: F.struct(x["source_key"].alias("source_key"), x["shares"].alias("shares")))).alias("s"))
    laid = patterns.repartition("until").select("until", "s", F.posexplode(_one_round(F.col("s.shares"))).alias("slot", "i")).select("until", F.col("s")[F.col("i")]["source_key"].alias("source_key"), "slot")
    laid = cut(laid.withColumn("k", F.row_number().over(Window.partitionBy("until", "source_key").orderBy("slot")) - 1))

    within = F.row_number().over(Window.partitionBy("source_key", "_bucket").orderBy("_h", "doc_id")) - 1
    numbered = rows.withColumn("_within", within).join(broadcast_if_small(offsets), ["source_key", "_bucket"]).join(broadcast_if_small(spans), "source_key")
    block = F.floor((F.col("_before") + F.col("_within")) / block_rows)
    placed = (
        numbered.withColumn("block", block)
        .withColumn("round", F.floor(F.col("block") / F.col("shares")))
        .withColumn("k", F.col("block") % F.col("shares"))
        .withColumn("_span", F.filter("spans", lambda x: (x["from"] <= F.col("round")) & (F.col("round") < x["until"]))[0])
        .withColumn("until", F.col("_span.until"))
        .withColumn("_total", F.col("_span.total"))
    )
    return placed.join(broadcast_if_small(laid), ["until", "source_key", "k"]).select(
        "doc_id",
        "source",
        "shares",
        "block",
        "round",
        F.col("slot").cast("bigint").alias("slot"),
        F.floor(F.col("k") * F.col("_total") / F.col("shares")).alias("release"),
        F.ceil((F.col("k") + 1) * F.col("_total") / F.col("shares")).alias("deadline"),
    )


def mix(docs: DataFrame, shares: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` in mixed order: partitions, and so the files written from them, hold consecutive parts of the sequence.  Rows that repeat an id stand together, at its first place."""
    place = F.min(F.struct(F.col("round").alias("_argloom_round"), F.col("slot").alias("_argloom_slot")))
    order = cut(mix_order(docs, shares, id_col, source_col, block_rows).groupBy(F.col("doc_id").alias("_argloom_id")).agg(place.alias("_p")).select("_argloom_id", "_p.*"))
    joined = docs.join(order.hint("shuffle_hash"), docs[id_col].eqNullSafe(order["_argloom_id"]))
    by = ["_argloom_round", "_argloom_slot", "_argloom_id"]
    return joined.repartitionByRange(shuffle_partitions(docs.sparkSession), *by).sortWithinPartitions(*by).drop(*by)
