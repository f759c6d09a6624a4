"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records are hashed into a fixed number of virtual slots.  Bytes and rows are
aggregated per slot, and a map says which shard has which slot.  The first version
of the map deals the slots round-robin; rebalancing edits it: a shard keeps its
largest slots as long as they fit into an equal share of the bytes, and the slots
that do not fit move, largest first, to the shard with the fewest bytes.  Every
version is a row set ``version, vslot, shard`` in a table in a folder that driver and executors share; rebalancing reads the
latest version from it and adds the next.

The map has as many rows as there are slots (a constant), so broadcasting it and
folding over it does not grow with the data.

Defined results: a null text has no bytes and counts as its 8 bytes of framing; a
record's slot comes from its id and the checksum of its text, so rows that share
an id still spread; a group of equal texts is spread as well, because this law deals bytes and keeps nothing together; of rows that agree in id, checksum and size each has a place of
its own; a null id is hashed as such and comes first in its slot; an empty table gives an empty result and a complete map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argloom.llm._spark import cut, shared_path

SLOTS = 4096
FRAMING = 8


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, vslot``."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + FRAMING).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(spark: SparkSession, rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every virtual slot with its ``bytes`` and ``n_rows``."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").na.fill(0, ["bytes", "n_rows"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def _least_loaded(free: Column, loads: Column) -> Column:
    """Deals ``free`` (slots, largest first) one by one to the shard with the least load; the shard of each."""
    zero = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def give(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda v, i: F.when(i == to, v + slot["bytes"]).otherwise(v))
        return F.struct(grown.alias("loads"), F.concat(acc["to"], F.array(to)).alias("to"))

    return F.aggregate(free, zero, give, lambda acc: acc["to"])


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for ``shards`` shards, given the slots' present sizes."""
    now = slot_map.join(sizes, "vslot")
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    share = sizes.agg((F.sum("bytes") / shards).alias("share"))
    marked = now.withColumn("upto", F.sum("bytes").over(largest_first)).join(F.broadcast(share), F.lit(True))
    marked = marked.withColumn("stays", (F.col("shard") < shards) & (F.col("upto") <= F.col("share")))
    gathered = marked.groupBy("version").agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot"))), asc=False).alias("free"),
        *(F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("bigint").alias(f"_load{k}") for k in range(shards)),
    )
    moved = gathered.select("version", "free", _least_loaded(F.col("free"), F.array(*(F.col(f"_load{k}") for k in range(shards)))).alias("to"))
    moved = moved.select(F.explode(F.arrays_zip("free", "to")).alias("m")).select(F.col("m.free.vslot").alias("vslot"), F.col("m.to").alias("_to"))
    return marked.join(F.broadcast(moved), "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("_to", "shard").alias("shard"))


def assign(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the gapless place of the row in its shard.

    Places are counted within each virtual slot and moved by the rows of the shard's earlier slots, so no task sees a whole shard.
    """
    placed = slot_map.join(sizes, "vslot").withColumn("_before", F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_rows"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("_within", within).join(F.broadcast(placed.select("vslot", "shard", "_before")), "vslot").select(*rows.columns, "shard", (F.col("_before") + F.col("_within")).cast("bigint").alias("slot"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds one version to a stored map, in a folder of its own; earlier versions stay.  If the version is there already, another writer was first, and this one fails."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, by default the latest; an error if writers that raced have left two shards for a slot."""
    every = spark.read.parquet(path).select(F.col("version").cast("int").alias("version"), "vslot", "shard")
    found = every.filter(F.col("version") == (every.agg(F.max("version")).first()[0] if version is None else version))
    if not found.groupBy("vslot").count().filter("count > 1").isEmpty():
        raise ValueError(f"a version of the slot map at {path} was written twice")
    return found


def rebalance_stored(spark: SparkSession, path: str, sizes: DataFrame, shards: int) -> DataFrame:
    """Edits the latest stored map for the slots' present sizes and ``shards`` shards, stores the result as the next version and returns it."""
    save_map(rebalance(stored_map(spark, path), sizes, shards), path)
    return stored_map(spark, path)


def shard_by_bytes(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, str]:
    """Deals ``docs`` into shards of near equal bytes by the map stored at ``path``; also returns that path.

    Where nothing is stored yet (no ``path``), a map is begun below the shared checkpoint folder.  Rows carry the ``map_version`` that placed
    them and ``map_shard``, the shard of their virtual slot in the version before.
    """
    spark = docs.sparkSession
    rows = records(docs, slots, id_col, text_col)
    sizes = cut(slot_sizes(spark, rows, slots))
    if path is None:
        path = shared_path(spark, "slot-map")
        save_map(first_map(spark, shards, slots), path)
    before = stored_map(spark, path).select("vslot", F.col("shard").alias("map_shard"))
    now = rebalance_stored(spark, path, sizes, shards)
    history = F.broadcast(now.join(before, "vslot").select("vslot", F.col("version").alias("map_version"), "map_shard"))
    return assign(rows, now, sizes).join(history, "vslot"), path
