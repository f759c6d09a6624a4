"""Stored records: keyed writes with checks, checkpoints, lineage by parent pointers, interchange as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argloom.operators.iterate import cut, dealt

MAX_DEPTH = 64
#: Levels of nested values that :func:`leaf_fingerprints` opens in one plan.
LEVELS = 8


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``incoming`` in the place of those that have the same keys."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def upsert_relations(current: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keyed upsert of relations (``source, target, relation``); those with an end that is no node are left out."""
    ids = nodes.select("node_id").distinct()
    for end in ("source", "target"):
        incoming = incoming.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return upsert_latest(current, incoming.select(*current.columns), ["source", "target", "relation"])


def commit_batch(triples: DataFrame, batch: DataFrame, done: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """The triples after a batch, and the items that are done after it: a batch's item that was done before adds nothing, so a batch may run twice."""
    fresh = batch.join(done.select(item), item, "left_anti")
    committed = cut(fresh.select(item).distinct())  # a later batch reads this instead of joining the earlier ones again
    return triples.unionByName(fresh.select(*triples.columns)), done.select(item).unionByName(committed)


def cleared(done: DataFrame, phase: str) -> DataFrame:
    """Checkpoints without those of one phase."""
    return done.filter(F.col("phase") != phase)


def serialized(values: dict[str, Column], json: dict[str, Column]) -> Column:
    """A map of properties as text: plain values as they are, nested ones as JSON, nulls left out."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]
    entries += [F.struct(F.lit(k).alias("key"), F.to_json(v).alias("value")) for k, v in json.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def lineage(rows: DataFrame, id_col: str, parent_col: str, most: int = MAX_DEPTH) -> DataFrame:
    """``id, ancestor, depth`` for every row and all its ancestors (itself at depth 0).

    Ancestors are found by doubling: after k rounds all of up to 2^k steps are there.  A chain ends where a parent is
    missing or after ``most`` steps, so a cycle ends too.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    known = own.select("id")
    step = own.filter("parent IS NOT NULL").join(known.withColumnRenamed("id", "parent"), "parent", "left_semi")
    chain = cut(known.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(step.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))))
    reach = 1
    while reach < most:
        rows = chain.count()
        on = chain.filter(F.col("depth") > 0).select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = dealt(chain.filter(F.col("depth") == reach), rows, "ancestor").join(dealt(on, rows, "ancestor"), "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).filter(F.col("depth") <= most)
        longer = dealt(longer, rows, "id", "ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
        longer = cut(longer.join(dealt(chain.select("id", "ancestor"), rows, "id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if longer.isEmpty():
            break
        chain, reach = cut(chain.unionByName(longer)), 2 * reach
    return chain


def first_of_lineage(chain: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Per run and identity key the envelope that is met first on the way up the run's parents: ``id, identity_key, run_id``.

    ``chain`` as from :func:`lineage` over runs, ``envelopes`` has ``run_id, identity_key``.
    """
    rows = chain.count()
    met = dealt(chain, rows, "ancestor").join(dealt(envelopes.withColumnRenamed("run_id", "ancestor"), rows, "ancestor"), "ancestor")
    return met.groupBy("id", "identity_key").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("run_id"))


def stale_map(stale: DataFrame, by: str) -> DataFrame:
    """Stale artifacts listed by kind or phase: ``by, n, ids`` (in order)."""
    return stale.groupBy(by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def last_relation(rows: DataFrame, order: str) -> DataFrame:
    """``head, relation, tail`` rows as a digraph: ends are given, and of several relations of a pair the last by ``order`` stays (ties: the greatest name)."""
    given = rows.filter("head IS NOT NULL AND tail IS NOT NULL")
    return given.groupBy("head", "tail").agg(F.max_by("relation", F.struct(order, "relation")).alias("relation"))


def fingerprint(row: Column) -> Column:
    """A hash of a struct as JSON; its fields must be in order of their names."""
    return F.sha2(F.to_json(row), 256)


def flattened(df: DataFrame, key: str) -> DataFrame:
    """``key, path, value``: every leaf of the nested columns of ``df``, as text, by its dotted path."""

    def leaves(schema, path: str) -> list[str]:
        out = []
        for field in schema.fields:
            name = f"{path}.{field.name}" if path else field.name
            out += leaves(field.dataType, name) if hasattr(field.dataType, "fields") else [name]
        return out

    paths = [p for p in leaves(df.schema, "") if p != key]
    entries = F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in paths))
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.path", "e.value")


def bounded_distinct(items: Column, most: int = 15) -> Column:
    """The last ``most`` distinct items in order of their first occurrence."""
    one = F.array_distinct(items)
    return F.slice(one, F.greatest(F.lit(1), F.size(one) - most + 1), most)


def first_source(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """A search corpus from several sources; of entries with the same key, the one of the earliest source stays."""
    every = None
    for i, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    ranked = every.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_source")))
    return ranked.filter("_r = 1").drop("_r", "_source")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two folders of JSON lines."""
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, nodes, edges) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a written graph, by their schemas."""
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/edges")


def _opened(rows: DataFrame) -> DataFrame:
    """``id, path, v, leaf`` with every value of ``rows(id, path, v)`` opened by a level; one that holds nothing more stays, as a leaf."""
    inner = rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select("pos", "key", F.col("value").alias("inner"))
    leaf = F.col("pos").isNull()
    field = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
    place = F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    path = F.when(leaf, F.col("path")).when(F.col("key").isNull(), place).otherwise(field)
    return rows.lateralJoin(inner).select("id", path.alias("path"), F.when(leaf, F.col("v")).otherwise(F.col("inner")).alias("v"), leaf.alias("leaf"))


def leaf_fingerprints(rows: DataFrame) -> DataFrame:
    """``id, path, fingerprint`` of every leaf of ``rows(id, v)``, ``v`` a VARIANT of any shape.

    Fields are joined by dots, places of arrays stand in brackets (``lines[0].tags[1]``); the fingerprint is the SHA-256 of the
    leaf as JSON.  An empty object or array is a leaf.  A null ``v``, and a bare scalar, has no path and gives no row.  A
    round opens :data:`LEVELS` levels in one plan, and only values that go deeper are stored for the next.
    """
    found = None
    front = cut(rows.filter("v IS NOT NULL").select("id", F.lit("").alias("path"), "v"))
    while not front.isEmpty():
        for _ in range(LEVELS):
            front = _opened(front)
        leaf = front.filter("leaf AND path <> ''").select("id", "path", F.sha2(F.encode(F.to_json("v"), "UTF-8"), 256).alias("fingerprint"))
        found = leaf if found is None else found.unionByName(leaf)
        front = cut(front.filter("NOT leaf").select("id", "path", "v"))
    return found if found is not None else front.select("id", "path", F.lit("").alias("fingerprint"))
