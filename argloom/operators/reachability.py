"""Reachability in directed graphs without their closure: components of mutual reach, labels that rule out paths, and counts by bit sets.

``edges(source, target)``.  Each loop is a plan per round, cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.operators.graph import ends
from argloom.operators.iterate import cut

#: Independent labels of a node; words of 64 targets that a round of :func:`common_reach` carries.
LABELS, WORDS = 4, 16
#: Rows of nodes and batches that :func:`common_reach` works on at once.
STATE = 1 << 25


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes(node_id)``."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without nodes that lack an edge in or an edge out, again and again: what is left lies on cycles or between them."""
    count = edges.count()
    while count:
        both = edges.select(F.col("source").alias("node_id")).distinct().join(edges.select(F.col("target").alias("node_id")), "node_id", "left_semi")
        edges = cut(_between(edges, both))
        if (now := edges.count()) == count:
            break
        count = now
    return edges


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """``node_id, color``: the least color of the nodes that reach each one, itself included."""
    while True:
        near = edges.join(label.withColumnRenamed("node_id", "source"), "source").groupBy(F.col("target").alias("node_id")).agg(F.min("color").alias("m"))
        new = cut(label.join(near, "node_id", "left").select("node_id", F.least("color", F.coalesce("m", "color")).alias("color"), (F.col("m") < F.col("color")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        label = new.drop("moved")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node_id, component`` (its least node) of every node: two nodes share a component if each reaches the other.

    Nodes that cannot lie on a cycle are trimmed away.  Then every node takes the least node that reaches it as its color,
    and what reaches that node within its color is its component; found components go, and the rest is trimmed again.
    Components of all colors are found at once.
    """
    whole = cut(_plain(edges))
    left, found = _trimmed(cut(whole.filter("source <> target"))), None
    while not left.isEmpty():
        color = _spread(left, cut(ends(left).withColumn("color", F.col("node_id"))))
        at = color.select(F.col("node_id").alias("source"), F.col("color").alias("x")), color.select(F.col("node_id").alias("target"), F.col("color").alias("y"))
        inner = cut(left.join(at[0], "source").join(at[1], "target").filter("x = y").select("source", "target"))
        back = inner.select(F.col("target").alias("source"), F.col("source").alias("target"))
        seen = frontier = cut(color.filter("node_id = color"))
        while True:
            step = back.join(frontier.withColumnRenamed("node_id", "source"), "source").select(F.col("target").alias("node_id"), "color").distinct()
            frontier = cut(step.join(seen.select("node_id"), "node_id", "left_anti"))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        found = seen if found is None else cut(found.unionByName(seen))
        left = _trimmed(cut(_between(left, ends(left).join(seen.select("node_id"), "node_id", "left_anti"))))
    every = ends(whole)
    if found is None:
        return every.select("node_id", F.col("node_id").alias("component"))
    names = found.groupBy("color").agg(F.min("node_id").alias("component"))
    named = found.join(names, "color").select("node_id", "component")
    return every.join(named, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of components of two nodes or more, and those with a loop."""
    part = strong_components(edges)
    large = part.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return part.join(large.select("component"), "component", "left_semi").select("node_id").unionByName(edges.filter("source = target").select(F.col("source").alias("node_id"))).distinct()


def condensed(edges: DataFrame, part: DataFrame) -> DataFrame:
    """The acyclic graph of the components: distinct edges between different ones."""
    at = [part.select(F.col("node_id").alias(end), F.col("component").alias(c)) for end, c in (("source", "s"), ("target", "t"))]
    return edges.select("source", "target").join(at[0], "source").join(at[1], "target").filter("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """``node_id, height, low`` of a DAG; raises on a cycle.

    ``height`` is the longest path down from a node, ``low`` holds the least of each of :data:`LABELS` hashes over the
    nodes that it reaches, itself included.  Whoever reaches a node is higher, and none of its lows is larger: nested
    intervals, which rule out most pairs without a search.
    """
    e = cut(_plain(edges))
    nodes = ends(e)
    now = cut(nodes.select("node_id", F.lit(0).alias("height"), *(F.xxhash64("node_id", F.lit(i)).alias(f"l{i}") for i in range(LABELS))))
    n, rounds = now.count(), 0
    while True:
        down = e.join(now.withColumnRenamed("node_id", "target"), "target").groupBy(F.col("source").alias("node_id")).agg((F.max("height") + 1).alias("h"), *(F.min(f"l{i}").alias(f"m{i}") for i in range(LABELS)))
        new = now.join(down, "node_id", "left").select("node_id", F.coalesce("h", "height").alias("height"), *(F.least(f"l{i}", F.coalesce(f"m{i}", f"l{i}")).alias(f"l{i}") for i in range(LABELS)), (F.coalesce("h", "height") != F.col("height")).alias("moved"))
        new = cut(new)
        moved = not new.filter("moved").isEmpty()
        now = new.drop("moved")
        if not moved:
            return now.select("node_id", "height", F.array(*(f"l{i}" for i in range(LABELS))).alias("low"))
        rounds += 1
        if rounds > n:
            raise ValueError("the graph has a cycle")


def _admits(a: str, b: str) -> Column:
    """Whether the labels leave room for a path from ``a`` to ``b``."""
    return (F.col(f"height_{a}") > F.col(f"height_{b}")) & F.forall(F.zip_with(f"low_{a}", f"low_{b}", lambda x, y: x <= y), lambda x: x)


def _labelled(rows: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    return rows.join(known.select(F.col("node_id").alias(column), F.col("height").alias(f"height_{name}"), F.col("low").alias(f"low_{name}")), column)


def reaches(edges: DataFrame, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs(source, target)`` that a path of the DAG joins, of one edge or more.  Pairs that their labels leave open are searched for together, along edges that the labels leave open as well."""
    e = cut(_plain(edges))
    known = labels(e) if known is None else known
    asked = _labelled(_labelled(pairs.select("source", "target").distinct(), known, "source", "s"), known, "target", "t").filter(_admits("s", "t"))
    frontier = cut(asked.select("source", "target", F.col("source").alias("at"), "height_t", "low_t"))
    found = None
    while not frontier.isEmpty():
        step = frontier.join(e.select(F.col("source").alias("at"), F.col("target").alias("to")), "at").select("source", "target", F.col("to").alias("at"), "height_t", "low_t").distinct()
        step = cut(_labelled(step, known, "at", "a").withColumn("hit", F.col("at") == F.col("target")))
        hits = step.filter("hit").select("source", "target").distinct()
        found = cut(hits if found is None else found.unionByName(hits))
        frontier = cut(step.filter("NOT hit").filter(_admits("a", "t")).join(hits, ["source", "target"], "left_anti").select("source", "target", "at", "height_t", "low_t"))
    return found if found is not None else asked.select("source", "target")


def reduction(edges: DataFrame) -> DataFrame:
    """Of a DAG: the edges that no longer path replaces.

    An edge goes if one of its source's other targets reaches its target.  Pairs of targets of one source are made only
    where their labels leave a path open; the join on the source is left to adaptive execution to split where a source has
    very many targets.
    """
    e = cut(_plain(edges))
    known = labels(e)
    target = _labelled(e, known, "target", "t")
    via = _labelled(e.select("source", F.col("target").alias("via")), known, "via", "v")
    open_ = cut(target.join(via, "source").filter(_admits("v", "t")).select("source", "target", "via"))
    met = reaches(e, open_.select(F.col("via").alias("source"), "target"), known)
    longer = open_.join(met.withColumnRenamed("source", "via"), ["via", "target"], "left_semi").select("source", "target").distinct()
    return e.join(longer, ["source", "target"], "left_anti")


def common_reach(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``n_left, n_right, n_both``: the pairs that a path of one edge or more joins in each graph, and in both.

    Targets are dealt to batches of 64 x :data:`WORDS`; a node carries a bit for each target of a batch that it reaches,
    and nodes hand their bits up the edges until none is new.  Pairs are counted, never made.  Batches are worked on
    together, as many as make at most :data:`STATE` rows, of which only those with a bit set are there.
    """
    e = cut(_plain(left).withColumn("g", F.lit(0)).unionByName(_plain(right).withColumn("g", F.lit(1))))
    targets = e.select(F.col("target").alias("node_id")).distinct()
    size = 64 * WORDS
    n, nodes = targets.count(), ends(e).count()
    parts = max(-(-n // size), 1)
    words = [f"w{i}" for i in range(WORDS)]
    totals = [0, 0, 0]
    place = F.row_number().over(Window.partitionBy("p").orderBy("node_id")) - 1
    spots = cut(targets.withColumn("p", F.pmod(F.xxhash64("node_id"), F.lit(parts))).withColumn("i", place).select("p", F.col("node_id").alias("target"), (F.col("p") + parts * F.floor(F.col("i") / size)).alias("batch"), (F.col("i") % size).alias("bit")))
    together = max(1, STATE // (2 * max(nodes, 1)))
    gather = lambda rows: rows.groupBy("g", "batch", F.col("source").alias("node_id")).agg(*(F.bit_or(w).alias(w) for w in words))
    for first in range(0, parts if n else 0, together):
        bits = [F.when(F.expr(f"bit div 64 = {i}"), F.expr("shiftleft(CAST(1 AS BIGINT), CAST(bit % 64 AS INT))")).otherwise(F.lit(0).cast("bigint")).alias(w) for i, w in enumerate(words)]
        own = spots.filter(F.col("p").between(first, first + together - 1)).select("target", "batch", *bits)
        reach = gather(e.join(own, "target"))
        reach = cut(reach.select("g", "batch", "node_id", *words, *(F.col(w).alias(f"new_{w}") for w in words)))
        while True:
            fresh = reach.filter(" OR ".join(f"new_{w} <> 0" for w in words))
            if fresh.isEmpty():
                break
            up = gather(e.join(fresh.select("g", "batch", F.col("node_id").alias("target"), *(F.col(f"new_{w}").alias(w) for w in words)), ["g", "target"]))
            zero = F.lit(0).cast("bigint")
            old, now = ({w: F.coalesce(F.col(f"{side}.{w}"), zero) for w in words} for side in "ou")
            met = reach.alias("o").join(up.alias("u"), ["g", "batch", "node_id"], "full")
            reach = cut(met.select("g", "batch", "node_id", *(old[w].bitwiseOR(now[w]).alias(w) for w in words), *(now[w].bitwiseAND(F.bitwise_not(old[w])).alias(f"new_{w}") for w in words)))
        count = lambda rows, *ws: rows.agg(F.coalesce(F.sum(sum((F.bit_count(w) for w in ws[1:]), F.bit_count(ws[0]))), F.lit(0))).first()[0]
        one, two = reach.filter("g = 0"), reach.filter("g = 1")
        both = one.alias("x").join(two.alias("y"), ["batch", "node_id"]).select(*(F.col(f"x.{w}").bitwiseAND(F.col(f"y.{w}")).alias(w) for w in words))
        totals = [t + count(rows, *words) for t, rows in zip(totals, (one, two, both), strict=True)]
    return left.sparkSession.createDataFrame([tuple(totals)], "n_left bigint, n_right bigint, n_both bigint")


def subsumption(edges: DataFrame, models: DataFrame, axioms: DataFrame) -> DataFrame:
    """Per specialization edge ``parent, child``: ``parent_actual, child_actual`` (numbers of models), ``specializing`` (the child has a model or an axiom), ``compatible`` and ``subsumed``.

    ``models(node_id, kind, model)`` with the kinds ``actual`` and ``potential``, ``axioms(node_id)``.  Potential models rule an edge out only
    if both ends declare some and the child's are gone, which a count of distinct models cannot be.
    """
    kind = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("model")))
    sizes = models.groupBy("node_id").agg(kind("actual").alias("actual"), kind("potential").alias("potential"))
    marked = axioms.select("node_id").distinct().withColumn("axiom", F.lit(True))
    e = edges.select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()
    for end in ("parent", "child"):
        e = e.join(sizes.select(F.col("node_id").alias(end), F.col("actual").alias(f"{end}_actual"), F.col("potential").alias(f"{end}_potential")), end, "left").na.fill(0, [f"{end}_actual", f"{end}_potential"])
    e = e.join(marked.withColumnRenamed("node_id", "child"), "child", "left")
    specializing = (F.col("child_actual") > 0) | F.coalesce("axiom", F.lit(False))
    compatible = (F.col("parent_potential") == 0) | (F.col("child_potential") >= 0)
    return e.select("parent", "child", "parent_actual", "child_actual", specializing.alias("specializing"), compatible.alias("compatible"), (specializing & compatible).alias("subsumed"))
