"""Gradual semantics of quantitative bipolar argumentation graphs.

``nodes(node_id, tau)`` with priors in [0, 1], ``edges(source, target, weight, polarity)``.  All nodes are updated together from the
round before, until the largest change is below a tolerance, or for a fixed number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions.scores import impact, unit
from argloom.operators.graph import hops, levels, reversed_edges
from argloom.operators.iterate import SENT_ROWS, cut
from argloom.operators.theory import with_missing_ends


def updated(kind: str, tau: Column, s: Column, a: Column) -> Column:
    """A node's new strength from its prior, support and attack."""
    if kind == "linear":
        return unit(tau + s - a)
    if kind == "categorizer":
        return unit(tau / F.greatest(1 + a, F.lit(1e-9)) * (1 + s / (1 + s)))
    if kind == "euler":
        energy = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), s - a))
        return unit(1 - (1 - tau * tau) / F.greatest(1 + tau * F.exp(energy), F.lit(1e-9)))
    if kind == "quadratic":
        return unit(tau + (1 - tau) * s / (1 + s) - tau * a / (1 + a))
    if kind == "overlay":
        net = s - a
        return F.when(net >= 0, tau + (1 - tau) * net / (1 + net)).otherwise(tau / (1 + F.abs(net)))
    raise ValueError(f"unknown update {kind}")


def _flows(edges: DataFrame, now: DataFrame) -> DataFrame:
    flow = edges.join(now.withColumnRenamed("node_id", "source"), "source").withColumn("_f", F.col("strength") * F.col("weight"))
    total = lambda sign: F.coalesce(F.sum(F.when(F.col("polarity") == sign, F.col("_f"))), F.lit(0.0))
    return flow.groupBy(F.col("target").alias("node_id")).agg(total(1).alias("support"), total(-1).alias("attack"))


def _updated_all(base: DataFrame, edges: DataFrame, now: DataFrame, kind: str, sources: DataFrame | None = None) -> DataFrame:
    """One round: ``node_id, tau, support, attack, strength`` of all nodes.  ``sources(node_id)`` are all sources of edges, given if they are few: then only their strengths move, not the edges."""
    zero = F.lit(0.0)
    strengths = now.select("node_id", "strength")
    sent = strengths if sources is None else F.broadcast(strengths.join(F.broadcast(sources), "node_id", "left_semi"))
    flows = base.join(_flows(edges, sent), "node_id", "left").select("node_id", "tau", F.coalesce("support", zero).alias("support"), F.coalesce("attack", zero).alias("attack"))
    return flows.withColumn("strength", updated(kind, F.col("tau"), F.col("support"), F.col("attack")))


def solve(nodes: DataFrame, edges: DataFrame, kind: str = "quadratic", rounds: int = 50, tolerance: float | None = 1e-4, missing: float | None = None) -> DataFrame:
    """``node_id, tau, strength, support, attack`` (the sums of the last round's input) ``, evidence, volatility``.

    With ``missing``, ends of edges that are not among the nodes are nodes of that prior.  Edges are stored once, those of a
    target together, so that a round's sums are nearly complete before they are shuffled.
    """
    e = cut(edges.select("source", "target", "weight", "polarity").hint("rebalance", "target"))
    given = nodes if missing is None else with_missing_ends(nodes, e, missing)
    base = cut(given.select("node_id", unit(F.col("tau")).alias("tau")))
    sources = cut(e.select(F.col("source").alias("node_id")).distinct())
    sources = sources if sources.count() <= SENT_ROWS else None
    now = base.withColumn("strength", F.col("tau"))
    zero = F.lit(0.0)
    for _ in range(rounds):
        new = cut(_updated_all(base, e, now, kind, sources))
        change = None if tolerance is None else new.join(now.select("node_id", F.col("strength").alias("old")), "node_id").agg(F.max(F.abs(F.col("strength") - F.col("old")))).first()[0]
        now = new
        if change is not None and change < tolerance:
            break
    energy = F.col("support") + F.col("attack")
    return now.withColumn("evidence", energy).withColumn("volatility", F.when(energy > 0, energy / (1 + energy) * (1 - 2 * F.abs(F.col("strength") - 0.5))).otherwise(zero))


def solve_acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The continuous quadratic-energy equilibrium of a DAG, level by level: ``node_id, strength``."""
    e = cut(edges.select("source", "target", "weight", "polarity"))
    order = cut(nodes.select("node_id", "tau").join(levels(e), "node_id", "left").select("node_id", "tau", F.coalesce("level", F.lit(0)).alias("level")))
    done = cut(order.filter("level = 0").select("node_id", F.col("tau").alias("strength")))
    for k in range(1, (order.agg(F.max("level")).first()[0] or 0) + 1):
        net = e.join(done.select(F.col("node_id").alias("source"), "strength"), "source").groupBy(F.col("target").alias("node_id")).agg(F.sum(F.col("strength") * F.col("weight") * F.col("polarity")).alias("e"))
        w, x = F.col("tau"), F.coalesce("e", F.lit(0.0))
        level = order.filter(F.col("level") == k).join(net, "node_id", "left").select("node_id", (w + (1 - w) * impact(x) - w * impact(-x)).alias("strength"))
        done = cut(done.unionByName(level))
    return done


# The Dormand-Prince pair of orders 5 and 4, by stage; the last line is the difference of the two.
_STAGES = [
    [1 / 5],
    [3 / 40, 9 / 40],
    [44 / 45, -56 / 15, 32 / 9],
    [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729],
    [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656],
    [35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84],
]
_ERROR = [71 / 57600, 0.0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40]
#: Outgoing edges that a row of the adjacency holds at most; a node with more has several rows.
_OUT = 1_000


def _adjacency(edges: DataFrame) -> DataFrame:
    """``node_id, part, out``: outgoing edges as arrays of target and signed weight, in parts of :data:`_OUT`."""
    place = F.row_number().over(Window.partitionBy("source", F.pmod(F.xxhash64("target"), F.lit(64))).orderBy("target", "w"))
    e = edges.select("source", "target", (F.col("weight") * F.col("polarity")).alias("w"))
    part = F.struct(F.pmod(F.xxhash64("target"), F.lit(64)).alias("h"), F.floor((place - 1) / _OUT).alias("i"))
    sizes = e.groupBy("source").agg(F.count("*").alias("n"))
    e = e.withColumn("p", part).join(sizes, "source").withColumn("p", F.when(F.col("n") > _OUT, F.col("p")))
    rows = e.groupBy("source", "p").agg(F.collect_list(F.struct(F.col("target").alias("to"), "w")).alias("out"))
    first = F.row_number().over(Window.partitionBy("source").orderBy("p")) == 1
    return rows.select(F.col("source").alias("node_id"), first.alias("first"), "out")


def _derivative(state: DataFrame, out: DataFrame, at: Column, name: str) -> DataFrame:
    """``state`` with the rate of change at the strengths ``at``.  Every row is used once: it sends its own columns to itself and its flow along its edges, and the parts meet by node."""
    kept = [c for c in state.columns if c != "node_id"]
    own = F.struct(F.col("node_id").alias("to"), F.lit(0.0).alias("e"), F.lit(True).alias("own"))
    sent = F.transform("out", lambda o: F.struct(o["to"].alias("to"), (o["w"] * F.col("_y")).alias("e"), F.lit(False).alias("own")))
    given = state.withColumn("_y", at).join(out, "node_id", "left").withColumn("first", F.coalesce("first", F.lit(True)))
    parts = given.withColumn("_m", F.explode(F.concat(F.when(F.col("first"), F.array(own)).otherwise(F.array().cast("array<" + _own_type(state) + ">")), F.coalesce(sent, F.array().cast("array<" + _own_type(state) + ">")))))
    mine = F.col("_m.own")
    met = parts.groupBy(F.col("_m.to").alias("node_id")).agg(*(F.max(F.when(mine, F.col(c))).alias(c) for c in [*kept, "_y"]), F.sum("_m.e").alias("_e"), F.max(mine).alias("_there"))
    w, e = F.col("tau"), F.col("_e")
    rate = w + (1 - w) * impact(e) - w * impact(-e) - F.col("_y")
    return met.filter("_there").select("node_id", *kept, rate.alias(name))


def _own_type(state: DataFrame) -> str:
    return f"struct<to:{state.schema['node_id'].dataType.simpleString()},e:double,own:boolean>"


def solve_cyclic(nodes: DataFrame, edges: DataFrame, rtol: float = 1e-5, atol: float = 1e-7, still: float = 1e-4, longest: float = 2.0, t_max: float = 50.0) -> DataFrame:
    """``node_id, strength, residual``: the continuous quadratic-energy dynamics, followed from the priors until no strength changes faster than ``still``; cycles are allowed.

    Steps are made by an embedded pair of orders 5 and 4; their length follows the error, up to ``longest``.  A step is one
    plan of six exchanges by node.  Where steps become too short or time runs out, damped fixed-point rounds go on from the
    state reached, with less of each change whenever the largest residual grows; ``residual`` tells how still a node is.
    Edges from or to unknown nodes are left out; a node without edges keeps its prior.
    """
    base = cut(nodes.select("node_id", unit(F.col("tau")).alias("tau")).dropDuplicates(["node_id"]))
    out = cut(_adjacency(edges.join(base.select(F.col("node_id").alias("source")), "source", "left_semi").join(base.select(F.col("node_id").alias("target")), "target", "left_semi")))
    now = cut(_derivative(base.withColumn("s", F.col("tau")), out, F.col("s"), "k1"))
    speed = lambda df: df.agg(F.coalesce(F.max(F.abs("k1")), F.lit(0.0))).first()[0]
    fastest, t, h = speed(now), 0.0, 0.25
    while fastest >= still and t < t_max and h >= 1e-6:
        step, ks = now, ["k1"]
        for i, row in enumerate(_STAGES):
            y = F.col("s") + sum((F.col(k) * (h * a) for k, a in zip(ks, row, strict=True)), F.lit(0.0))
            step = step.withColumn("y", y) if i == len(_STAGES) - 1 else step
            ks.append(f"k{i + 2}")
            step = _derivative(step, out, F.col("y") if "y" in step.columns else y, ks[-1])
        slip = F.abs(sum((F.col(k) * (h * a) for k, a in zip(ks, _ERROR, strict=True)), F.lit(0.0))) / (atol + rtol * F.greatest(F.abs("s"), F.abs("y")))
        step = cut(step.select("node_id", "tau", "s", "y", "k1", "k7", slip.alias("slip")))
        error, next_fastest = step.agg(F.max("slip"), F.max(F.abs("k7"))).first()
        if error <= 1:
            t += h
            fastest = next_fastest
            now = step.select("node_id", "tau", F.col("y").alias("s"), F.col("k7").alias("k1"))
        h = min(longest, h * min(5.0, max(0.2, 0.9 * max(error, 1e-10) ** -0.2)))
    share = 0.5
    for _ in range(200):
        if fastest < still:
            break
        new = cut(_derivative(now.select("node_id", "tau", (F.col("s") + share * F.col("k1")).alias("s")), out, F.col("s"), "k1"))
        next_fastest = speed(new)
        if next_fastest > fastest:
            share /= 2
        now, fastest = new, next_fastest
    return now.select("node_id", unit(F.col("s")).alias("strength"), F.abs("k1").alias("residual"))


def gated(edges: DataFrame, accuracy: float, soft: bool = False) -> DataFrame:
    """Edges below the accuracy: dropped, or (``soft``) weighted by a steep logistic gate."""
    if soft:
        return edges.withColumn("weight", F.col("weight") / (1 + F.exp(-20 * (F.col("weight") - accuracy))))
    return edges.filter(F.col("weight").isNull() | (F.col("weight") >= accuracy))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per node the change of strength between two runs."""
    return a.select("node_id", F.col("strength").alias("strength_a")).join(b.select("node_id", F.col("strength").alias("strength_b")), "node_id").withColumn("drift", F.col("strength_b") - F.col("strength_a"))


def ablate(nodes: DataFrame, edges: DataFrame, target, kind: str = "quadratic", rounds: int = 10) -> DataFrame:
    """Marginal contribution of every other node to ``target``'s strength after ``rounds``: all ablated graphs are solved in one run keyed by the node left out.

    An ablated graph is held as its differences from the whole one: round by round they reach one edge further from the node
    left out, and only nodes whose strength can still reach the target in the rounds that are left are followed.
    """
    base = cut(nodes.select("node_id", unit(F.col("tau")).alias("tau")))
    plain = cut(edges.select("source", "target", "weight", "polarity"))
    here = base.filter(F.col("node_id") == target).select("node_id")
    near = cut(hops(reversed_edges(plain), here, rounds).select(F.col("node_id").alias("target"), "hop"))
    e = cut(plain.filter("polarity IN (1, -1)").join(near, "target").filter(F.col("hop") < rounds))
    now, zero, changed = base.withColumn("strength", F.col("tau")), F.lit(0.0), None
    for k in range(1, rounds + 1):
        live = e.filter(F.col("hop") <= rounds - k)
        gone = now.select(F.col("node_id").alias("gone"), F.col("node_id").alias("source"), (-F.col("strength")).alias("d"))
        parts = (gone if changed is None else gone.unionByName(changed)).join(live, "source").filter("target <> gone")
        sent = lambda sign: F.coalesce(F.sum(F.when(F.col("polarity") == sign, F.col("d") * F.col("weight"))), zero)
        moved = parts.groupBy("gone", F.col("target").alias("node_id")).agg(sent(1).alias("ds"), sent(-1).alias("da"))
        now = cut(_updated_all(base, plain, now, kind))
        strength = updated(kind, F.col("tau"), F.col("support") + F.col("ds"), F.col("attack") + F.col("da"))
        changed = cut(moved.join(now, "node_id").select("gone", F.col("node_id").alias("source"), (strength - F.col("strength")).alias("d")).filter("d <> 0"))
    others = base.filter(F.col("node_id") != target).select("node_id").join(F.broadcast(here.select(F.lit(True).alias("there"))), F.lit(True)).drop("there")
    if changed is None:
        return others.withColumn("contribution", zero)
    last = changed.filter(F.col("source") == target).select(F.col("gone").alias("node_id"), (-F.col("d")).alias("c"))
    return others.join(last, "node_id", "left").select("node_id", F.coalesce("c", zero).alias("contribution"))
