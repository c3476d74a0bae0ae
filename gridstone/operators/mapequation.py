"""Modules of a flow by the two-level map equation: the shortest mean description of a walk that names modules and the nodes in them.

A walk follows edges by weight and jumps to any node with probability ``teleport``, always so from nodes without a way out. With p a module's share of the
walk, x its share that leaves it, the length is f(sum of x) - 2 sum f(x) + sum f(x + p) - sum over nodes f(p), f(v) = v log v.
What a node's move changes follows from its flows to and from the module it leaves and the one it enters, and from the sum of all x; so
each round every node knows its best move from one join and two sums. Which moves are made together is settled as for modularity
(``communities``), and at last the single best one, whose change is exact. Lengths are measured after each round and never grow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators.communities import _chosen
from gridstone.operators.graph import _cut, stationary
from gridstone.state import Slot, remove, write


def _f(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def _plain(x: float) -> float:
    return x * math.log(x) if x > 0 else 0.0


def _modules(nodes: DataFrame, flows: DataFrame, labels: DataFrame, alpha: float) -> DataFrame:
    """(m, p, w, d, x) of each module: its flow, its share of jumps, what dangles in it, what leaves it."""
    at = labels.select("id", "c")
    inside = nodes.join(at, "id").groupBy(F.col("c").alias("m")).agg(F.sum("p").alias("p"), F.sum("w").alias("w"), F.sum("d").alias("d"))
    cross = flows.join(at.withColumnRenamed("id", "src"), "src").join(at.select(F.col("id").alias("dst"), F.col("c").alias("_to")), "dst").where("c != _to").groupBy(F.col("c").alias("m")).agg(F.sum("out").alias("_x"))
    jumps = (alpha * F.col("p") + (1 - alpha) * F.col("d")) * (1 - F.col("w"))
    return inside.join(cross, "m", "left").select("m", "p", "w", "d", (F.coalesce("_x", F.lit(0.0)) + F.greatest(jumps, F.lit(0.0))).alias("x"))


def _length(modules: DataFrame) -> tuple[float, float]:
    """(length but for the nodes' own term, sum of x)."""
    x, fx, fxp = modules.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("x"), _f(F.col("x")), _f(F.col("x") + F.col("p")))]).first()
    return _plain(x) - 2 * fx + fxp, x


def _moves(nodes: DataFrame, flows: DataFrame, labels: DataFrame, modules: DataFrame, total: float, alpha: float) -> DataFrame:
    """(id, c, to, gain): each node's move to a linked module that shortens the description most; ties go to the smaller number."""
    at = labels.select(F.col("id").alias("dst"), F.col("c").alias("to"))
    linked = flows.join(at, "dst").select(F.col("src").alias("id"), "to", "out", "in")
    own = labels.select("id", F.col("c").alias("to"), F.lit(0.0).alias("out"), F.lit(0.0).alias("in"))
    met = linked.unionByName(own).groupBy("id", "to").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    node = nodes.join(labels, "id").select("id", "c", F.col("p").alias("np"), F.col("w").alias("nw"), F.col("d").alias("nd"), F.col("x").alias("nx"))
    known = met.join(node, "id").join(modules.withColumnRenamed("m", "to"), "to")
    stays = F.col("to") == F.col("c")
    rest = lambda module, mine: F.col(module) - F.when(stays, F.col(mine)).otherwise(0.0)
    leap = lambda p, d: alpha * p + (1 - alpha) * d
    # what passes between the node and the rest of the module, both ways
    tie = F.col("out") + F.col("in") + leap(F.col("np"), F.col("nd")) * rest("w", "nw") + leap(rest("p", "np"), rest("d", "nd")) * F.col("nw")
    each = known.select("id", "c", "to", "np", "nx", "p", "x", stays.alias("stays"), tie.alias("tie"))
    here = each.where("stays").select("id", F.col("p").alias("hp"), F.col("x").alias("hx"), F.col("tie").alias("htie"))
    both = each.where(~F.col("stays")).join(here, "id")
    c = F.col
    left, entered = F.greatest(c("hx") - c("nx") + c("htie"), F.lit(0.0)), F.greatest(c("x") + c("nx") - c("tie"), F.lit(0.0))
    change = (_f(F.greatest(F.lit(total) + c("htie") - c("tie"), F.lit(0.0))) - _plain(total)
              - 2 * (_f(left) + _f(entered) - _f(c("hx")) - _f(c("x")))
              + _f(left + c("hp") - c("np")) + _f(entered + c("p") + c("np")) - _f(c("hx") + c("hp")) - _f(c("x") + c("p")))
    best = both.select("id", "c", "to", (-change).alias("gain")).groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("t"), "c")).alias("b"))
    return best.where("b.gain > 1e-10").select("id", "b.c", (-F.col("b.t")).alias("to"), "b.gain")


def _level(nodes: DataFrame, flows: DataFrame, labels: DataFrame, alpha: float, eps: float, seed: int) -> tuple[DataFrame, str, float]:
    """(labels, their path, fall of the length) of moves of the nodes from a labelling, until no single one shortens it by ``eps``."""
    spark = nodes.sparkSession
    labels, path = write(labels)
    modules, modules_path = write(_modules(nodes, flows, labels, alpha))
    begin, total = _length(modules)
    now, way, turn = begin, 0, seed
    while True:
        turn += 1
        moves, moves_path = write(_moves(nodes, flows, labels, modules, total, alpha))
        way = way if not moves.isEmpty() else 4
        while way < 4:
            chosen = _chosen(moves, flows, way, turn) if way < 3 else moves.orderBy(F.col("gain").desc(), "id").limit(1).select("id", "to")
            new, new_path = write(labels.join(chosen, "id", "left").select("id", F.coalesce("to", "c").alias("c")))
            after, after_path = write(_modules(nodes, flows, new, alpha))
            length, x = _length(after)
            if now - length >= eps:
                remove(spark, path, modules_path)
                labels, path, modules, modules_path, now, total = new, new_path, after, after_path, length, x
                break
            remove(spark, new_path, after_path)
            way += 1
        remove(spark, moves_path)
        if way == 4:
            remove(spark, modules_path)
            return labels, path, begin - now
        way = max(0, way - 1)


def code_length(nodes: DataFrame, flows: DataFrame, labels: DataFrame, teleport: float = 0.15) -> float:
    """Length, in nats, of a labelling (id, c) of nodes and flows as ``flow`` gives them."""
    own = nodes.agg(F.coalesce(F.sum(_f(F.col("p"))), F.lit(0.0))).first()[0]
    return _length(_modules(nodes, flows, labels, teleport))[0] - own


def flow(nodes: DataFrame, edges: DataFrame, teleport: float = 0.15, tol: float = 1e-10, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(id, p, w, d, x) of the nodes and (src, dst, out, in) between unlike nodes, each pair in both directions.

    p is a node's share of the stationary walk, w its share of jumps, d is p where no edge leaves, x what leaves the node. Edges that repeat add up; those of weight 0 or null, or of an
    id that is not a node, count as none; negative ones are an error.
    """
    ids = nodes.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct()
    n = max(ids.count(), 1)
    kept = edges.where("weight != 0").groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    for end in ("src", "dst"):
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    kept = _cut(kept)
    if kept.where("weight < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    walk = stationary(ids, kept, rounds, teleport, tol)
    out = kept.groupBy("src").agg(F.sum("weight").alias("_all"))
    sent = kept.join(out, "src").join(walk.select(F.col("id").alias("src"), "p"), "src").select("src", "dst", ((1 - teleport) * F.col("p") * F.col("weight") / F.col("_all")).alias("flow")).where("src != dst")
    both = sent.select("src", "dst", F.col("flow").alias("out"), F.lit(0.0).alias("in")).unionByName(sent.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("out"), F.col("flow").alias("in")))
    pairs = both.groupBy("src", "dst").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    dangling = walk.join(out.select(F.col("src").alias("id"), F.lit(0.0).alias("_d")), "id", "left").select("id", "p", F.lit(1.0 / n).alias("w"), F.coalesce("_d", "p").alias("d"))
    left = sent.groupBy(F.col("src").alias("id")).agg(F.sum("flow").alias("_x"))
    jumps = (teleport * F.col("p") + (1 - teleport) * F.col("d")) * (1 - F.col("w"))
    return dangling.join(left, "id", "left").select("id", "p", "w", "d", (F.coalesce("_x", F.lit(0.0)) + jumps).alias("x")), pairs


def infomap(nodes: DataFrame, edges: DataFrame, teleport: float = 0.15, eps: float = 1e-10, tries: int = 1, seed: int = 0) -> DataFrame:
    """(id, module, length): the modules of the shortest description that ``tries`` runs find, named by their smallest id, and its length in nats.

    ``edges`` (src, dst, weight) are directed; for an undirected graph give both directions. Nodes move between modules, modules become nodes
    and move likewise, level by level; then single nodes may move again from there, until neither shortens the description by ``eps``. Modules are not taken apart
    by runs inside them; single nodes leave them only. No nodes give no rows; a node that no move helps is a module of its own.
    """
    spark = nodes.sparkSession
    found, links = flow(nodes, edges, teleport)
    (base, base_path), (flows, flows_path) = write(found), write(links)
    best, best_path, best_length = None, None, None
    for k in range(tries):
        belongs, names = base.select("id", F.col("id").alias("c")), Slot()
        while True:
            labels, path, fell = _level(base, flows, belongs, teleport, eps, seed + 7919 * k)
            belongs = names.put(labels)
            remove(spark, path)
            held, slot = Slot(), Slot()
            while True:
                at = belongs.select("id", "c")
                level = held.put(_modules(base, flows, at, teleport).select(F.col("m").alias("id"), "p", "w", "d", "x"))
                cross = flows.join(at.withColumnRenamed("id", "src").withColumnRenamed("c", "_a"), "src").join(at.select(F.col("id").alias("dst"), F.col("c").alias("_b")), "dst").where("_a != _b")
                between = slot.put(cross.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("out").alias("out"), F.sum("in").alias("in")))
                labels, path, less = _level(level, between, level.select("id", F.col("id").alias("c")), teleport, eps, seed + 7919 * k)
                if less >= eps:
                    belongs = names.put(belongs.join(labels.select(F.col("id").alias("c"), F.col("c").alias("_next")), "c").select("id", F.col("_next").alias("c")))
                    fell += less
                remove(spark, path)
                if less < eps:
                    break
            held.clear(spark)
            slot.clear(spark)
            if fell < eps:
                break
        length = code_length(base, flows, belongs, teleport)
        if best is None or length < best_length:
            remove(spark, best_path)
            best, best_path, best_length = belongs, names.path, length
        else:
            names.clear(spark)
    remove(spark, base_path, flows_path)
    low = best.groupBy("c").agg(F.min("id").alias("module"))
    return best.join(low, "c").select("id", "module", F.lit(best_length).alias("length"))
