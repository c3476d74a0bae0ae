"""Minimum cuts by push-relabel in rounds, and labellings by expansion and swap moves.

A flow is an edge table of residual capacities and a node table with a height, what a node holds and what it may still send to
the sink. In a round all nodes that hold something push at once along edges that go down by one height, each sharing out what it
holds among its edges in order, and those that keep something are lifted to one above their lowest residual neighbour. Heights
are set anew to the distance to the sink now and then; nodes that no longer reach it are on the source's side and rest.
Each round is a few joins and sums, written as a table; the rounds end when no node holds anything that can reach the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.state import Slot, remove, write

#: Capacities under this count as none. Rounds between two settings of the heights.
SMALL, AGAIN = 1e-9, 6


def _distances(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, str]:
    """``nodes`` with h the number of residual edges to the sink, null where there is no way; a written table and its path."""
    slot = Slot()
    found = slot.put(nodes.select("id", F.when(F.col("t") > SMALL, 1).alias("h")))
    back = arcs.where(F.col("r") > SMALL).select("u", F.col("v").alias("id"))
    level = 1
    while True:
        edge = found.where(F.col("h") == level).select("id")
        next_ = back.join(edge, "id").select(F.col("u").alias("id")).distinct().withColumn("new", F.lit(level + 1))
        found = slot.put(found.join(next_, "id", "left").select("id", F.coalesce("h", "new").alias("h")))
        level += 1
        if found.where(F.col("h") == level).isEmpty():
            break
    out, path = write(nodes.drop("h").join(found, "id"))
    slot.clear(nodes.sparkSession)
    return out, path


def _round(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, e, t, sent, h) and arcs (u, v, r) after all pushes and lifts of a round."""
    to_sink = F.when(F.col("h").isNotNull(), F.least("e", "t")).otherwise(0.0)
    n = nodes.select("id", "h", (F.col("e") - to_sink).alias("e"), (F.col("t") - to_sink).alias("t"), (F.col("sent") + to_sink).alias("sent"))
    low = n.select(F.col("id").alias("v"), F.col("h").alias("hv"))
    active = n.where(F.col("h").isNotNull() & (F.col("e") > SMALL)).select(F.col("id").alias("u"), "e", "h")
    down = arcs.where(F.col("r") > SMALL).join(active, "u").join(low, "v").where("h = hv + 1")
    before = F.coalesce(F.sum("r").over(Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pushes = down.select("u", "v", F.greatest(F.lit(0.0), F.least(F.col("r"), F.col("e") - before)).alias("f")).where(F.col("f") > 0)
    both = pushes.select("u", "v", (-F.col("f")).alias("d")).unionByName(pushes.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("f").alias("d")))
    moved = arcs.join(both.groupBy("u", "v").agg(F.sum("d").alias("d")), ["u", "v"], "left").select("u", "v", (F.col("r") + F.coalesce("d", F.lit(0.0))).alias("r"))
    kept = both.groupBy(F.col("u").alias("id")).agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") < 0, F.col("d"))).alias("out"))
    n = n.join(kept, "id", "left").select("id", "h", (F.col("e") + F.coalesce("d", F.lit(0.0))).alias("e"), "t", "sent", (F.col("e") + F.coalesce("out", F.lit(0.0))).alias("left_"))
    lift = moved.where(F.col("r") > SMALL).join(low, "v").groupBy(F.col("u").alias("id")).agg(F.min("hv").alias("m"))
    stuck = F.col("h").isNotNull() & (F.col("left_") > SMALL)
    height = F.when(stuck, F.when(F.col("t") > SMALL, 1).otherwise(F.greatest("h", F.col("m") + 1))).otherwise(F.col("h"))
    return n.join(lift, "id", "left").select("id", "e", "t", "sent", height.alias("h")), moved


def min_cut(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, float]:
    """((id, source) of the nodes: whether each is on the source's side of a minimum cut, and the cut's capacity.

    ``nodes``: id, cap, from the source where it is positive, to the sink where negative. ``edges``: src, dst, cap, directed; repeated ones are
    summed, loops and capacities under SMALL count as none, a negative one is an error. Of several minimum cuts this is the one
    with the fewest nodes on the sink's side. A node's edges meet in one task in each round.
    """
    spark = nodes.sparkSession
    known = nodes.groupBy("id").agg(F.sum(F.col("cap").cast("double")).alias("cap"))
    links = edges.where("src != dst").join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = links.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("cap").cast("double").alias("r")).unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(0.0).alias("r")))
    node_slot, arc_slot = Slot(), Slot()
    arcs = arc_slot.put(both.groupBy("u", "v").agg(F.sum("r").alias("r")))
    if (arcs.agg(F.min("r")).first()[0] or 0.0) < 0:
        raise ValueError("capacities must not be negative")
    state = node_slot.put(known.select("id", F.greatest("cap", F.lit(0.0)).alias("e"), F.greatest(-F.col("cap"), F.lit(0.0)).alias("t"), F.lit(0.0).alias("sent"), F.lit(None).cast("int").alias("h")))
    k = 0
    while True:
        if k % AGAIN == 0:
            state, path = _distances(state, arcs)
            node_slot.clear(spark)
            node_slot.path = path
        if state.where(F.col("h").isNotNull() & (F.col("e") > SMALL)).isEmpty():
            if k % AGAIN == 0:
                break
            k = 0  # heights may be out of date: once more from true distances
            continue
        new, moved = _round(state, arcs)
        new, path = write(new)
        arcs = arc_slot.put(moved)  # reads the old nodes
        node_slot.clear(spark)
        state, node_slot.path = new, path
        k += 1
    flow = state.agg(F.coalesce(F.sum("sent"), F.lit(0.0))).first()[0]
    out, _ = write(state.select("id", F.col("h").isNull().alias("source")))
    node_slot.clear(spark)
    arc_slot.clear(spark)
    return out, flow


def energy(unary: DataFrame, edges: DataFrame, labels: DataFrame) -> float:
    """Costs of the labels, and the weight of each edge (each listed once) between unlike ones."""
    own = unary.join(labels, ["id", "label"]).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return own + edges.join(a, "src").join(b, "dst").where("a != b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]


def _move(unary: DataFrame, edges: DataFrame, labels: DataFrame, alpha, beta=None) -> DataFrame:
    """Labels after the best move: nodes take alpha or keep theirs; with beta, nodes of the two labels take either.

    A pair's cost by (keeps, takes) of both ends gives each end a coefficient, and the edge a capacity that is never negative."""
    here = labels if beta is None else labels.where(F.col("label").isin(alpha, beta))
    keeps = F.col("label") if beta is None else F.lit(beta)
    state = here.select("id", keeps.alias("label"))
    cost = lambda name: unary.select("id", "label", F.col("cost").alias(name))
    take = cost("take").where(F.col("label") == alpha).drop("label")
    own = state.join(cost("keep"), ["id", "label"]).join(take, "id").select("id", (F.col("take") - F.col("keep")).alias("cap"))
    ends = edges.join(state.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(state.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    w = F.col("weight").cast("double")
    cost_of = lambda unlike: F.when(unlike, w).otherwise(0.0)
    none, second, first = cost_of(F.col("a") != F.col("b")), cost_of(F.col("a") != alpha), cost_of(F.col("b") != alpha)
    parts = ends.select("src", "dst", (first - none).alias("cs"), (-first).alias("cd"), (second + first - none).alias("cap"))
    caps = own.unionByName(parts.select(F.col("src").alias("id"), F.col("cs").alias("cap"))).unionByName(parts.select(F.col("dst").alias("id"), F.col("cd").alias("cap")))
    side, _ = min_cut(caps.groupBy("id").agg(F.sum("cap").alias("cap")), parts.select("src", "dst", "cap"))
    chosen = side.select("id", F.when(F.col("source"), F.lit("keep")).otherwise(F.lit("take")).alias("way"))
    new = F.when(F.col("way") == "take", F.lit(alpha)).otherwise(F.col("label") if beta is None else F.when(F.col("way") == "keep", F.lit(beta)).otherwise(F.col("label")))
    return labels.join(chosen, "id", "left").select("id", new.cast(labels.schema["label"].dataType).alias("label"))


def _improved(unary: DataFrame, edges: DataFrame, labels: DataFrame, moves: list[tuple], eps: float) -> tuple[DataFrame, float]:
    spark = labels.sparkSession
    (unary, unary_path), (edges, edges_path) = write(unary), write(edges)  # each move reads them, and what made them runs once
    labels, path = write(labels)
    now, since, k = energy(unary, edges, labels), 0, 0
    while since < len(moves):  # until no move helps any more
        new, new_path = write(_move(unary, edges, labels, *moves[k % len(moves)]))
        then = energy(unary, edges, new)
        if then < now - eps:
            remove(spark, path)
            labels, path, now, since = new, new_path, then, 0
        else:
            remove(spark, new_path)
        since, k = since + 1, k + 1
    remove(spark, unary_path, edges_path)
    return labels, now


def expansion(unary: DataFrame, edges: DataFrame, labels: DataFrame, eps: float = 1e-6) -> tuple[DataFrame, float]:
    """((id, label), energy) where no expansion of a label lowers the energy by more than ``eps``.

    ``unary`` has a cost for each id and each label, ``edges`` (src, dst, weight) each pair once with what unlike labels cost, not negative;
    ``labels`` is the start. Labels are tried in order, over and over, until each was tried since the last gain.
    """
    names = sorted(r[0] for r in unary.select("label").distinct().collect())  # a bounded set
    return _improved(unary, edges, labels, [(a,) for a in names], eps)


def swaps(unary: DataFrame, edges: DataFrame, labels: DataFrame, eps: float = 1e-6) -> tuple[DataFrame, float]:
    """((id, label), energy) where no exchange between two labels lowers the energy by more than ``eps``; tables as for ``expansion``."""
    names = sorted(r[0] for r in unary.select("label").distinct().collect())
    return _improved(unary, edges, labels, [(a, b) for i, a in enumerate(names) for b in names[i + 1:]], eps)
