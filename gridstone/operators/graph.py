"""Graphs as node and edge tables. Loops write their state as a table or keep a bounded plan; none collects a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridstone.operators.ordered import running
from gridstone.state import Slot, shared_root


def _cut(df: DataFrame) -> DataFrame:
    """Lineage ends in the cluster's checkpoint folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def symmetric(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def repair_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes, without loops, in both directions, once each."""
    known = nodes.select("id")
    e = edges.select("src", "dst").where("src != dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return symmetric(e).distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(repair_links(nodes, edges).select(F.col("src").alias("id")), "id", "left_anti")


def compact(nodes: DataFrame) -> DataFrame:
    """(id, new): ids numbered from 0 in order, by running counts over ranges."""
    return running(nodes.select("id").distinct(), ["id"], {"new": F.lit(1)}).select("id", (F.col("new") - 1).cast("bigint").alias("new"))


def component_roots(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(id, root): root is the smallest id of the component. Labels meet neighbours, then shortcut to their label's label."""
    links, slot = Slot(), Slot()
    both = links.put(symmetric(edges.select("src", "dst")).where("src != dst").distinct())
    labels = slot.put(nodes.select("id", F.col("id").alias("root")).distinct())
    for _ in range(most):
        # merges: a written table is larger in memory than Spark believes, and must not be built on the driver
        low = both.join(labels.withColumnRenamed("id", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("low"))
        hooked = labels.join(low.hint("merge"), "id", "left").select("id", F.least("root", F.coalesce("low", "root")).alias("root"), F.col("root").alias("old"))
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        seen = Observation()
        new = hooked.join(jump.hint("merge"), "root").observe(seen, F.count_if(F.col("next") != F.col("old")).alias("changed"))
        labels = slot.put(new.select("id", F.col("next").alias("root")))
        if not seen.get["changed"]:
            links.clear(nodes.sparkSession)
            return labels
    raise RuntimeError(f"labels did not settle in {most} rounds")


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): components numbered from 1 by their smallest id."""
    roots = component_roots(nodes, edges)
    ranks = compact(roots.where("id = root").select("id")).select(F.col("id").alias("root"), (F.col("new") + 1).alias("label"))
    return roots.join(ranks, "root").select("id", "label")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """Q of a labelling over symmetric edges: within-community share less the product of strengths."""
    a = community.select(F.col("id").alias("src"), F.col("community").alias("_a"))
    b = community.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    e = edges.join(a, "src").join(b, "dst")
    per = e.groupBy(F.col("_a").alias("c")).agg(F.sum("weight").alias("_deg"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("_in"))
    total = edges.agg(F.sum("weight").alias("_m"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("_in") / F.col("_m") - F.pow(F.col("_deg") / F.col("_m"), 2)).alias("q"))


def contract(edges: DataFrame, community: DataFrame) -> DataFrame:
    """Weights summed between communities."""
    a = community.select(F.col("id").alias("src"), F.col("community").alias("a"))
    b = community.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def stationary(nodes: DataFrame, edges: DataFrame, rounds: int = 20, teleport: float = 0.15, tol: float = 0.0) -> DataFrame:
    """(id, p) after a number of rounds of a walk with teleport; what dangling nodes hold is spread evenly.

    With ``tol`` it ends sooner, once the sum of changes in a round is under it.
    """
    n = max(nodes.count(), 1)
    edges = _cut(edges)  # each round reads them, and what made them runs once
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    move = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("_w"))
    p = before = nodes.select("id", F.lit(1.0 / n).alias("p"))
    has_out = out.select(F.col("src").alias("id"), F.lit(True).alias("_has"))
    for k in range(rounds):
        got = p.join(move, p.id == move.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("_w")).alias("_g"))
        lost = p.join(has_out, "id", "left").agg(F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("p"))), F.lit(0.0)).alias("_l"))
        p = nodes.select("id").join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", (teleport / n + (1 - teleport) * (F.coalesce("_g", F.lit(0.0)) + F.col("_l") / n)).alias("p"))
        old, p = before, _cut(p)
        before = p
        if tol and p.join(old.withColumnRenamed("p", "_o"), "id").agg(F.coalesce(F.sum(F.abs(F.col("p") - F.col("_o"))), F.lit(0.0))).first()[0] < tol:
            break
    return p


def sinkhorn(matrix: DataFrame, rounds: int = 10) -> DataFrame:
    """(r, c, v): rows, then columns are scaled to sum 1, in turns."""
    for k in range(rounds):
        matrix = matrix.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("r")))
        matrix = _cut(matrix.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("c"))))
    return matrix


def linear_partition(nodes: DataFrame, parts: int) -> DataFrame:
    """(id, part): nodes in id order go to a part until the weight so far is over its cut, at equal shares; the next node begins the next part.

    A node moves on by one part at most, so node i is in part min(i, cuts passed by node j, plus i - 1 - j, over all j before it):
    a running minimum after the running sum, without a task that holds all nodes.
    """
    total = float(nodes.agg(F.sum("weight")).first()[0] or 0.0)
    share = total / parts
    seen = running(nodes.select("id", "weight"), ["id"], {"_sum": F.col("weight").cast("double"), "_at": F.lit(1)})
    passed = F.greatest(F.lit(0), F.ceil(F.round(F.col("_sum") / share, 9)) - 1) - F.col("_at") if share > 0 else -F.col("_at")
    low = running(seen, ["id"], least={"_low": passed})
    # the minimum over the nodes before: node i's own does not count
    own = low.withColumn("_next", F.least(F.lit(0), F.col("_low")) + F.col("_at"))
    after = own.select((F.col("_at") + 1).alias("_at"), "_next")
    return own.select("id", "_at").join(after, "_at", "left").select("id", F.least(F.coalesce("_next", F.lit(0)), F.lit(parts - 1)).cast("int").alias("part"))


def renumber_by_part(parts: DataFrame) -> DataFrame:
    """(id, part, number): a stable numbering by part, then id: in-part ranks over the parts' offsets."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    return ranked.join(F.broadcast(sizes), "part").select("id", "part", (F.col("_b") + F.col("_r") - 1).cast("bigint").alias("number"))


def cut_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    a, b = parts.select(F.col("id").alias("src"), F.col("part").alias("_a")), parts.select(F.col("id").alias("dst"), F.col("part").alias("_b"))
    return edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("_a") != F.col("_b")).alias("cut"))


def mrf_energy(unary: DataFrame, edges: DataFrame, labels: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Unary costs of the labels, and a penalty for each pair (once) of unlike neighbours."""
    u = unary.join(labels, ["id", "label"]).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("_u"))
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("_a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    p = edges.where("dst < src").join(a, "src").join(b, "dst").agg((F.count_if(F.col("_a") != F.col("_b")) * penalty).alias("_p"))
    return u.crossJoin(p).select((F.col("_u") + F.col("_p")).alias("energy"))


def max_spanning_forest(nodes: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """(src, dst, weight) by rounds of each component's heaviest outgoing edge; ties go to the smaller pair, so it is one forest."""
    e = _cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src != dst").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    comp, chosen = nodes.select("id", F.col("id").alias("root")), None
    for _ in range(most):
        ab = e.join(comp.withColumnsRenamed({"id": "src", "root": "a"}), "src").join(comp.withColumnsRenamed({"id": "dst", "root": "b"}), "dst").where("a != b")
        both = ab.select("a", "src", "dst", "weight").unionByName(ab.select(F.col("b").alias("a"), "src", "dst", "weight"))
        best = both.groupBy("a").agg(F.max_by(F.struct("src", "dst", "weight"), F.struct("weight", -F.col("src"), -F.col("dst"))).alias("s")).select("s.*").distinct()
        best = _cut(best)
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best).distinct()
        comp = component_roots(nodes, chosen)
    return chosen if chosen is not None else e.limit(0)


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation over symmetric weighted edges; ties go to the smaller label, odd and even ids move in turns."""
    edges = _cut(edges)  # each round reads them, and what made them runs once
    labels = nodes.select("id", F.col("id").alias("community"))
    for k in range(2 * rounds):
        votes = edges.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("_best"))
        labels = _cut(labels.join(best, "id", "left").select("id", F.when((F.col("id") % 2 == k % 2) & F.col("_best").isNotNull(), F.col("_best")).otherwise(F.col("community")).alias("community")))
    return labels


def one_ring(edges: DataFrame, seed: DataFrame, rings: int = 1) -> DataFrame:
    """Nodes within a number of steps of the seed's ids."""
    reached = seed.select("id").distinct()
    for _ in range(rings):
        reached = reached.unionByName(edges.join(reached.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))).distinct()
    return reached


