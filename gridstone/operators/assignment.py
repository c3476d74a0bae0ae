"""Assignment of rows to columns of the largest total by auction: unassigned rows bid, prices rise, and no graph search is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.state import Slot, write


def _auction(benefit: DataFrame, rows: DataFrame, prices: DataFrame, prices_slot: Slot, eps: float, most: float) -> tuple[DataFrame, DataFrame, Slot]:
    """(prices, assigned (c, r), its slot) where no row would gain more than eps by another column."""
    spark, held = benefit.sparkSession, Slot()
    assigned = held.put(prices.limit(0).select("c", F.lit(None).cast(rows.schema["r"].dataType).alias("r")))
    highest = most * (2 + prices.count())
    two = Window.partitionBy("r").orderBy(F.desc("gain"), "c")
    while True:
        free = rows.join(assigned.select("r"), "r", "left_anti")
        bidding = benefit.join(free, "r").join(prices, "c").select("r", "c", "v", "price", (F.col("v") - F.col("price")).alias("gain"))
        best = bidding.withColumn("k", F.row_number().over(two)).where("k <= 2").groupBy("r").agg(
            F.max(F.when(F.col("k") == 1, F.struct("c", "price", "gain"))).alias("b"), F.max(F.when(F.col("k") == 2, F.col("gain"))).alias("second"))
        offer = F.col("b.price") + F.col("b.gain") - F.coalesce("second", F.col("b.gain") - most) + eps
        wins = Slot()
        won = wins.put(best.select("r", F.col("b.c").alias("c"), offer.alias("offer")).groupBy("c").agg(F.max(F.struct("offer", "r")).alias("w")).select("c", F.col("w.offer").alias("offer"), F.col("w.r").alias("r")))
        told = won.agg(F.count(F.lit(1)), F.max("offer")).first()
        if not told[0]:
            wins.clear(spark)
            return prices, assigned, held
        if told[1] > highest:
            raise ValueError("there is no assignment of all rows")
        prices = prices_slot.put(prices.join(won.select("c", "offer"), "c", "left").select("c", F.coalesce("offer", "price").alias("price")))
        assigned = held.put(assigned.join(won.select("c"), "c", "left_anti").unionByName(won.select("c", "r")))
        wins.clear(spark)


def auction(benefit: DataFrame, eps: float | None = None) -> DataFrame:
    """(r, c, v): each row with a column of its own, or each column with a row where there are more rows, of the largest total of ``benefit`` (r, c, v).

    The total is within eps times the number of bidders of the best one; without ``eps`` that is under 1, so whole benefits give it exactly.
    As many rows as columns: eps falls to that value by quarters, each auction starting from the prices of the last one. Pairs
    without a benefit can't be assigned; no assignment of all bidders is an error. Repeated pairs count with their largest
    benefit. Each round is three joins over the bids of the unassigned only. An empty table gives no rows.
    """
    spark = benefit.sparkSession
    whole, path = write(benefit.where("r IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL").groupBy("r", "c").agg(F.max(F.col("v").cast("double")).alias("v")))
    n_r, n_c, low, high = whole.agg(F.countDistinct("r"), F.countDistinct("c"), F.min("v"), F.max("v")).first()
    if not n_r:
        return whole
    turned = n_r > n_c
    table = whole.select(F.col("c").alias("r"), F.col("r").alias("c"), "v") if turned else whole
    n = min(n_r, n_c)
    last = 1.0 / (n + 1) if eps is None else eps
    spread = max(high - low, last)
    steps = [last]
    while n_r == n_c and steps[-1] * 4 < spread / 4:
        steps.append(steps[-1] * 4)
    rows, slot = table.select("r").distinct(), Slot()
    prices, held = slot.put(table.select("c").distinct().withColumn("price", F.lit(0.0))), None
    for step in reversed(steps):
        if held:
            held.clear(spark)
        prices, assigned, held = _auction(table, rows, prices, slot, step, n * (spread + step) + 1)
    found = assigned.join(table, ["r", "c"])
    out, _ = write(found.select(F.col("c").alias("r"), F.col("r").alias("c"), "v") if turned else found.select("r", "c", "v"))
    held.clear(spark)
    slot.clear(spark)
    return out
