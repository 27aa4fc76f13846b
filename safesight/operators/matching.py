"""Greedy one-to-one matching in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.lineage import cut


def dominant_pairs(pairs: DataFrame, group: list[str], left: str, right: str, rank: Column, dealt: bool = False) -> DataFrame:
    """Locally dominant matching: the pairs that greedy choice by falling rank would take, each side once per group.

    A round takes every pair that is best for both its sides, and what touches a taken
    pair goes; the rest is for the next round. Pairs are dealt by the group once a round,
    and each round is checkpointed: the first decides nearly all. No group is ever in one
    row. rank: a total order. dealt: a join has put the rows of a group together already,
    so the first round need not deal them (if it hasn't, they are dealt thrice). These rounds run when it is called.
    """
    lefts, rights = Window.partitionBy(*group, left), Window.partitionBy(*group, right)
    open_, taken = pairs, None
    while True:
        ranked = (open_ if dealt else open_.repartition(*group)).withColumn("_rank", rank)
        best = ranked.withColumn("_r", F.max("_rank").over(rights)).withColumn("_l", F.max("_rank").over(lefts))
        best = best.withColumn("_take", (F.col("_rank") == F.col("_r")) & (F.col("_rank") == F.col("_l"))).drop("_rank", "_r", "_l")
        judged = best.withColumn("_l", F.max("_take").over(lefts)).withColumn("_r", F.max("_take").over(rights))
        judged = cut(judged.select(*pairs.columns, "_take", (~F.col("_l") & ~F.col("_r")).alias("_free")))
        new = judged.where("_take").select(*pairs.columns)
        taken = new if taken is None else taken.unionByName(new)
        open_, dealt = judged.where("_free").select(*pairs.columns), False
        if open_.isEmpty():
            return taken
