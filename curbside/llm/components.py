"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

MAX_ROUNDS = 100


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id reachable.

    Ids take the smallest label among their neighbours, then the label of that label, until nothing changes.
    Each round is written; earlier rounds are deleted.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both, f"{name}-links")
    now = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), f"{name}-0")
    for k in range(1, MAX_ROUNDS):
        label = now.select(F.col("id").alias("b"), F.col("component").alias("next"))
        best = both.join(label, "b").groupBy(F.col("a").alias("id")).agg(F.min("next").alias("next"))
        step = now.join(best, "id").select("id", F.col("component").alias("old"), F.least("component", "next").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        step = step.join(jump, "component").select("id", "old", F.least("component", "far").alias("component"))
        step = scratch.write(step, f"{name}-{k}")
        settled = step.where(F.col("old") != F.col("component")).isEmpty()
        now = step.drop("old")
        scratch.drop(f"{name}-{k - 1}")
        if settled:
            scratch.drop(f"{name}-links")
            return now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
