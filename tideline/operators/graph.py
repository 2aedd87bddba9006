"""Operators over a property graph given as edges (src, dst, share) and scored nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CASCADE_DECAY, CASCADE_FLOOR, CASCADE_HOPS


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges without self-loops."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(root, node, hop) within ``hops`` undirected steps of each root, at the smallest number of steps.

    One equi-join a hop; only nodes not seen before go on, so paths never multiply.
    """
    links = both_ways(edges).distinct()
    seen = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("hop"))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(links, front.node == links.src).select("root", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def cascade(edges: DataFrame, scores: DataFrame, hops: int = CASCADE_HOPS, floor: float = CASCADE_FLOOR, decay: float = CASCADE_DECAY) -> DataFrame:
    """(node, origin, hop, inherited): risk that nodes inherit along dependencies and that raises their own score.

    A node takes what reaches it at the smallest hop, there the highest value (then the
    smallest origin); values below ``floor`` don't spread.
    """
    weight = F.when(F.col("share").isNull(), decay).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share"))))
    links = edges.select("src", "dst", weight.alias("w"))
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    front = scores.where(F.col("score") >= floor).select(F.col("node").alias("origin"), "node", F.col("score").alias("value"))
    seen = front.select("origin", "node", F.lit(0).alias("hop"), "value")
    for h in range(1, hops + 1):
        step = front.join(links, front.node == links.src).select("origin", F.col("dst").alias("node"), (F.col("value") * F.col("w")).alias("value")).where(F.col("value") >= floor)
        step = step.groupBy("origin", "node").agg(F.max("value").alias("value")).join(seen, ["origin", "node"], "left_anti")
        front = step
        seen = seen.unionByName(step.select("origin", "node", F.lit(h).alias("hop"), "value"))
    best = seen.where("hop > 0").groupBy("node").agg(F.min(F.struct("hop", (-F.round("value", 12)).alias("neg"), "origin")).alias("b")).select("node", F.col("b.origin").alias("origin"), F.col("b.hop").alias("hop"), (-F.col("b.neg")).alias("inherited"))
    return best.join(scores, "node").where(F.col("inherited") > F.col("score")).select("node", "origin", "hop", "inherited")


def exposure(feeds: DataFrame, supplies: DataFrame, least: float = 1e-4) -> DataFrame:
    """(corridor, plant, exposure): sum over ports of the largest feed share times the largest supply share."""
    f = feeds.groupBy("corridor", "port").agg(F.max("share").alias("f"))
    s = supplies.groupBy("port", "plant").agg(F.max("share").alias("s"))
    return f.join(s, "port").groupBy("corridor", "plant").agg(F.sum(F.col("f") * F.col("s")).alias("exposure")).where(F.col("exposure") > least)


def index(scores: DataFrame, degree: DataFrame) -> DataFrame:
    """Each node's contribution to the degree-weighted index, and the index."""
    j = scores.join(degree, "node", "left").withColumn("w", F.greatest(F.coalesce("degree", F.lit(1)), F.lit(1)))
    total = j.agg(F.sum(F.col("w") * F.col("score")).alias("ws"), F.sum("w").alias("tw"))
    return j.crossJoin(F.broadcast(total)).select("node", "score", "w", (F.col("ws") / F.col("tw")).alias("index"), (F.col("w") * F.col("score") / F.col("ws")).alias("share"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, name): the one with the smallest uuid."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "name")]
    return edges.groupBy("src", "dst", "name").agg(F.min(F.struct("uuid", *[c for c in rest if c != "uuid"])).alias("e")).select("src", "dst", "name", "e.*")


def merge_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges of alias nodes moved to the canonical node, then deduplicated; loops that arise go."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    out = edges.join(a, edges.src == F.col("_a"), "left").withColumn("src", F.coalesce("_c", "src")).drop("_a", "_c")
    out = out.join(a, out.dst == F.col("_a"), "left").withColumn("dst", F.coalesce("_c", "dst")).drop("_a", "_c")
    return dedup_edges(out.where("src <> dst"))


def top_links(edges: DataFrame, per_node: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("share"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_node)
