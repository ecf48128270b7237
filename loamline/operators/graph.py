"""Large graphs: connected components by alternating star contraction, ends of chains by pointer doubling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.plans.storage import cut, discard


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, which has none itself; one yes or no comes back."""
    end = lambda c, low, top: F.struct(F.col(c).alias("x"), F.lit(low).alias("low"), F.lit(top).alias("top"))
    ends = e.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("s"))
    n = ends.groupBy("s.x").agg(F.sum("s.low").alias("low"), F.max("s.top").alias("top"))
    return n.where("low > 1 or (low = 1 and top = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v), u > v -> (node, label): label is the least node of the connected component; labels map to themselves.

    Every round is written and the round before deleted; rounds grow with the logarithm of the longest chain. No link
    reaches the driver.
    """
    e = cut(links, "links")
    while not _are_stars(e):
        nxt = cut(_small_star(_large_star(e)), "links")
        discard(e)
        e = nxt
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def ends(links: DataFrame) -> DataFrame:
    """links (node, to), one link a node -> (node, end): where a walk from node along the links ends.

    A walk ends at a node without link. One that runs into a circle ends at the circle's first node that it meets; a
    node on a circle is its own end. Each round doubles the length of all walks and is written; when the number of
    distinct unfinished ends no longer falls, those ends are the nodes on circles, and become ends for good.
    """
    links = cut(links.select("node", "to"), "links")
    walks, before = links, -1
    while True:
        unfinished = walks.select("to").distinct().join(links.select(F.col("node").alias("to")), "to", "left_semi")
        left = unfinished.count()
        if not left:
            return walks.withColumnRenamed("to", "end")
        if left == before:
            break
        before = left
        further = walks.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        walks = cut(walks.join(further, "to", "left").select("node", F.coalesce("_to", "to").alias("to")), "walks")
    circles = cut(unfinished, "circles").select(F.col("to").alias("node"))
    return ends(links.join(circles, "node", "left_anti")).unionByName(circles.select("node", F.col("node").alias("end")))
