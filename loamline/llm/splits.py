"""Train, validation and test splits that keep related records together.

Cases are related if their repository and component agree after clean-up, or if renames link their components.
Related components are found by alternating star contraction of the rename links; groups are then balanced over many
equal bins by largest differencing, and whole bins go to splits.
"""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.graph import components
from loamline.plans.storage import cut

BINS = 64
#: Groups balanced in one task, and bin tuples merged in one task.
GROUPS_PER_SHARD = 16_384
FAN_IN = 64

#: A Java file below one of the two source roots.
JAVA_PATH = r"(?:^|/)src/(?:main|test)/java/(.+)\.java$"


def clean_component(c: str | Column) -> Column:
    """`/` read as `.`, and what precedes the first `$`."""
    return F.substring_index(F.translate(c, "/", "."), "$", 1)


def node(repo: str | Column, component: str | Column) -> Column:
    """One name for a component of a repository; null if either is null."""
    return F.concat(F.lower(F.trim(repo)), F.lit("\n"), clean_component(component))


def rename_links(changes: DataFrame) -> DataFrame:
    """(u, v) with u > v: the components that a rename connects, once each."""

    def of(path: str) -> Column:
        name = F.regexp_extract(path, JAVA_PATH, 1)
        return F.when((name != "") & ~name.rlike(r"(^|/)package-info$"), name)

    return (
        changes.where("old_path is not null and path is not null and repo_id is not null")
        .select(node("repo_id", of("old_path")).alias("x"), node("repo_id", of("path")).alias("y"))
        .where("x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .distinct()
    )


def largest_differencing(loads: np.ndarray) -> np.ndarray:
    """loads[t, s]: load of slot s of tuple t -> bins[t, s], so that the bins come out nearly equal.

    Repeatedly the two tuples with the largest spread are joined, the fullest slots of one to the emptiest of the other.
    """
    count, width = loads.shape
    sums = list(loads.astype(np.float64))
    heap = [(-(x.max() - x.min()), i) for i, x in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        x = sums[a][down] + sums[b][up]
        joined.append((a, down, b, up))
        sums.append(x)
        heapq.heappush(heap, (-(x.max() - x.min()), len(sums) - 1))
    bins = np.empty((len(sums), width), np.int64)
    bins[-1] = np.arange(width)
    for i in range(len(joined) - 1, -1, -1):
        a, down, b, up = joined[i]
        bins[a][down] = bins[count + i]
        bins[b][up] = bins[count + i]
    return bins[:count]


def balance(groups: DataFrame, bins: int = BINS) -> DataFrame:
    """groups (label, n), as written by cut() -> (label, bin).

    Groups are hashed into shards of about GROUPS_PER_SHARD. A shard sorts its groups into tuples of `bins` groups of
    like weight and joins the tuples by largest differencing; the shards' bins are then tuples themselves and joined in
    the same way, FAN_IN at a time. No task sees more than one shard or FAN_IN tuples. A group is never divided, so one
    that outweighs a bin makes that bin as heavy as itself.
    """
    count = groups.count()
    shards = max(1, math.ceil(count / GROUPS_PER_SHARD))

    def first(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["n", "label"], ascending=[False, True], kind="stable", ignore_index=True)
        loads = np.zeros(-(-len(df) // bins) * bins)
        loads[: len(df)] = df["n"]
        placed = largest_differencing(loads.reshape(-1, bins)).ravel()[: len(df)]
        return df.assign(slot=placed.astype(np.int32))[["label", "n", "shard", "slot"]]

    def join(df: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(df["shard"].to_numpy(), return_inverse=True)
        loads = np.zeros((len(ids), bins))
        loads[at, df["slot"]] = df["n"]
        to = largest_differencing(loads)
        s, k = np.divmod(np.arange(to.size), bins)
        return pd.DataFrame({"shard": ids[s], "slot": k.astype(np.int32), "to_shard": df["to_shard"].iloc[0], "to_slot": to.ravel().astype(np.int32)})

    placed = cut(
        groups.select("label", "n", F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("shard")
        .applyInPandas(first, "label string, n bigint, shard int, slot int"),
        "placed",
    )
    place = placed.select("label", "shard", "slot")
    loads = placed.groupBy("shard", "slot").agg(F.sum("n").alias("n"))
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        moves = cut(
            loads.withColumn("to_shard", F.expr(f"cast(shard div {FAN_IN} as int)"))
            .groupBy("to_shard")
            .applyInPandas(join, "shard int, slot int, to_shard int, to_slot int"),
            "moves",
        )
        loads = (
            loads.join(moves, ["shard", "slot"])
            .groupBy(F.col("to_shard").alias("shard"), F.col("to_slot").alias("slot"))
            .agg(F.sum("n").alias("n"))
        )
        place = place.join(moves, ["shard", "slot"]).select("label", F.col("to_shard").alias("shard"), F.col("to_slot").alias("slot"))
    return place.select("label", F.col("slot").alias("bin"))


def allot(loads: dict[int, int], shares: dict[str, float]) -> dict[int, str]:
    """bin -> split: the heaviest bins first, each to the split that is farthest below its target."""
    total = sum(loads.values())
    missing = {s: p * total for s, p in shares.items()}
    out = {}
    for b in sorted(loads, key=lambda b: (-loads[b], b)):
        s = max(missing, key=lambda s: missing[s])
        out[b] = s
        missing[s] -= loads[b]
    return out


def assign_splits(cases: DataFrame, changes: DataFrame, shares: dict[str, float] | None = None, bins: int = BINS) -> DataFrame:
    """(case_id, group_case_id, several_spellings, bin, split), one row per distinct case row.

    Repeated rows count once. A case with a null repo_id or target is a group of its own, as is one whose component
    nothing links. group_case_id is the group's smallest case_id; several_spellings tells whether more than one raw
    (repo_id, target_component_id) occurs in the group. Null as_of makes no difference. Empty tables give an empty one.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark = cases.sparkSession
    labels = components(rename_links(changes))
    d = (
        cases.where("case_id is not null")
        .select(
            "case_id",
            F.struct("repo_id", "target_component_id").alias("raw"),
            F.coalesce(node("repo_id", "target_component_id"), F.concat(F.lit("\n"), "case_id")).alias("node"),
        )
        .distinct()
    )
    per_node = d.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first"), F.min("raw").alias("low"), F.max("raw").alias("high"))
    nodes = cut(per_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    groups = cut(
        nodes.groupBy("label").agg(
            F.sum("n").alias("n"), F.min("first").alias("group_case_id"), (~F.min("low").eqNullSafe(F.max("high"))).alias("several_spellings")
        ),
        "groups",
    )
    binned = balance(groups, bins).join(groups, "label")
    loads = {r["bin"]: r["n"] for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most `bins` rows
    chosen = allot(loads, shares)
    table = spark.createDataFrame(list(chosen.items()), "bin int, split string")
    of_node = nodes.select("node", "label").join(binned.join(F.broadcast(table), "bin"), "label")
    return d.join(of_node, "node").select("case_id", "group_case_id", "several_spellings", "bin", "split")


def split_shares(assigned: DataFrame) -> DataFrame:
    """(split, cases, share) that the assignment reached."""
    n = assigned.groupBy("split").agg(F.countDistinct("case_id").alias("cases"))
    everything = F.sum("cases").over(Window.partitionBy())  # a row per split, so one task is enough
    return n.select("split", "cases", (F.col("cases") / everything).alias("share"))

