"""Attributes as known at event time, by validity intervals cut into dyadic time nodes.

Time is cut into ticks of 2**TICK microseconds, ticks into a binary tree of nodes. A version of an attribute is valid
from the moment it is known until better versions make it irrelevant; that interval is the union of a few whole nodes
(two per level at most). An event lies in one node of each level. So "interval holds event" becomes an equi-join on
(entity, node), which spreads even one hot entity over many keys, followed by the exact test valid_from <= t < valid_to.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Level 0 ticks last 2**TICK microseconds (about 72 minutes).
TICK = 32
#: Entities with few versions use nodes of this level and above (about 6.4 days), hot ones all levels.
COARSE = 7
#: Versions from which an entity counts as hot.
HOT_ROWS = 20_000
#: Length of the pieces in which a hot entity's validity is worked out, microseconds (16 days or so).
PIECE = 2**40


def entity_key(*cols: str) -> list[Column]:
    """Two independent 64-bit hashes: together they stand for the entity (chance of any clash among 10**12: 10**-14)."""
    return [F.xxhash64(*cols).alias("_e1"), F.xxhash64(F.lit("second"), *cols).alias("_e2")]


def dyadic_nodes(lo: str, hi: str, leaf: str, top: int) -> Column:
    """The nodes whose union is ticks lo .. hi - 1, rounded outwards to nodes of level `leaf`; heap numbers."""
    w = f"shiftleft(1L, k - {leaf})"
    a = f"shiftright(shiftright({lo}, {leaf}) + {w} - 1, k - {leaf})"
    b = f"shiftright(shiftright({hi} - 1, {leaf}) + 1, k - {leaf})"
    first = f"shiftleft(1L, {top} - k)"
    return F.expr(
        f"filter(flatten(transform(sequence({leaf}, {top}), k -> array("
        f"if(({a} & 1) = 1 and {a} < {b}, {first} + {a}, null),"
        f"if(({b} & 1) = 1 and {a} < {b}, {first} + {b} - 1, null)))), x -> x is not null)"
    )


def enclosing_nodes(tick: str, leaf: str, top: int) -> Column:
    """The node of each level from `leaf` up that holds the tick."""
    return F.expr(f"transform(sequence({leaf}, {top}), k -> shiftright(shiftleft(1L, {top}) + {tick}, k))")


def validity(versions: DataFrame, group: Sequence[str], valid_from: str, better_first: Sequence[Column], state: str, hot: DataFrame) -> DataFrame:
    """Adds `_piece` and `_to`: from `_to` on, better versions are known for sure, whichever single state an event rules out.

    A version is out of the race once a better one of the same state is known, or two adjacent better ones of different
    states. Null `_to`: never. Versions that are out before they are known are dropped. Hot groups are worked out in
    pieces of time (of `_order_time`, the leading sort column) so that no group passes through one task as a whole;
    what later pieces know is carried in afterwards.
    """
    v = versions.join(hot.select("_e1", "_e2", F.lit(True).alias("_hot")), ["_e1", "_e2"], "left")
    v = v.withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    v = v.withColumn("_piece", F.when(F.col("_hot"), F.floor(F.col("_order_time") / F.lit(PIECE))).otherwise(F.lit(0)))
    keys = [*group, "_piece"]
    w = Window.partitionBy(*keys).orderBy(*better_first)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*keys, state).orderBy(*better_first).rowsBetween(Window.unboundedPreceding, -1)
    pair = F.when(F.lag(state).over(w) != F.col(state), F.greatest(F.col(valid_from), F.lag(valid_from).over(w)))
    v = v.withColumn("_pair", pair).withColumn("_to", F.least(F.min("_pair").over(before), F.min(valid_from).over(same)))
    later = Window.partitionBy(*group).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        v.where("_hot")
        .groupBy(*keys)
        .agg(F.min("_pair").alias("_pair"))
        .withColumn("_carried", F.min("_pair").over(later))
        .drop("_pair")
    )
    v = v.drop("_pair").join(carried, keys, "left").withColumn("_to", F.least("_to", "_carried")).drop("_carried")
    return v.where(F.col("_to").isNull() | (F.col("_to") > F.col(valid_from)))


def hot_entities(versions: DataFrame) -> DataFrame:
    """Entities with more than HOT_ROWS versions: at most rows / HOT_ROWS of them."""
    return versions.groupBy("_e1", "_e2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select("_e1", "_e2")


def stab(events: DataFrame, intervals: DataFrame, hot: DataFrame, time: str, start: str) -> DataFrame:
    """All (event, interval) of one entity with start <= time < _to; both sides carry _e1, _e2; times in microseconds.

    A null `_to` is open. Two numbers (first and last event time) come to the driver to fix the tree's size.
    """
    t0, t1 = events.agg(F.min(time), F.max(time)).first()
    if t0 is None:
        t0 = t1 = 0
    top = max(COARSE + 1, ((t1 - t0) >> TICK).bit_length())
    flagged = hot.select("_e1", "_e2", F.lit(0).alias("_leaf"))
    leaf = F.coalesce("_leaf", F.lit(COARSE))

    e = events.join(flagged, ["_e1", "_e2"], "left").withColumn("_leaf", leaf)
    e = e.withColumn("_tick", F.shiftright(F.col(time) - F.lit(t0), TICK))
    e = e.withColumn("_node", F.explode(enclosing_nodes("_tick", "_leaf", top))).drop("_tick", "_leaf")

    i = intervals.where((F.col(start) <= F.lit(t1)) & (F.col("_to").isNull() | (F.col("_to") > F.lit(t0))))
    i = i.withColumn("_leaf", F.when(F.col("_hot"), F.lit(0)).otherwise(F.lit(COARSE))).drop("_hot")
    i = i.withColumn("_lo", F.shiftright(F.greatest(F.col(start) - F.lit(t0), F.lit(0)), TICK))
    last = F.least(F.coalesce(F.col("_to") - 1, F.lit(t1)), F.lit(t1))
    i = i.withColumn("_hi", F.when(F.col("_to").isNull() | (F.col("_to") > F.lit(t1)), F.lit(1 << top)).otherwise(F.shiftright(last - F.lit(t0), TICK) + 1))
    i = i.withColumn("_node", F.explode(dyadic_nodes("_lo", "_hi", "_leaf", top))).drop("_lo", "_hi", "_leaf")

    return e.join(i, ["_e1", "_e2", "_node"]).where(
        (F.col(start) <= F.col(time)) & (F.col("_to").isNull() | (F.col(time) < F.col("_to")))
    )


def evidence_asof_cases(cases: DataFrame, evidence: DataFrame, loads: DataFrame, types: Sequence[str]) -> DataFrame:
    """(case_id, evidence_type, evidence_id, load_id): for each case and type the evidence known at the case's cutoff.

    Evidence counts with availability AVAILABLE, a value.num that isn't null (NaN isn't), as_of and its load's
    loaded_at not after the case's as_of, and a snapshot other than the case's commit. Precedence: taken at the parent
    commit, latest as_of, largest load_id, smallest evidence_id. Cases with a null as_of, repo_id or target give no
    row; repeated rows count once; a null parent_sha has no precedence and a null commit_sha rules nothing out.
    """
    c = (
        cases.where("as_of is not null and repo_id is not null and target_component_id is not null and case_id is not null")
        .select(
            "case_id",
            "parent_sha",
            F.col("repo_id"),
            "target_component_id",
            F.unix_micros(F.col("as_of").cast("timestamp")).alias("_t"),
            F.xxhash64(F.coalesce("commit_sha", F.lit(""))).alias("_commit"),
            F.xxhash64("case_id").alias("_c1"),
            F.xxhash64(F.lit("second"), "case_id").alias("_c2"),
        )
    )
    e = (
        evidence.where(F.col("evidence_type").isin(*types))
        .where("availability = 'AVAILABLE' and value.num is not null and as_of is not null and snapshot is not null")
        .join(loads.where("loaded_at is not null").select("load_id", "loaded_at").distinct(), "load_id")
        .select(
            "repo_id",
            "component_id",
            "snapshot",
            "evidence_type",
            "evidence_id",
            "load_id",
            F.unix_micros(F.col("as_of").cast("timestamp")).alias("_order_time"),
            F.unix_micros(F.greatest("as_of", "loaded_at").cast("timestamp")).alias("_from"),
        )
    )
    rank = F.struct(
        F.col("_later").alias("later"), (-F.col("_order_time")).alias("as_of"), (-F.col("load_id")).alias("load"), F.col("evidence_id").alias("id")
    )
    found = ["_c1", "_c2", "evidence_type", rank.alias("_rank")]

    # Taken at the parent commit: entity and snapshot together are the key, of which few versions exist.
    at_parent = (
        c.where("parent_sha is not null")
        .where(F.xxhash64("parent_sha") != F.col("_commit"))
        .select(*entity_key("repo_id", "target_component_id", "parent_sha"), "_t", "_c1", "_c2")
        .join(e.select(*entity_key("repo_id", "component_id", "snapshot"), "_from", "_order_time", "evidence_type", "evidence_id", "load_id"), ["_e1", "_e2"])
        .where("_from <= _t")
        .withColumn("_later", F.lit(0))
        .select(*found)
    )

    versions = e.select(
        *entity_key("repo_id", "component_id"), F.xxhash64("snapshot").alias("_state"), "_from", "_order_time", "evidence_type", "evidence_id", "load_id"
    )
    hot = hot_entities(versions)
    better_first = [F.desc("_order_time"), F.desc("load_id"), F.asc("evidence_id")]
    spans = validity(versions, ["_e1", "_e2", "evidence_type"], "_from", better_first, "_state", hot).drop("_piece")
    events = c.select(*entity_key("repo_id", "target_component_id"), "_t", "_commit", "_c1", "_c2")
    at_any = (
        stab(events, spans, hot, "_t", "_from").where("_state != _commit").withColumn("_later", F.lit(1)).select(*found)
    )

    best = at_parent.unionByName(at_any).groupBy("_c1", "_c2", "evidence_type").agg(F.min("_rank").alias("_rank"))
    named = c.select("_c1", "_c2", "case_id").distinct()
    return named.join(best, ["_c1", "_c2"]).select(
        "case_id", "evidence_type", F.col("_rank.id").alias("evidence_id"), (-F.col("_rank.load")).cast("int").alias("load_id")
    )
