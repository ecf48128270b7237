"""Change activity as it stood before a moment: counts, churn, authors, recency, and life.

Sums over everything strictly before each row's own time are made in two steps, so that a component with very many
touches is never worked through by one task: windows within pieces of time, and what earlier pieces brought, added up
over pieces. Trailing sums are differences of two such sums, the second taken at a probe that lies one window earlier.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Length of the pieces of time, microseconds (about 25 days).
PIECE = 2**41


def running_before(rows: DataFrame, keys: Sequence[str], time: str, sums: Sequence[str], latest: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """Adds before_<c>: the sum (or for `latest` the maximum) of c over rows of the same keys with a strictly smaller time.

    Without such rows a sum is 0 and a maximum null. Rows of equal time don't see each other. Times are whole numbers;
    piece is how many of them one window spans.
    """
    keys = list(keys)
    total: dict[str, Column] = {c: F.sum(c) for c in sums} | {c: F.max(c) for c in latest}
    r = rows.withColumn("_piece", F.floor(F.col(time) / F.lit(piece)))
    inside = Window.partitionBy(*keys, "_piece").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = r.groupBy(*keys, "_piece").agg(*[f.alias(c) for c, f in total.items()])
    again: dict[str, Column] = {c: F.sum(c) for c in sums} | {c: F.max(c) for c in latest}
    pieces = pieces.select(*keys, "_piece", *[f.over(earlier).alias(f"_old_{c}") for c, f in again.items()])
    r = r.withColumns({f"_new_{c}": f.over(inside) for c, f in total.items()}).join(pieces, [*keys, "_piece"])
    out = {f"before_{c}": F.coalesce(f"_new_{c}", F.lit(0)) + F.coalesce(f"_old_{c}", F.lit(0)) for c in sums}
    out |= {f"before_{c}": F.greatest(f"_new_{c}", f"_old_{c}") for c in latest}
    return r.withColumns(out).drop("_piece", *[f"_{w}_{c}" for w in ("new", "old") for c in total])


def clean_touches(touches: DataFrame) -> DataFrame:
    """Distinct touches with `t`, the time in microseconds, and a clean author; rows without key or time are left out."""
    t = touches.where("repo_id is not null and component_id is not null and sha is not null and ts is not null")
    return t.select(
        "repo_id",
        "component_id",
        "sha",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.nullif(F.lower(F.trim("author")), F.lit("")).alias("author"),
        F.coalesce("added", F.lit(0)).cast("bigint").alias("added"),
        F.coalesce("deleted", F.lit(0)).cast("bigint").alias("deleted"),
        F.coalesce("is_bulk", F.lit(False)).alias("is_bulk"),
        F.coalesce("removes_component", F.lit(False)).alias("removes_component"),
    ).distinct()


KEYS = ["repo_id", "component_id"]


def asof_activity(touches: DataFrame, recent_days: int = 90) -> DataFrame:
    """One row per touch with what was known of its component strictly before it.

    repo_id, component_id, sha, as_of (microseconds), historical_commit_count, recent_commit_count (the trailing
    window, its start included), lines_added, lines_deleted, total_churn, recent_churn, unique_contributors (nulls
    aside), days_since_last_change and churn_ratio (recent by total churn to four places, null without churn), last_sha and alive
    (there was a touch before and the last one, by time then sha, didn't remove the component).
    """
    t = clean_touches(touches)
    first = t.where("author is not null").groupBy(*KEYS, "author").agg(F.min(F.struct("t", "sha")).alias("_first"))
    t = t.join(first, [*KEYS, "author"], "left").withColumn("authors", F.coalesce((F.struct("t", "sha") == F.col("_first")).cast("int"), F.lit(0)))
    own = t.select(
        *KEYS, "sha", "t", F.lit(True).alias("_own"), F.lit(1).alias("n"), "added", "deleted", "authors", F.struct("t", "sha", "removes_component").alias("last")
    )
    nothing = F.lit(0)
    probe = t.select(
        *KEYS, "sha", (F.col("t") - recent_days * DAY).alias("t"), F.lit(False).alias("_own"), nothing.alias("n"),
        nothing.cast("bigint").alias("added"), nothing.cast("bigint").alias("deleted"), nothing.alias("authors"), F.lit(None).cast(own.schema["last"].dataType).alias("last"),
    )
    b = running_before(own.unionByName(probe), KEYS, "t", ["n", "added", "deleted", "authors"], ["last"])
    at = lambda c: F.max(F.when(F.col("_own"), F.col(f"before_{c}")))
    old = lambda c: F.max(F.when(~F.col("_own"), F.col(f"before_{c}")))
    g = b.groupBy(*KEYS, "sha").agg(
        F.max(F.when(F.col("_own"), F.col("t"))).alias("as_of"),
        *[at(c).alias(c) for c in ("n", "added", "deleted", "authors", "last")],
        *[old(c).alias(f"old_{c}") for c in ("n", "added", "deleted")],
    )
    churn = F.col("added") + F.col("deleted")
    recent = churn - F.col("old_added") - F.col("old_deleted")
    return g.select(
        *KEYS,
        "sha",
        "as_of",
        F.col("n").alias("historical_commit_count"),
        (F.col("n") - F.col("old_n")).alias("recent_commit_count"),
        F.col("added").alias("lines_added"),
        F.col("deleted").alias("lines_deleted"),
        churn.alias("total_churn"),
        recent.alias("recent_churn"),
        F.col("authors").alias("unique_contributors"),
        F.floor((F.col("as_of") - F.col("last.t")) / DAY).alias("days_since_last_change"),
        F.when(churn > 0, F.bround(recent / churn, 4)).alias("churn_ratio"),
        F.col("last.sha").alias("last_sha"),
        F.coalesce(~F.col("last.removes_component"), F.lit(False)).alias("alive"),
    )


def snapshot_cutoffs(touches: DataFrame, snapshot_times: DataFrame | None = None) -> DataFrame:
    """(repo_id, as_of): one second after the later of the latest touch and the snapshot's time (repo_id, t)."""
    last = clean_touches(touches).groupBy("repo_id").agg(F.max("t").alias("t"))
    if snapshot_times is not None:
        last = last.join(snapshot_times.select("repo_id", F.col("t").alias("_s")), "repo_id", "left").withColumn("t", F.greatest("t", "_s"))
    return last.select("repo_id", (F.col("t") + 1_000_000).alias("as_of"))


def activity_at(touches: DataFrame, cutoffs: DataFrame, recent_days: int = 90, latest: int = 20) -> DataFrame:
    """The same figures for every component at its repository's cutoff (repo_id, as_of in microseconds).

    Also first_t, last_t, alive, and the latest commits, newest first. Components without touches before the cutoff
    give no row.
    """
    t = clean_touches(touches).join(cutoffs, "repo_id").where("t < as_of")
    recent = F.col("t") >= F.col("as_of") - recent_days * DAY
    lines = F.col("added") + F.col("deleted")
    newest = t.join(_newest(t, latest), [*KEYS, "sha"], "left_semi")
    shas = newest.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "sha")), asc=False), lambda x: x["sha"]).alias("latest_shas"))
    g = t.groupBy(*KEYS, "as_of").agg(
        F.count(F.lit(1)).alias("historical_commit_count"),
        F.count_if(recent).alias("recent_commit_count"),
        F.sum("added").alias("lines_added"),
        F.sum("deleted").alias("lines_deleted"),
        F.sum(lines).alias("total_churn"),
        F.coalesce(F.sum(F.when(recent, lines)), F.lit(0)).alias("recent_churn"),
        F.min("t").alias("first_t"),
        F.max(F.struct("t", "sha", "removes_component")).alias("_last"),
    )
    authors = t.where("author is not null").select(*KEYS, "author").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("unique_contributors"))
    g = g.join(authors, KEYS, "left").join(shas, KEYS)
    return g.select(
        *KEYS,
        "as_of",
        "historical_commit_count",
        "recent_commit_count",
        F.coalesce("unique_contributors", F.lit(0)).alias("unique_contributors"),
        "lines_added",
        "lines_deleted",
        "total_churn",
        "recent_churn",
        F.floor((F.col("as_of") - F.col("_last.t")) / DAY).alias("days_since_last_change"),
        F.when(F.col("total_churn") > 0, F.bround(F.col("recent_churn") / F.col("total_churn"), 4)).alias("churn_ratio"),
        "first_t",
        F.col("_last.t").alias("last_t"),
        F.col("_last.sha").alias("last_sha"),
        (~F.col("_last.removes_component")).alias("alive"),
        "latest_shas",
    )


def _newest(t: DataFrame, count: int) -> DataFrame:
    """The `count` newest touches of each component: first within pieces of time, then among those, so no task sees all."""
    d = t.withColumn("_piece", F.floor(F.col("t") / PIECE))
    for keys in ([*KEYS, "_piece"], KEYS):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("sha")))
        d = d.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")
    return d.select(*KEYS, "sha")


def commit_pairs(touches: DataFrame) -> DataFrame:
    """(repo_id, sha, t, a, b), a < b: components changed by one non-bulk commit. A basket holds what bulk commits may not."""
    c = clean_touches(touches).where("not is_bulk").groupBy("repo_id", "sha").agg(F.min("t").alias("t"), F.array_sort(F.collect_set("component_id")).alias("m"))
    each = c.select("repo_id", "sha", "t", "m", F.posexplode("m").alias("i", "a"))
    return each.select("repo_id", "sha", "t", "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from both ends: component_id and partner in place of a and b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return pairs.withColumn("_e", ends).drop("a", "b").withColumns({"component_id": F.col("_e.x"), "partner": F.col("_e.y")}).drop("_e")


def partners_at(touches: DataFrame, cutoffs: DataFrame, support: int = 2) -> DataFrame:
    """(repo_id, component_id, partner, n): partners alive at the cutoff that changed with the component n >= support times."""
    pairs = commit_pairs(touches).join(cutoffs, "repo_id").where("t < as_of").groupBy("repo_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    state = clean_touches(touches).join(cutoffs, "repo_id").where("t < as_of").groupBy(*KEYS).agg(F.max(F.struct("t", "sha", "removes_component")).alias("l"))
    alive = state.where("not l.removes_component").select("repo_id", F.col("component_id").alias("partner"))
    return both_ways(pairs.where(F.col("n") >= support)).join(alive, ["repo_id", "partner"], "left_semi").select("repo_id", "component_id", "partner", "n")


def co_change_before(touches: DataFrame, support: int = 2) -> DataFrame:
    """(repo_id, component_id, sha, co_change_count): partners before each touch, with support and alive at that moment.

    A pair counts from its support-th common commit on, while the partner is alive. These stretches are turned into
    steps up and down on the component's time line, which are then summed like any other activity.
    """
    t = clean_touches(touches)
    nth = F.row_number().over(Window.partitionBy("repo_id", "a", "b").orderBy("t", "sha"))
    since = commit_pairs(touches).withColumn("_n", nth).where(F.col("_n") == support).select("repo_id", "a", "b", F.col("t").alias("since"))
    by_time = Window.partitionBy(*KEYS).orderBy("t")
    once = t.groupBy(*KEYS).agg(F.min("t").alias("born"), F.bool_or("removes_component").alias("_gone"))
    partner = F.col("component_id").alias("partner")
    always = once.where("not _gone").select("repo_id", partner, "born", F.lit(None).cast("bigint").alias("until"))
    t_gone = t.join(once.where("_gone"), KEYS, "left_semi")
    last = t_gone.groupBy(*KEYS, "t").agg(F.max(F.struct("sha", "removes_component")).alias("_l")).select(*KEYS, "t", F.col("_l.removes_component").alias("gone"))
    turns = last.withColumn("_was", F.lag("gone", 1, True).over(by_time)).where("gone <> _was")
    lives = turns.withColumn("until", F.lead("t").over(by_time)).where("not gone").select("repo_id", partner, F.col("t").alias("born"), "until")
    lives = lives.unionByName(always)
    spans = both_ways(since).join(lives, ["repo_id", "partner"]).where("until is null or until > since")
    steps = spans.select(
        *KEYS, F.explode(F.array(F.struct(F.greatest("since", "born").alias("t"), F.lit(1).alias("n")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("n")))).alias("_s")
    ).select(*KEYS, F.lit(None).cast("string").alias("sha"), "_s.t", "_s.n")
    ask = t.select(*KEYS, "sha", "t", F.lit(0).alias("n"))
    all_ = steps.where("t is not null").groupBy(*KEYS, "sha", "t").agg(F.sum("n").alias("n")).unionByName(ask)
    return running_before(all_, KEYS, "t", ["n"]).where("sha is not null").select(*KEYS, "sha", F.col("before_n").alias("co_change_count"))
