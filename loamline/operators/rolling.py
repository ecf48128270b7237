"""Rolling totals over trailing periods, days without activity included.

Time is cut into shards of SHARD days. For each entity and shard, one row keeps a segment tree of counts and sums:
element i covers elements 2i and 2i + 1, with the days as leaves. A range adds a few nodes; a late correction adds its
amounts to the leaf's ancestors only.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.history import running_before
from loamline.plans.storage import cut

#: Days per shard, a power of two.
SHARD = 64
LEVELS = 6
#: A tree: heap number of a node -> how many records it covers and the sum of their amounts. Empty nodes have no entry.
TREE = "map<int, struct<n: bigint, total: double>>"
#: Places in the log whose running maximum one task works out.
LOG_PIECE = 1 << 16


def day_number(ts: str) -> Column:
    """Days since 1970-01-01 in UTC."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(86_400_000_000)).cast("int")


def _keys(entity: str | Sequence[str]) -> list[str]:
    return [entity] if isinstance(entity, str) else list(entity)


def build_trees(daily: DataFrame, entity: str | Sequence[str]) -> DataFrame:
    """daily (entity, day, n, total) -> (entity, shard, tree): only nodes above days with activity are kept.

    A day that occurs in several rows adds up. Without a column total, n is summed. entity may be several columns.
    """
    keys = _keys(entity)
    total = F.col("total" if "total" in daily.columns else "n").cast("double")
    nodes = daily.select(
        *keys,
        F.floor(F.col("day") / F.lit(SHARD)).cast("int").alias("shard"),
        F.col("n").cast("bigint").alias("n"),
        total.alias("total"),
        F.explode(F.expr(f"transform(sequence(0, {LEVELS}), k -> shiftright({SHARD} + pmod(day, {SHARD}), k))")).alias("node"),
    )
    sums = nodes.groupBy(*keys, "shard", "node").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entry = F.struct("node", F.struct("n", "total"))
    return sums.groupBy(*keys, "shard").agg(F.map_from_entries(F.collect_list(entry)).cast(TREE).alias("tree"))  # at most 2 * SHARD nodes


def correct_trees(trees: DataFrame, corrections: DataFrame, entity: str | Sequence[str]) -> DataFrame:
    """Apply late corrections (entity, day, n, total to add, may be negative).

    Only the shards named in the corrections change, and in them only the ancestors of the corrected days.
    """
    keys = _keys(entity)
    delta = build_trees(corrections, entity).withColumnRenamed("tree", "_delta")
    add = lambda f: f"coalesce(a.{f}, 0) + coalesce(b.{f}, 0)"
    merged = F.expr(f"map_zip_with(tree, _delta, (k, a, b) -> named_struct('n', {add('n')}, 'total', {add('total')}))").cast(TREE)
    both = trees.join(delta, [*keys, "shard"], "full")
    return both.select(*keys, "shard", F.when(F.col("tree").isNotNull() & F.col("_delta").isNotNull(), merged).otherwise(F.coalesce("tree", "_delta")).alias("tree"))


def range_nodes(lo: int, hi: int) -> list[int]:
    """The nodes that leaves lo .. hi - 1 consist of (0 <= lo, hi <= SHARD), at most two of each level."""
    out, a, b = [], lo + SHARD, hi + SHARD
    while a < b:
        out += [a] * (a % 2) + [b - 1] * (b % 2)
        a, b = (a + 1) // 2, b // 2
    return out


def _lookup(tree: str, leaf: str, days: int, back: int) -> str:
    """SQL for the part (n, total) of a trailing period that lies `back` shards before the leaf's; which nodes it consists of is one constant for each leaf."""
    nodes = [range_nodes(max(i - days + 1 + back * SHARD, 0), SHARD if back else i + 1) for i in range(SHARD)]
    table = ", ".join(f"array({', '.join(map(str, x))})" if x else "cast(array() as array<int>)" for x in nodes)
    add = f"named_struct('n', s.n + coalesce({tree}[i].n, 0L), 'total', s.total + coalesce({tree}[i].total, 0D))"
    return f"aggregate(if({tree} is null, cast(array() as array<int>), array({table})[{leaf}]), named_struct('n', 0L, 'total', 0D), (s, i) -> {add})"


def trailing(trees: Sequence[str], leaf: str, days: int) -> Column:
    """(n, total) over the leaf's day and the days - 1 before it; trees: columns of the shard, the one before it, ..."""
    # a period of so many days never reaches farther back
    parts = [F.expr(_lookup(tree, leaf, days, back)) for back, tree in enumerate(trees) if back == 0 or days - 1 > (back - 1) * SHARD]
    if len(parts) == 1:
        return parts[0]
    add = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["total"] + x["total"]).alias("total"))
    return F.aggregate(F.array(*parts), F.expr("named_struct('n', 0L, 'total', 0D)"), add)


def rolling_totals(daily: DataFrame, entity: str | Sequence[str], periods: Sequence[int] = (7, 30), late: DataFrame | None = None) -> DataFrame:
    """(entity, day, first_day, n<p>, total<p>, mean<p> for each period p) for every day from the entity's first to its last day.

    n<p> counts records, total<p> sums their amounts, mean<p> is the total divided by p, quiet days counted as zero. Null
    entities and null days give no row; an empty table gives an empty one. late (entity, day, n, total) corrects the
    trees of daily. Periods may be of any length: earlier shards are looked up as far back as the longest needs.
    """
    keys = _keys(entity)
    known = lambda df: df.where(" and ".join(f"`{k}` is not null" for k in [*keys, "day"]))
    daily = known(daily)
    trees = build_trees(daily, keys)
    days = daily.select(*keys, "day")
    if late is not None:
        late = known(late)
        trees = correct_trees(trees, late, keys)
        days = days.unionByName(late.select(*keys, "day"))
    span = days.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("_last"))
    shards = span.withColumn("shard", F.explode(F.expr(f"sequence(cast(floor(first_day / {SHARD}) as int), cast(floor(_last / {SHARD}) as int))")))
    back = -(-(max(periods) - 1) // SHARD)
    by_shard = Window.partitionBy(*keys).orderBy("shard")  # a row per shard, however many records
    names = ["tree", *(f"_tree{j}" for j in range(1, back + 1))]
    # trees are few bytes but many days: by size alone, Spark would give them to too few tasks
    cores = daily.sparkSession.sparkContext.defaultParallelism
    rows = shards.join(trees, [*keys, "shard"], "left").repartition(2 * cores, *keys).withColumns({f"_tree{j}": F.lag("tree", j).over(by_shard) for j in range(1, back + 1)})
    rows = rows.withColumn("day", F.explode(F.expr(f"sequence(greatest(first_day, shard * {SHARD}), least(_last, shard * {SHARD} + {SHARD - 1}))")))
    rows = rows.withColumn("_leaf", F.expr(f"pmod(day, {SHARD})"))
    rows = rows.select(*keys, "day", "first_day", *[trailing(names, "_leaf", p).alias(f"_s{p}") for p in periods])
    made = [c for p in periods for c in (F.col(f"_s{p}.n").alias(f"n{p}"), F.col(f"_s{p}.total").alias(f"total{p}"), (F.col(f"_s{p}.total") / F.lit(float(p))).alias(f"mean{p}"))]
    return rows.select(*keys, "day", "first_day", *made)


def commits_per_day(commits: DataFrame) -> DataFrame:
    """(repo_id, day, n): distinct commits by UTC day of ts; rows without repo_id, sha or ts don't count."""
    d = commits.where("repo_id is not null and sha is not null and ts is not null").select("repo_id", "sha", day_number("ts").alias("day")).distinct()
    return d.groupBy("repo_id", "day").agg(F.count(F.lit(1)).alias("n"))


def late_commits(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily counts (repo_id, day, n) of commits that came in order of days, and of those that came late.

    The log lists the newest commit first, so it arrives from its end. A commit is late if one of a later day arrived
    before it. A repeated commit arrives once, at its earliest; a null log_ord arrives first.
    """
    c = commits.where("repo_id is not null and sha is not null and ts is not null").select("repo_id", "sha", day_number("ts").alias("day"), (-F.coalesce("log_ord", F.lit((1 << 62)))).alias("_at"))
    c = c.groupBy("repo_id", "sha", "day").agg(F.min("_at").alias("_at"))
    c = running_before(c.withColumn("_newest", F.col("day")), ["repo_id"], "_at", [], ["_newest"], piece=LOG_PIECE)
    late = F.coalesce(F.col("before__newest") > F.col("day"), F.lit(False))
    n = cut(c.groupBy("repo_id", "day", late.alias("_late")).agg(F.count(F.lit(1)).alias("n")), "arrivals")
    return n.where("not _late").drop("_late"), n.where("_late").drop("_late")
