"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load.

The load of every key is counted with a map-side combine. Keys above a share of one task are heavy: at most
`tasks * SPLIT` keys can be, whatever the data, so the list of heavy keys is small enough to broadcast. A heavy key is
cut into shards in proportion to its load. All other keys are hashed into a fixed number of buckets. Shards and
buckets are packed into tasks, largest first, each into the task with the least load so far. Rows go to the planned
tasks; of a matching side, a row goes to every task that holds a shard of its key, and to no other.
"""

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.plans.storage import cut

#: A key is heavy above 1/SPLIT of a task's fair load.
SPLIT = 4
#: Buckets of light keys per task.
BUCKETS_PER_TASK = 16
#: Rows that make another task worth its while, up to the session's number of shuffle partitions.
ROWS_PER_TASK = 200_000
#: Names that no table has.
TASK, HEAVY, PLACES = "_loamline_task", "_loamline_heavy", "_loamline_places"


@dataclass(frozen=True)
class LoadPlan:
    key: str
    total: int
    tasks: int
    heavy: DataFrame  # (key, PLACES ARRAY<INT>): the tasks that hold the key's shards
    bucket_places: list[int]
    loads: DataFrame  # (key, n): the rows of every key, a written table

    def place_light(self):
        """The task of a light key; the list is one constant, however long."""
        places = F.split(F.lit(",".join(map(str, self.bucket_places))), ",")
        at = F.pmod(F.xxhash64(self.key), F.lit(len(self.bucket_places))) + 1
        return F.element_at(places, at.cast("int")).cast("int")


def plan_load(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Count the rows of each key and pack keys into tasks.

    A null key is a key like any other. An empty table gives a plan without heavy keys. The driver sees only the heavy
    keys (at most tasks * SPLIT) and the loads of tasks * BUCKETS_PER_TASK buckets.
    """
    spark = df.sparkSession
    loads = cut(df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("_n")), "loads")
    total = loads.agg(F.sum("_n")).first()[0] or 0
    tasks = tasks or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-total // ROWS_PER_TASK)))
    buckets = tasks * BUCKETS_PER_TASK
    limit = max(1, total // (tasks * SPLIT))
    heavy = loads.where(F.col("_n") > limit).collect()
    light = (
        loads.where(F.col("_n") <= limit)
        .groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_b"))
        .agg(F.sum("_n").alias("_n"))
        .collect()
    )
    fair = max(1, total // tasks)
    pieces = [(r["_n"], 1, r["_b"]) for r in light]
    for i, r in enumerate(heavy):
        shards = min(tasks, max(1, -(-2 * r["_n"] // fair)))
        pieces += [(r["_n"] // shards, 0, i)] * shards
    free = [(0, t) for t in range(tasks)]
    heapq.heapify(free)
    bucket_places, places = [b % tasks for b in range(buckets)], [set() for _ in heavy]
    for n, is_bucket, i in sorted(pieces, reverse=True):
        load, t = heapq.heappop(free)
        if is_bucket:
            bucket_places[i] = t
        else:
            places[i].add(t)
        heapq.heappush(free, (load + n, t))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(PLACES, T.ArrayType(T.IntegerType()))])
    return LoadPlan(key, total, tasks, spark.createDataFrame([(r[key], sorted(p)) for r, p in zip(heavy, places, strict=True)], schema), bucket_places, loads.withColumnRenamed("_n", "n"))


def fragment(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """df with TASK: rows of a heavy key go round its tasks by their place in the scan, so copies of a row spread too."""
    h = plan.heavy.withColumnRenamed(plan.key, HEAVY)
    return (
        df.join(F.broadcast(h), F.col(plan.key).eqNullSafe(F.col(HEAVY)), "left")
        .withColumn(
            TASK,
            F.when(
                F.col(PLACES).isNotNull(),
                F.element_at(PLACES, (F.pmod(F.monotonically_increasing_id(), F.size(PLACES)) + 1).cast("int")),
            ).otherwise(plan.place_light()),
        )
        .drop(HEAVY, PLACES)
    )


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side: one copy for each task that holds a shard of the key, one copy in all for light keys."""
    h = plan.heavy.withColumnRenamed(plan.key, HEAVY)
    return (
        df.join(F.broadcast(h), F.col(plan.key).eqNullSafe(F.col(HEAVY)), "left")
        .withColumn(TASK, F.explode(F.coalesce(PLACES, F.array(plan.place_light()))))
        .drop(HEAVY, PLACES)
    )


def balanced_join(left: DataFrame, right: DataFrame, plan: LoadPlan, how: str = "inner") -> DataFrame:
    """left join right on the plan's key; left is fragmented, right replicated, each moved once to the planned task.

    how: inner, left, left_semi or left_anti. Null keys match nothing, as in SQL. Columns of right that left has too get
    `_right` behind their names.
    """
    taken = set(left.columns) - {plan.key}
    right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in taken})
    a = fragment(left, plan).repartitionById(plan.tasks, F.col(TASK))
    b = replicate(right, plan).repartitionById(plan.tasks, F.col(TASK))
    return a.join(b, [TASK, plan.key], how).drop(TASK)


def balanced_per_key(df: DataFrame, plan: LoadPlan, time: str, value: str, matching: DataFrame | None = None) -> DataFrame:
    """One row per key: n rows, latest time, mean of the finite values (summed exactly if the column is a decimal).

    Each shard of a key is combined within the tasks of the scan, then goes to its planned task. matching (key, ...), if
    given, is replicated to the shards there: keys that it doesn't hold are left out, its other columns (one row per key)
    are added. The few shards of a key are merged last. NaN and infinite values don't count in the mean; a key without
    finite values has a null mean. A null key is a key unless there is a matching side, which it never matches.
    """
    v = F.col(value)
    if not isinstance(df.schema[value].dataType, T.DecimalType):
        v = v.cast("double")
        v = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    part = (
        fragment(df.select(F.col(plan.key), F.col(time).alias("_time"), v.alias("_value")), plan)
        .groupBy(TASK, plan.key)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_time").alias("_latest"),
            F.sum("_value").alias("_sum"),
            F.count("_value").alias("_values"),
        )
        .repartitionById(plan.tasks, F.col(TASK))
    )
    more = []
    if matching is not None:
        part = part.join(replicate(matching, plan).repartitionById(plan.tasks, F.col(TASK)), [TASK, plan.key])
        more = [F.max(c).alias(c) for c in matching.columns if c != plan.key]
    return part.groupBy(plan.key).agg(
        F.sum("_n").alias("n"),
        F.max("_latest").alias("latest"),
        F.when(F.sum("_values") > 0, F.sum("_sum").cast("double") / F.sum("_values")).alias("mean_value"),
        *more,
    )
