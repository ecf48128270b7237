"""Reports on a set of cases: tables of labels, missing values, medians, leakage checks, review metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels in order, the share from which a repository dominates, the normal quantile of 95 %.
LABELS = ("LOW", "MEDIUM", "HIGH")
DOMINANT = 0.6
Z95 = 1.96


def label_table(cases: DataFrame, by: str) -> DataFrame:
    """(by, LOW, MEDIUM, HIGH, total): labelled cases of each value."""
    counts = [F.count_if(F.col("label") == x).alias(x) for x in LABELS]
    return cases.groupBy(by).agg(*counts).withColumn("total", sum((F.col(x) for x in LABELS), F.lit(0)))


def missing_rates(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, missing, n): rows where the feature is null or NaN."""
    aggs = [F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns]
    wide = cases.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in columns])
    return wide.select("_n", F.explode(rows).alias("r")).select("r.feature", "r.missing", F.col("_n").alias("n"))


def repo_shares(cases: DataFrame) -> DataFrame:
    """(repo_id, n, share, dominant): a row per repository."""
    n = cases.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_t")).withColumn("_k", F.lit(1))
    out = n.withColumn("_k", F.lit(1)).join(total, "_k").withColumn("share", F.col("n") / F.col("_t"))
    return out.select("repo_id", "n", "share", (F.col("share") > DOMINANT).alias("dominant"))


def medians_by_label(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(label, feature, median) over known values, between the middle two if their number is even.

    Values are counted first, so what is put in order is the distinct values of a feature.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = cases.where("label is not null").select("label", F.explode(pairs).alias("p")).select("label", "p.feature", "p.v").where("v is not null and not isnan(v)")
    n = long.groupBy("label", "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label", "feature")
    n = n.withColumns({"_upto": F.sum("n").over(w.orderBy("v")), "_all": F.sum("n").over(w)})
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    holds = lambda rank: (F.col("_upto") - F.col("n") <= rank) & (rank < F.col("_upto"))
    return n.groupBy("label", "feature").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))


def leakage_checks(cases: DataFrame, features: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """(check, passed), a row per check; equal times at a split boundary are allowed."""
    ids = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("passed"))
    days = cases.agg(F.coalesce(F.min(F.when(~F.isnan("git_days_since_last_change"), F.col("git_days_since_last_change"))) >= 0, F.lit(True)).alias("passed"))
    edge = {s: (F.min(F.when(F.col("split") == s, F.col("as_of"))), F.max(F.when(F.col("split") == s, F.col("as_of")))) for s in ("train", "validation", "test")}
    per = cases.groupBy("repo_id").agg(*[f.alias(f"{s}_{i}") for s, fs in edge.items() for i, f in enumerate(fs)])
    late = F.coalesce(F.col("train_1") > F.col("validation_0"), F.lit(False)) | F.coalesce(F.col("validation_1") > F.col("test_0"), F.lit(False))
    order = per.agg((F.count_if(late) == 0).alias("passed"))
    free = cases.sparkSession.createDataFrame([(not set(features) & set(forbidden),)], "passed boolean")
    named = (("no_forbidden_column_used_as_feature", free), ("case_ids_unique", ids), ("days_since_last_change_non_negative", days), ("splits_are_chronological", order))
    out = None
    for name, df in named:
        df = df.select(F.lit(name).alias("check"), "passed")
        out = df if out is None else out.unionByName(df)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null without a whole."""
    return F.when(whole > 0, part / whole)


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share, within 0 and 1; null without trials."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def review(rows: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """Precision, recall and their counts of a reviewed yes/no prediction; rows without verdict don't count."""
    r = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    g = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(F.col(predicted) & F.col(actual)).alias("right"),
        F.count_if(predicted).alias("predicted"),
        F.count_if(actual).alias("actual"),
    )
    low, high = wilson(F.col("right"), F.col("predicted"))
    return g.withColumns({"precision": ratio(F.col("right"), F.col("predicted")), "recall": ratio(F.col("right"), F.col("actual")), "low": low, "high": high})


def sample(df: DataFrame, keys: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """At most `most` distinct keys for a review, the same ones for the same seed whatever the order of rows."""
    d = df.select(*keys).distinct()
    return d.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(most)


def count_bounds(activity: DataFrame, components: DataFrame, changes: DataFrame, commits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(repo_id, component_id, counted, plain): components whose historical_commit_count is below its lower bound.

    The bound is the number of commits before the cutoff (repo_id, as_of) that change the component's present file, its
    least file_path. Components without counted history are not judged.
    """
    keys = ["repo_id", "component_id"]
    live = components.groupBy(*keys).agg(F.min("file_path").alias("path")).where("path is not null")
    when = commits.where("ts is not null").select("repo_id", "sha", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t")).distinct()
    plain = changes.select("repo_id", "path", "sha").distinct().join(when, ["repo_id", "sha"]).join(cutoffs, "repo_id").where("_t < as_of")
    plain = plain.select("repo_id", "path", "sha").distinct().join(live, ["repo_id", "path"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("plain"))
    counted = activity.select(*keys, F.col("historical_commit_count").alias("counted"))
    return counted.join(plain, keys).where("counted < plain")


def link_sample(links: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most `most` (repo_id, inducing commit, component, fix) of links (repo_id, sha, component_id, fixes), for a review."""
    each = links.select("repo_id", "sha", "component_id", F.explode("fixes").alias("fix"))
    return sample(each, ["repo_id", "sha", "component_id", "fix"], most, seed)


def fixes_traced(links: DataFrame) -> DataFrame:
    """(repo_id, inducing, fixes): commits that brought bugs in and fixes traced to them; links (repo_id, sha, fixes)."""
    each = links.select("repo_id", "sha", F.explode("fixes").alias("fix"))
    return each.groupBy("repo_id").agg(F.countDistinct("sha").alias("inducing"), F.countDistinct("fix").alias("fixes"))
