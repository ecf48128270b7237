"""Labelled change cases: mining, exclusion, labels, capping and chronological splits."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.ids import case_id
from loamline.functions.paths import is_test_path
from loamline.functions.subjects import is_bug_fix, is_cosmetic
from loamline.operators import history
from loamline.operators.evidence import FEATURES

#: Labels by spread, days before the snapshot in which fixes may be missing, shares of the splits.
HIGH_SPREAD, MEDIUM_SPREAD = 4, 1
CENSOR_DAYS = 180
TRAIN, VALIDATION = 0.70, 0.15


def exclusion(bulk: Column, duplicate: Column, censored: Column) -> Column:
    """Why a commit gives no cases, or null: the first reason that holds."""
    return (
        F.when(F.col("parent").isNull(), "root_commit")
        .when(duplicate, "duplicate_patch")
        .when(bulk, "bulk_commit")
        .when(is_cosmetic("subject"), "cosmetic_commit")
        .when(censored, "censored_recent")
    )


def label(spread: Column | str, caused_bug_fix: Column | str) -> Column:
    """HIGH for four or more components or a bug, MEDIUM for one or more, else LOW; a negative spread is an error."""
    s = F.col(spread) if isinstance(spread, str) else spread
    bug = F.coalesce(F.col(caused_bug_fix) if isinstance(caused_bug_fix, str) else caused_bug_fix, F.lit(False))
    return (
        F.when(s < 0, F.raise_error(F.lit("a spread can't be negative")).cast("string"))
        .when(bug | (s >= HIGH_SPREAD), "HIGH")
        .when(s >= MEDIUM_SPREAD, "MEDIUM")
        .otherwise("LOW")
    )


def candidates(touches: DataFrame, commits: DataFrame, duplicates: DataFrame, parent_paths: DataFrame | None = None, censor_days: int = CENSOR_DAYS) -> DataFrame:
    """One row per commit and production component: repo_id, sha, component_id, as_of, existing, reason, action, spread,
    impacted_test_count, parent, target_path.

    target_path is where the parent commit has the component, by parent_paths (repo_id, sha, component_id, parent_path) as
    lineage.first_paths makes them; without an entry it is the least path of the touch. A component is production in a commit unless all its paths there are test paths; it exists if it was alive just
    before. spread counts the other existing production components. The reason is null for commits that give cases.
    Repeated rows count once; a commit at its first place in the log.
    """
    keys = ["repo_id", "component_id", "sha"]
    activity = history.asof_activity(touches).select(*keys, F.col("as_of").alias("t"), "alive")
    flags = touches.groupBy(*keys).agg(
        F.bool_and(F.forall(F.coalesce("paths", F.array().cast("array<string>")), is_test_path)).alias("test"),
        F.bool_or("is_bulk").alias("bulk"),
        F.bool_and("removes_component").alias("removes"),
        F.min(F.array_min("paths")).alias("path"),
    )
    if parent_paths is not None:
        flags = flags.join(parent_paths, keys, "left").withColumn("path", F.coalesce("parent_path", "path")).drop("parent_path")
    head = commits.groupBy("repo_id", "sha").agg(F.min(F.struct("log_ord", "parent", "subject")).alias("_h")).select("repo_id", "sha", "_h.parent", "_h.subject")
    twice = duplicates.where("duplicate").select("repo_id", "sha", F.lit(True).alias("_twice"))
    end = activity.groupBy("repo_id").agg((F.max("t") - censor_days * history.DAY).alias("_censor"))
    d = activity.join(flags, keys).join(head, ["repo_id", "sha"]).join(twice, ["repo_id", "sha"], "left").join(end, "repo_id")
    per = d.groupBy("repo_id", "sha").agg(F.count_if(~F.col("test") & F.col("alive")).alias("_existing"), F.count_if("test").alias("impacted_test_count"))
    d = d.where("not test").join(per, ["repo_id", "sha"])
    return d.select(
        "repo_id",
        "sha",
        "component_id",
        F.timestamp_micros("t").alias("as_of"),
        F.col("alive").alias("existing"),
        exclusion(F.col("bulk"), F.coalesce("_twice", F.lit(False)), F.col("t") >= F.col("_censor")).alias("reason"),
        F.when(F.col("removes"), "DELETE").otherwise("MODIFY").alias("action"),
        (F.col("_existing") - 1).alias("spread"),
        "impacted_test_count",
        "parent",
        F.col("path").alias("target_path"),
    )


def mined(c: DataFrame, inducing: DataFrame | None = None) -> DataFrame:
    """The cases among candidates, with ids and labels. inducing (repo_id, sha, component_id, fixes ARRAY<STRING>)."""
    d = c.where("existing and reason is null")
    none = F.expr("cast(array() as array<string>)")
    if inducing is None:
        d = d.withColumn("fixes", none)
    else:
        d = d.join(inducing.select("repo_id", "sha", "component_id", "fixes"), ["repo_id", "sha", "component_id"], "left").withColumn("fixes", F.coalesce("fixes", none))
    bug = F.size("fixes") > 0
    return d.select(
        case_id("repo_id", "sha", "component_id").alias("case_id"),
        "repo_id",
        F.col("sha").alias("commit_sha"),
        F.col("parent").alias("parent_sha"),
        "as_of",
        F.col("component_id").alias("target_component_id"),
        F.col("target_path").alias("target_parent_path"),
        "action",
        F.col("spread").alias("label_spread"),
        F.col("impacted_test_count").alias("label_impacted_test_count"),
        bug.alias("label_caused_bug_fix"),
        F.size("fixes").alias("label_fix_commit_count"),
        label("spread", bug).alias("label"),
    )


#: A case's columns before and after its features.
ID_COLUMNS = ("case_id", "repo_id", "commit_sha", "parent_sha", "as_of", "target_component_id", "target_parent_path", "action")
LABEL_COLUMNS = ("label_spread", "label_impacted_test_count", "label_caused_bug_fix", "label_fix_commit_count", "label")


def config_counts_at_parent(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, config_config_reference_count): the evidence of that type on the target at the parent commit.

    Of several rows the one of the latest load, then the smallest evidence_id, counts. Cases without such evidence give no row.
    """
    e = evidence.where("evidence_type = 'config_reference_count' and availability = 'AVAILABLE' and value.num is not null")
    e = e.groupBy("repo_id", F.col("component_id").alias("target_component_id"), F.col("snapshot").alias("parent_sha")).agg(
        F.min_by(F.col("value.num"), F.struct(-F.col("load_id"), "evidence_id", "value.num")).alias("config_config_reference_count")
    )
    return cases.join(e, ["repo_id", "target_component_id", "parent_sha"]).select("case_id", "config_config_reference_count")


def with_features(mined_cases: DataFrame, touches: DataFrame, config_counts: DataFrame) -> DataFrame:
    """Cases with their feature columns, as known strictly before each commit: ID_COLUMNS, the features, LABEL_COLUMNS.

    A case whose features see its own commit or a later one is an error. What isn't known is null.
    """
    keys = ["repo_id", "component_id", "sha"]
    a = history.asof_activity(touches).join(history.co_change_before(touches), keys)
    leak = (F.col("last_sha") == F.col("sha")) | (F.col("days_since_last_change") < 0)
    message = F.concat(F.lit("features can see the change or later: "), *[x for k in keys for x in (F.col(k), F.lit(" "))])
    a = a.withColumn("as_of", F.when(leak, F.raise_error(message).cast("bigint")).otherwise(F.col("as_of")))
    known = F.col("historical_commit_count") > 0
    git = [F.when(known, F.col(f.removeprefix("git_")).cast("double")).alias(f) for f in FEATURES if f.startswith("git_")]
    a = a.select(F.col("repo_id"), F.col("component_id").alias("target_component_id"), F.col("sha").alias("commit_sha"), F.col("as_of").alias("_seen"), *git)
    c = mined_cases.join(a, ["repo_id", "target_component_id", "commit_sha"]).where(F.unix_micros(F.col("as_of").cast("timestamp")) == F.col("_seen"))
    c = c.join(config_counts, "case_id", "left").withColumn("action_is_delete", F.when(F.col("action") == "DELETE", 1.0).otherwise(0.0))
    return c.select(*ID_COLUMNS, *FEATURES, *LABEL_COLUMNS)


def exclusion_tally(c: DataFrame) -> DataFrame:
    """(repo_id, reason, n): existing components that gave no case, by reason, and new_component, which always occurs."""
    new = c.groupBy("repo_id").agg(F.count_if(~F.col("existing")).alias("n")).select("repo_id", F.lit("new_component").alias("reason"), "n")
    return c.where("existing and reason is not null").groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(new)


def inducing_commits(touches: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, sha, component_id, fixes): for lines without blame, the commit that last added lines to what a fix changed.

    A fix is a commit whose subject says so. The link goes from each component that it changes to that component's
    latest earlier touch that added lines.
    """
    t = history.clean_touches(touches)
    head = commits.groupBy("repo_id", "sha").agg(F.min(F.struct("log_ord", "subject")).alias("_h"))
    fixes = head.where(is_bug_fix("_h.subject")).select("repo_id", "sha", F.lit(True).alias("_fix"))
    t = t.join(fixes, ["repo_id", "sha"], "left").withColumn("_adds", F.when(F.col("added") > 0, F.struct("t", "sha")))
    b = history.running_before(t, history.KEYS, "t", [], ["_adds"])
    b = b.where("_fix and before__adds is not null").withColumnRenamed("sha", "fix_sha")
    return b.groupBy("repo_id", F.col("before__adds.sha").alias("sha"), "component_id").agg(F.array_sort(F.collect_set("fix_sha")).alias("fixes"))


def trace_fixes(fix_lines: DataFrame, blame: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo_id, sha, component_id, fixes) from blame: fix_lines (repo_id, fix_sha, component_id, path, line) with
    blame (repo_id, fix_sha, path, line, sha), kept where that commit changed a component of `changed` (repo_id, sha)."""
    links = fix_lines.join(blame, ["repo_id", "fix_sha", "path", "line"]).join(changed.select("repo_id", "sha").distinct(), ["repo_id", "sha"], "left_semi")
    return links.groupBy("repo_id", "sha", "component_id").agg(F.array_sort(F.collect_set("fix_sha")).alias("fixes"))


def cap_cases(cases: DataFrame, most: int, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """At most `most` cases of each repository, whole commits, chosen by a hash of the commit.

    Commits are taken in order of their hash while they fit; the first that doesn't fit ends it. A histogram over hash
    buckets finds the bucket in which a repository's cap lies, and only that bucket is put in order.
    """
    sizes = cases.groupBy("repo_id", "commit_sha").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_h", F.shiftrightunsigned(F.xxhash64("repo_id", "commit_sha", F.lit(seed)), 1))
    sizes = sizes.withColumn("_b", F.expr(f"_h div {-(-(1 << 63) // buckets)}L") if buckets > 1 else F.lit(0))
    upto = F.sum("_n").over(Window.partitionBy("repo_id").orderBy("_b"))
    hist = sizes.groupBy("repo_id", "_b").agg(F.sum("_n").alias("_n")).withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    s = sizes.join(hist.select("repo_id", "_b", "_upto", "_before"), ["repo_id", "_b"])
    inside = s.where((F.col("_before") <= most) & (F.col("_upto") > most))
    run = F.sum("_n").over(Window.partitionBy("repo_id", "_b").orderBy("_h", "commit_sha").rowsBetween(Window.unboundedPreceding, 0))
    edge = inside.withColumn("_run", F.col("_before") + run).where(F.col("_run") <= most)
    keep = s.where(F.col("_upto") <= most).select("repo_id", "commit_sha").unionByName(edge.select("repo_id", "commit_sha"))
    return cases.join(keep, ["repo_id", "commit_sha"], "left_semi")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], bucket: int) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles of a whole number, between neighbours by proportion.

    Rows are counted in buckets of that width; only the buckets that hold a wanted rank are put in order.
    """
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / bucket).alias("_b"))
    hist = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    hist = hist.withColumns({"_before": F.sum("_n").over(w.orderBy("_b")) - F.col("_n"), "_all": F.sum("_n").over(w)})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(ps)])
    want = hist.withColumn("_r", F.explode(ranks)).where("floor(_r.at) + 1 >= _before and floor(_r.at) < _before + _n")
    rows = d.join(want.select(*keys, "_b", "_before").distinct(), [*keys, "_b"])
    rows = rows.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_v")) - 1)
    asked = hist.select(*keys, "_all").distinct().withColumn("_r", F.explode(ranks)).select(*keys, "_r.i", "_r.at")
    low, high = F.floor("at"), F.ceil("at")
    near = rows.select(*keys, "_rank", "_v").join(asked, keys).where((F.col("_rank") == low) | (F.col("_rank") == high))
    q = near.groupBy(*keys, "i", "at").agg(F.max(F.when(F.col("_rank") == low, F.col("_v"))).alias("_l"), F.max(F.when(F.col("_rank") == high, F.col("_v"))).alias("_u"))
    q = q.withColumn("q", F.col("_l") + (F.col("_u") - F.col("_l")) * (F.col("at") - low))
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(ps))])


def chronological_splits(cases: DataFrame, holdout: Sequence[str] = (), train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """cases with `split`: each repository's earliest cases train, then validation, then test; held-out repositories apart.

    Cases before the train quantile of the times train, those before the next quantile validate. A null time is null.
    """
    d = cases.drop("split").withColumn("_loamline_t", F.unix_micros(F.col("as_of").cast("timestamp")))
    held = F.col("repo_id").isin(*holdout) if holdout else F.lit(False)
    q = quantiles(d.where(~held), ["repo_id"], "_loamline_t", (train, train + validation), 2**36)
    q = q.withColumnsRenamed({"q0": "_loamline_q0", "q1": "_loamline_q1"})
    t, a, b = (F.col(f"_loamline_{c}") for c in ("t", "q0", "q1"))
    when = F.when(held, "holdout").when(t < a, "train").when(t < b, "validation").when(t.isNotNull(), "test")
    return d.join(q, "repo_id", "left").withColumn("split", when).drop("_loamline_t", "_loamline_q0", "_loamline_q1")
