"""Evidence rows, their ids, and features made from them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.ids import evidence_id, feature_column, iso_time, locations
from loamline.operators import history
from loamline.sources.tables import micros

#: The version written into rows, the methods that made them, and how many things a row lists.
SCHEMA_VERSION = "1.2.0"
GIT_METHOD = "git_history@0.1.0"
CONFIG_METHOD = "config_files@0.1.0"
LISTED_COMMITS, LISTED_FILES, LISTED_PARTNERS = 20, 20, 10
#: GIT evidence types with their units.
GIT_TYPES = {
    "recent_commit_count": "commits",
    "historical_commit_count": "commits",
    "days_since_last_change": "days",
    "unique_contributors": "authors",
    "lines_added": "lines",
    "lines_deleted": "lines",
    "total_churn": "lines",
    "churn_ratio": "ratio",
    "co_change_count": "components",
}
#: The feature vector's columns in order.
FEATURES = (
    "action_is_delete",
    "git_churn_ratio",
    "git_co_change_count",
    "git_days_since_last_change",
    "git_historical_commit_count",
    "git_lines_added",
    "git_lines_deleted",
    "git_recent_commit_count",
    "git_total_churn",
    "git_unique_contributors",
    "config_config_reference_count",
)
#: Evidence types of which a component may have many rows; they are no features.
MULTI_VALUED = ("config_reference",)

#: Texts of notes.
NOTE_LIFE = (" non-merge commits touching this component before as_of (latest ", " listed); renames followed")
NOTE_RECENT = " commits in the last {} days"
NOTE_TOGETHER = "partners changed together >= {} times: "
NOTE_ALONE = "no partner reached the minimum co-change support"
NOTE_NO_CHURN = "total churn is zero"
NOTE_NO_HISTORY = "no commits found for this component before as_of"

_NO_FILES = "cast(array() as array<struct<path string, line int>>)"
_NO_TEXTS = "cast(array() as array<string>)"


def with_ids(rows: DataFrame) -> DataFrame:
    """Adds evidence_id. Rows of multi-valued types differ by the places they name."""
    end = lambda c: F.coalesce(iso_time(F.col(f"time_window.{c}")), F.lit(""))
    parts = [F.col(c) for c in ("repo_id", "snapshot", "component_id", "source", "evidence_type")]
    parts += [iso_time("as_of"), end("start_ts"), end("end_ts")]
    many = F.col("evidence_type").isin(*MULTI_VALUED)
    return rows.withColumn(
        "evidence_id", F.when(many, evidence_id([*parts, locations("provenance.files")])).otherwise(evidence_id(parts))
    )


def git_evidence(touches: DataFrame, scope: DataFrame, cutoffs: DataFrame, recent_days: int = 90, support: int = 2) -> DataFrame:
    """Nine rows for each component in scope (repo_id, component_id, snapshot) at its repository's cutoff.

    Components without touches before the cutoff get UNKNOWN rows without value, unit and window; a churn ratio
    without churn is UNKNOWN too but keeps its window. Values are doubles; the churn ratio has four places. Notes about
    partners list the strongest, ties in order of name. Rows with a value list all files of the touches, in order.
    """
    a = history.activity_at(touches, cutoffs, recent_days)
    p = history.partners_at(touches, cutoffs, support)
    keys = ["repo_id", "component_id"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "partner"))
    top = p.withColumn("_rank", rank).where(F.col("_rank") <= LISTED_PARTNERS)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "partner", "n"))), lambda x: F.concat(x["partner"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    p = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("co_change_count")).join(top.groupBy(*keys).agg(F.array_join(names, ", ").alias("_partners")), keys)
    f = touches.join(cutoffs, "repo_id").where(micros("ts") < F.col("as_of")).select(*keys, F.explode("paths").alias("_path")).where("_path is not null").distinct()
    f = f.groupBy(*keys).agg(F.array_sort(F.collect_list("_path")).alias("_paths"))  # the names that a component ever had
    d = scope.select(*keys, "snapshot").distinct().join(cutoffs, "repo_id").join(a.drop("as_of"), keys, "left").join(p, keys, "left").join(f, keys, "left")
    files = F.transform(F.coalesce("_paths", F.expr(_NO_TEXTS)), lambda x: F.struct(x.alias("path"), F.lit(None).cast("int").alias("line")))
    known = F.col("historical_commit_count").isNotNull()
    d = d.withColumn("co_change_count", F.when(known, F.coalesce("co_change_count", F.lit(0))))
    ts = lambda c: F.timestamp_micros(c)
    cutoff = F.col("as_of")
    lifetime = F.struct(ts(F.col("first_t")).alias("start_ts"), ts(cutoff).alias("end_ts"))
    trailing = F.struct(ts(cutoff - recent_days * history.DAY).alias("start_ts"), ts(cutoff).alias("end_ts"))
    none = F.lit(None).cast("struct<start_ts: timestamp, end_ts: timestamp>")
    window = {"recent_commit_count": trailing, "churn_ratio": trailing, "days_since_last_change": none}
    total = F.col("historical_commit_count")
    shown = F.least(total, F.lit(LISTED_COMMITS))
    life_note = F.concat(total.cast("string"), F.lit(NOTE_LIFE[0]), shown.cast("string"), F.lit(NOTE_LIFE[1]))
    recent_note = F.concat(F.col("recent_commit_count").cast("string"), F.lit(NOTE_RECENT.format(recent_days)))
    together = F.when(F.col("co_change_count") > 0, F.concat(F.lit(NOTE_TOGETHER.format(support)), F.col("_partners"))).otherwise(NOTE_ALONE)
    notes = {"recent_commit_count": recent_note, "churn_ratio": recent_note, "co_change_count": together, "days_since_last_change": F.lit(None).cast("string")}
    commits = {
        "days_since_last_change": F.array("last_sha"),
        "recent_commit_count": F.slice("latest_shas", F.lit(1), F.least(F.col("recent_commit_count"), F.lit(LISTED_COMMITS)).cast("int")),
        "co_change_count": F.expr(_NO_TEXTS),
    }
    commits["churn_ratio"] = commits["recent_commit_count"]

    def row(kind: str, unit: str) -> Column:
        has = F.col(kind).isNotNull()
        note = F.when(has, notes.get(kind, life_note)).when(known, NOTE_NO_CHURN).otherwise(NOTE_NO_HISTORY)
        return F.struct(
            F.lit(kind).alias("evidence_type"),
            F.col(kind).cast("double").alias("num"),
            F.when(has, unit).alias("unit"),
            F.when(known, window.get(kind, lifetime)).alias("time_window"),
            F.when(has, commits.get(kind, F.col("latest_shas"))).otherwise(F.expr(_NO_TEXTS)).alias("commits"),
            F.when(has, files).otherwise(F.expr(_NO_FILES)).alias("files"),
            note.alias("note"),
        )

    d = d.select(*keys, "snapshot", "as_of", F.explode(F.array(*[row(k, u) for k, u in GIT_TYPES.items()])).alias("e"))
    d = d.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "repo_id",
        "snapshot",
        "component_id",
        F.lit("GIT").alias("source"),
        "e.evidence_type",
        F.when(
            F.col("e.num").isNotNull(),
            F.struct(F.col("e.num").alias("num"), F.lit(None).cast("string").alias("str"), F.when(F.col("e.evidence_type") == "churn_ratio", "float").otherwise("int").alias("kind")),
        ).alias("value"),
        "e.unit",
        F.when(F.col("e.num").isNotNull(), "AVAILABLE").otherwise("UNKNOWN").alias("availability"),
        ts(F.col("as_of")).alias("as_of"),
        "e.time_window",
        F.struct(F.col("e.commits").alias("commits"), F.col("e.files").alias("files"), F.expr(_NO_TEXTS).alias("trace_ids"), F.col("e.note").alias("note")).alias("provenance"),
        F.lit(GIT_METHOD).alias("extraction_method"),
    )
    return with_ids(d)


def co_change_edges(touches: DataFrame, scope: DataFrame, cutoffs: DataFrame, evidence: DataFrame, support: int = 2) -> DataFrame:
    """One CO_CHANGE edge per component and partner, both in scope, with the id of the component's co_change_count row."""
    keys = ["repo_id", "component_id"]
    inside = scope.select(*keys, "snapshot").distinct()
    p = history.partners_at(touches, cutoffs, support).join(inside, keys)
    p = p.join(inside.select("repo_id", F.col("component_id").alias("partner")).distinct(), ["repo_id", "partner"], "left_semi")
    ids = evidence.where("evidence_type = 'co_change_count'").groupBy(*keys, "snapshot").agg(F.min("evidence_id").alias("_id"))
    return p.join(ids, [*keys, "snapshot"], "left").select(
        "repo_id",
        "snapshot",
        F.col("component_id").alias("source_id"),
        F.col("partner").alias("target_id"),
        F.lit("CO_CHANGE").alias("edge_type"),
        F.col("n").alias("count"),
        F.when(F.col("_id").isNotNull(), F.array("_id")).otherwise(F.expr(_NO_TEXTS)).alias("evidence_ids"),
    )


def features(evidence: DataFrame, keys: list[str], action: str | None = None, strict: bool = True) -> DataFrame:
    """One row per key with the feature columns; what isn't known is null.

    Types that are no features are ignored. Two different available values of one feature contradict each other: with
    strict the query fails, without it `conflicts` counts such features and the larger value stands. action names the
    column whose DELETE makes action_is_delete 1; without it the column is 0. A key without usable evidence has nulls.
    """
    column = feature_column("source", "evidence_type")
    e = evidence.where(~F.col("evidence_type").isin(*MULTI_VALUED))
    num = F.when((F.col("availability") == "AVAILABLE") & ~F.isnan("value.num"), F.col("value.num"))
    e = e.select(*keys, *([action] if action else []), column.alias("_c"), num.alias("_v"))
    aggs: list[Column] = []
    for f in FEATURES[1:]:
        v = F.when(F.col("_c") == f, F.col("_v"))
        aggs += [F.min(v).alias(f"_low_{f}"), F.max(v).alias(f)]
    deletes = F.max(F.when(F.col(action) == "DELETE", 1.0).otherwise(0.0)) if action else F.lit(0.0)
    g = e.groupBy(*keys).agg(*aggs, deletes.alias(FEATURES[0]))
    conflicts = sum((F.coalesce((F.col(f"_low_{f}") != F.col(f)).cast("int"), F.lit(0)) for f in FEATURES[1:]), F.lit(0))
    out = g.select(*keys, *FEATURES, conflicts.alias("conflicts"))
    if strict:
        message = F.concat(F.lit("contradicting evidence for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
        return out.withColumn(FEATURES[0], F.when(F.col("conflicts") > 0, F.raise_error(message).cast("double")).otherwise(F.col(FEATURES[0]))).drop("conflicts")
    return out


def to_vector(features_: DataFrame) -> DataFrame:
    """Adds `vector`: the features in order, what isn't known as NaN."""
    return features_.withColumn("vector", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in FEATURES]))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row (n, fingerprint) that is the same for the same rows in any order: counts and folded hashes of their JSON."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.bit_xor(F.conv(F.substr(h, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("bigint")).alias(f"_h{i}") for i in range(4)]
    d = rows.agg(F.count(F.lit(1)).alias("n"), *parts)
    return d.select("n", F.sha2(F.concat_ws("|", "n", *[f"_h{i}" for i in range(4)]), 256).alias("fingerprint"))
