"""Writing results: Parquet, JSON lines, CSV, and small reports."""

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import evidence, quality

#: Columns of the request for structural features.
STATIC_REQUEST = ("case_id", "repo_id", "commit_sha", "parent_sha", "target_component_id", "target_parent_path")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file through the cluster's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in which nulls are written out."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_cases(cases: DataFrame, folder: str) -> None:
    """cases.parquet by repository, the cases as JSON lines, and the request for structural features as CSV."""
    cases.withColumn("_repo", F.translate("repo_id", "/", "_")).write.partitionBy("_repo").parquet(f"{folder}/cases.parquet")
    write_json(cases, f"{folder}/change_cases.jsonl")
    cases.select(*STATIC_REQUEST).write.option("header", True).csv(f"{folder}/static_feature_requests.csv")


def report(cases: DataFrame, features: Sequence[str] = evidence.FEATURES, forbidden: Sequence[str] = ()) -> dict:
    """The quality report. What comes to the driver are tables by label, split, action, feature and repository."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "total_cases": cases.count(),
        "labels_by_repo": rows(quality.label_table(cases, "repo_id")),
        "labels_by_split": rows(quality.label_table(cases, "split")),
        "actions": rows(cases.groupBy("action").count()),
        "feature_missing_rate": {r["feature"]: round(r["missing"] / r["n"], 4) if r["n"] else None for r in rows(quality.missing_rates(cases, features))},
        "repo_share": {r["repo_id"]: round(r["share"], 4) for r in rows(quality.repo_shares(cases))},
        "feature_median_by_label": rows(quality.medians_by_label(cases, features)),
        "leakage_checks": {r["check"]: r["passed"] for r in rows(quality.leakage_checks(cases, features, forbidden))},
    }


def to_markdown(r: dict, version: str) -> str:
    lines = [f"# Dataset quality report: {version}", "", f"{r['total_cases']} cases", "", "| split | LOW | MEDIUM | HIGH | total |", "|-|-|-|-|-|"]
    lines += [f"| {x['split']} | {x['LOW']} | {x['MEDIUM']} | {x['HIGH']} | {x['total']} |" for x in r["labels_by_split"]]
    lines += ["", "| feature | missing |", "|-|-|"] + [f"| {k} | {v} |" for k, v in r["feature_missing_rate"].items()]
    lines += ["", "| check | passed |", "|-|-|"] + [f"| {k} | {'yes' if v else 'NO'} |" for k, v in r["leakage_checks"].items()]
    most = max(r["repo_share"].values(), default=0)
    return "\n".join([*lines, "", f"Largest share of a repository: {most}" + (", which dominates" if most > quality.DOMINANT else ""), ""])


def write_report(cases: DataFrame, folder: str, version: str, settings: dict) -> dict:
    """quality_report.json and .md and manifest.json with the columns' roles."""
    r = report(cases)
    spark = cases.sparkSession
    manifest = {
        "dataset_version": version,
        "schema_version": evidence.SCHEMA_VERSION,
        "settings": settings,
        "columns": {"features": list(evidence.FEATURES), "label": "label", "split": "split", "forbidden": [c for c in cases.columns if c.startswith("label_")]},
    }
    write_text(spark, f"{folder}/quality_report.json", json.dumps(r, indent=2, default=str))
    write_text(spark, f"{folder}/quality_report.md", to_markdown(r, version))
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2))
    return r


def json_schema(df: DataFrame, name: str) -> dict:
    """A JSON Schema of the table's rows: every column required, nothing else allowed."""

    def of(t: dict | str) -> dict:
        if isinstance(t, dict) and t["type"] == "struct":
            return {"type": ["object", "null"], "properties": {f["name"]: of(f["type"]) for f in t["fields"]}, "required": [f["name"] for f in t["fields"]], "additionalProperties": False}
        if isinstance(t, dict) and t["type"] == "array":
            return {"type": ["array", "null"], "items": of(t["elementType"])}
        kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "integer": "integer", "long": "integer", "short": "integer"}
        return {"type": [kinds.get(str(t), "string"), "null"]}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": name, "title": name, **of(df.schema.jsonValue()), "type": "object"}


def write_review(rows: DataFrame, path: str, verdict: str = "verdict") -> None:
    """Rows for a review as CSV, with an empty column for the verdict."""
    rows.withColumn(verdict, F.lit("")).coalesce(1).write.option("header", True).options(quoteAll=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)  # a sample fits a task


def read_review(spark: SparkSession, path: str, verdict: str = "verdict") -> DataFrame:
    """Reviewed rows: the verdict as true or false, null where none (or anything but yes, no, true, false, 1, 0) was given."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    said = F.lower(F.trim(verdict))
    return d.withColumn(verdict, F.when(said.isin("yes", "true", "1"), True).when(said.isin("no", "false", "0"), False))


def read_case_links(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, repo_id, commit_sha, target_component_id, fix) of cases written as JSON lines with the fixes in fix_commit_shas."""
    schema = "case_id string, repo_id string, commit_sha string, target_component_id string, fix_commit_shas array<string>"
    return spark.read.schema(schema).json(path).select("case_id", "repo_id", "commit_sha", "target_component_id", F.explode("fix_commit_shas").alias("fix"))
