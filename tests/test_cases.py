import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import cases, evidence, quality
from loamline.plans.reference import R
from tests.compare import compare
from tests.small import at, write


def test_label_rule(spark):
    df = spark.createDataFrame([(0, False), (1, False), (3, None), (4, False), (0, True)], "s int, b boolean")
    assert [r[0] for r in df.select(cases.label("s", "b")).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1, False)], "s int, b boolean").select(cases.label("s", "b")).collect()


def test_exclusions_in_order(spark):
    df = spark.createDataFrame([(None, "fix typo", True), ("p", "fix typo", True), ("p", "fix typo", False), ("p", None, False)], "parent string, subject string, bulk boolean")
    got = [r[0] for r in df.select(cases.exclusion(F.col("bulk"), F.lit(False), F.lit(True))).collect()]
    assert got == ["root_commit", "bulk_commit", "cosmetic_commit", "censored_recent"]


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_cap_keeps_whole_commits_up_to_the_cap(spark, buckets):
    r = random.Random(2)
    rows = [(f"r{i % 2}", f"s{r.randrange(60)}", i, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "repo_id string, commit_sha string, id int, _n int")
    kept = cases.cap_cases(df, 90, buckets=buckets).collect()
    assert kept and "_n" in kept[0]
    sizes = Counter((a, b) for a, b, *_ in rows)
    per = defaultdict(int)
    for (repo, sha), n in Counter((k["repo_id"], k["commit_sha"]) for k in kept).items():
        assert n == sizes[repo, sha]
        per[repo] += n
    assert all(90 - max(sizes.values()) < n <= 90 for n in per.values())
    again = cases.cap_cases(df.repartition(3), 90, buckets=1)
    assert {k["id"] for k in again.collect()} == {k["id"] for k in kept}


def test_cap_above_the_size_keeps_all(spark):
    df = spark.createDataFrame([("r", "s", 1)], "repo_id string, commit_sha string, id int")
    assert cases.cap_cases(df, 5).count() == 1 and cases.cap_cases(df.where("false"), 5).count() == 0


@pytest.mark.parametrize("bucket", [1, 50, 10**6])
def test_quantiles(spark, bucket):
    r = random.Random(3)
    rows = [(k, r.randrange(-100, 1000)) for k in "aab" for _ in range(r.choice([1, 40, 77]))] + [("c", 5), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {x["k"]: (x["q0"], x["q1"], x["q2"]) for x in cases.quantiles(df, ["k"], "v", (0.0, 0.7, 0.85), bucket).collect()}
    for k in "abc":
        v = [x for y, x in rows if y == k and x is not None]
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.0, 0.7, 0.85])))


def test_splits_hold_out_and_order(spark, tmp_path):
    rows = [{"case_id": f"c{i}", "repo_id": "a/a" if i % 3 else "tallowbrook/auditkit", "as_of": at(i // 2)} for i in range(60)]
    rows += [{"case_id": "n", "repo_id": "a/a"}, {"case_id": "one", "repo_id": "b/b", "as_of": at(1)}]
    d = write(tmp_path, "cases", rows + rows[:5])
    assert compare(spark, d, R.queries["chronological_splits"], R.sql["chronological_splits"]) == ""
    clash = spark.read.parquet(f"{d}/cases.parquet").withColumn("q0", F.lit(1))
    assert cases.chronological_splits(clash).where("q0 = 1").count() == len(rows) + 5


@pytest.mark.parametrize("query", ["labels_by_split", "missing_rates", "repo_shares", "medians_by_label", "leakage_checks", "review_metrics", "label_rule"])
def test_reports_on_dirty_and_empty_cases(spark, tmp_path, query):
    r = random.Random(5)
    nan = float("nan")
    rows = [
        {
            "case_id": f"c{i}", "repo_id": r.choice(["a/a", "b/b", None]), "as_of": r.choice([None, at(r.randrange(9))]), "split": r.choice(["train", "validation", "test", None]),
            "label": r.choice(["LOW", "MEDIUM", "HIGH", None]), "label_spread": r.randrange(6), "label_caused_bug_fix": r.choice([True, False, None]),
            **{f: r.choice([None, nan, 1.0, 2.5, 7.0]) for f in evidence.FEATURES},
        }
        for i in range(80)
    ]
    for name in ("touches", "commits", "file_changes", "components"):  # review_metrics traces fixes in them
        write(tmp_path, name, [])
    d = write(tmp_path, "cases", rows + rows[:9])
    assert compare(spark, d, R.queries[query], R.sql[query]) == ""
    assert R.queries[query](spark, write(tmp_path, "cases", [])).count() >= 0


def test_wilson_without_trials(spark):
    low, high = quality.wilson(F.col("h"), F.col("n"))
    assert [tuple(r) for r in spark.createDataFrame([(0, 0)], "h int, n int").select(low, high).collect()] == [(None, None)]


def test_conflicting_evidence(spark):
    rows = [("c", "GIT", "total_churn", "AVAILABLE", v, "DELETE") for v in (1.0, 1.0)] + [("c", "GIT", "total_churn", "UNKNOWN", None, "DELETE"), ("c", "CONFIG", "config_reference", "AVAILABLE", 9.0, "DELETE")]
    shape = "component_id string, source string, evidence_type string, availability string, num double, action string"
    made = lambda rs: spark.createDataFrame(rs, shape).select("*", F.struct("num").alias("value"))
    r = evidence.to_vector(evidence.features(made(rows), ["component_id"], "action")).first()
    assert r["git_total_churn"] == 1.0 and r["action_is_delete"] == 1.0 and r["git_lines_added"] is None
    assert len(r["vector"]) == 11 and np.isnan(r["vector"][1])
    with pytest.raises(Exception, match="contradicting"):
        evidence.features(made([*rows, ("c", "GIT", "total_churn", "AVAILABLE", 2.0, "DELETE")]), ["component_id"], "action").collect()


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    a, b = evidence.fingerprint(df).first(), evidence.fingerprint(df.orderBy(F.desc("x")).repartition(3)).first()
    assert a == b and evidence.fingerprint(df.distinct()).first() != a
