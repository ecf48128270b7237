from pyspark.sql import functions as F

from loamline.operators import profile
from loamline.plans.general import R
from tests.compare import compare
from tests.small import at, write

GOOD = {
    "evidence_id": "e",
    "schema_version": "1.2.0",
    "repo_id": "a/b",
    "snapshot": "0" * 40,
    "component_id": "p.A$B",
    "source": "GIT",
    "evidence_type": "total_churn",
    "value": {"num": 3.0, "str": None, "kind": "int"},
    "availability": "AVAILABLE",
    "as_of": at(1),
    "load_id": 1,
}


def variants():
    num = lambda n, s=None: {"num": n, "str": s, "kind": "x"}
    changes = [
        {"repo_id": x} for x in (None, "", "a", "a/b\n", "a/b/c", "ä/b", "a b/c")
    ] + [{"component_id": x} for x in (None, "", "1a", "p..A", "p.A\n", "p.$A", "é.A")] + [{"snapshot": x} for x in (None, "0" * 39, "0" * 40 + "\n", "G" * 40)]
    changes += [{"evidence_type": x} for x in (None, "Total_churn", "loc")] + [{"source": None}, {"availability": None}, {"availability": "AVAILABLE "}]
    changes += [{"time_window": {"start_ts": at(2), "end_ts": at(1)}}, {"time_window": {"start_ts": at(2), "end_ts": None}}, {"time_window": {"start_ts": at(2), "end_ts": at(2)}}]
    changes += [{"value": v} for v in (None, num(None), num(-1.0), num(1.5), num(float("nan")), num(float("inf")), num(1.0, "x"), num(None, "x"), num(-0.0))]
    changes += [{"availability": "UNKNOWN"}, {"availability": "UNKNOWN", "value": None}, {"availability": "N/A", "value": num(-1.0)}]
    changes += [{"evidence_type": "churn_ratio", "value": num(v)} for v in (0.5, 1.0, 1.01, -0.1)]
    changes += [{"source": "CONFIG", "evidence_type": "config_reference", "value": v} for v in (num(None, "TEST"), num(None, "test"), num(1.0), num(1.0, "TEST"))]
    changes += [{"source": "RUNTIME", "evidence_type": "observed_use", "value": v} for v in (num(-1.5), num(None, "yes"), None)]
    return [GOOD | c | {"evidence_id": f"e{i}", "load_id": i % 3} for i, c in enumerate(changes)] + [GOOD]


def test_violations(spark, tmp_path):
    d = write(tmp_path, "evidence", variants() * 2)
    assert compare(spark, d, R.queries["p7_found"], R.sql["p7_found"]) == ""
    got = {tuple(r) for r in R.queries["p7_found"](spark, d).collect()}
    assert not any(i == "e" for i, _, _ in got)


def test_clashing_columns_and_empty(spark, tmp_path):
    d = write(tmp_path, "evidence", variants())
    e, suite = spark.read.parquet(f"{d}/evidence.parquet"), profile.evidence_suite()
    found = lambda df: profile.violations(profile.broken_states(df, suite, ["evidence_id", "load_id"]))
    plain = {tuple(r) for r in found(e).collect()}
    more = e.withColumn("partition", F.lit(1)).withColumn("field", F.lit("x")).withColumn("n", F.lit(0))
    assert {tuple(r) for r in found(more).collect()} == plain
    none = e.where("false")
    assert found(none).count() == 0


def test_states_merge(spark):
    suite = profile.Suite("p", {"x": "x"}, (profile.Check("x", "x < 0"),))
    df = spark.createDataFrame([(i % 3, None if i % 7 == 0 else i - 5) for i in range(200)], "p int, x int")
    whole = {r["partition"]: r for r in profile.merge_states(profile.states(df, suite)).collect()}
    parts = {r["partition"]: r for r in profile.merge_states(profile.states(df.where("x < 50"), suite), profile.states(df.where("x >= 50 or x is null"), suite)).collect()}
    for p, r in whole.items():
        assert (r["n"], r["nulls"], r["broken"], r["low_num"], r["high_num"]) == (parts[p]["n"], parts[p]["nulls"], parts[p]["broken"], parts[p]["low_num"], parts[p]["high_num"])


def test_alarms(spark):
    suite = profile.Suite("p", {"x": "x"}, ())
    rows = [(p, None if i < (40 if p == 15 else 2 + p % 2) else i) for p in range(20) for i in range(100)]
    prof = profile.profile(profile.states(spark.createDataFrame(rows, "p int, x int"), suite))
    assert [r["partition"] for r in prof.where("null_rate_alarm").collect()] == [15]


def test_alarms_of_counts_ranges_and_means(spark):
    suite = profile.Suite("p", {"x": "x"}, ())
    rows = [(p, float(i % 10 + (90 if p == 12 and i == 0 else 0))) for p in range(16) for i in range(300 if p == 14 else 100 + p % 2)]
    got = {r["partition"]: r for r in profile.profile(profile.states(spark.createDataFrame(rows, "p int, x double"), suite)).collect()}
    assert [p for p, r in got.items() if r["n_alarm"]] == [14] and got[14]["n_change"] == 199
    assert [p for p, r in got.items() if r["high_num_alarm"]] == [12] and 12 in [p for p, r in got.items() if r["mean_alarm"]]
    assert not any(r["low_num_alarm"] or r["distinct_alarm"] for p, r in got.items() if p != 12)


def test_distinct_counts_are_close(spark):
    df = spark.range(40_000).selectExpr("cast(id % 2 as int) as p", "id % 9000 as x", "id % 3 as y")
    got = {(r["partition"], r["field"]): r["distinct"] for r in profile.profile(profile.states(df, profile.Suite("p", {"x": "x", "y": "y"}, ()))).collect()}
    assert all(abs(got[p, "x"] - 4500) < 0.05 * 4500 and got[p, "y"] == 3 for p in (0, 1))


def test_profile_sql(spark, tmp_path):
    d = write(tmp_path, "evidence", [r | {"load_id": r["load_id"] if i % 5 else None} for i, r in enumerate(variants() * 2)])
    for q in ("p7_profile", "p7_states", "p7_availability_drift"):
        assert compare(spark, d, R.queries[q], R.sql[q]) == "", q


def test_value_drift(spark, tmp_path):
    num = lambda p, i: {"num": float(1 + i % 10) * (12 if p in (12, 13) else 1), "str": None, "kind": "int"}
    rows = [GOOD | {"evidence_id": f"{p}-{i}", "load_id": p, "value": num(p, i), "evidence_type": t} for p in range(16) for i in range(60) for t in ("lines_added",)]
    rows += [r | {"evidence_type": None, "value": {"num": 2.0, "str": None, "kind": "int"}} for r in rows]
    d = write(tmp_path, "evidence", rows)
    got = R.queries["p7_value_drift"](spark, d).collect()
    assert {(r["load_id"], r["evidence_type"], r["field"]) for r in got if r["mean_alarm"]} == {(12, "lines_added", "value_num"), (13, "lines_added", "value_num")}
    far = {r["load_id"] for r in got if r["field"] == "value_num" and r["distance_alarm"]}
    assert 12 in far and all(r["distance"] == 0 for r in got if r["field"] == "availability" and r["load_id"] > 0)
    one = next(r for r in got if r["load_id"] == 12 and r["mean_alarm"])
    assert abs(one["mean"] - 66) < 1e-9 and abs(one["mean_change"] - 60.5) < 1e-9 and one["n"] == 60


def test_distributions_merge(spark):
    df = spark.createDataFrame([(1, "a", float(x)) for x in (-8, -1, 0, 1, 1.2, 3, float("nan"), float("inf"))] + [(1, None, None)], "p int, g string, x double")
    make = lambda e: profile.distribution_states(e, "p", "g", "x", {"c": "g"})
    assert {tuple(map(str, r)) for r in make(df).collect()} == {tuple(map(str, r)) for r in profile.merge_distributions(make(df.where("x < 1")), make(df.where("not coalesce(x < 1, false)"))).collect()}


def test_every_field_has_its_entry(spark, tmp_path):
    num = lambda n, s=None: {"num": n, "str": s, "kind": "x"}
    values = [num(9.0), num(10.0), num(float("nan")), num(None, "TEST"), num(-2.0), None]
    rows = [GOOD | {"evidence_id": f"e{i}", "value": v, "time_window": {"start_ts": at(1), "end_ts": at(i) if i < 2 else None}} for i, v in enumerate(values)]
    rows[0]["provenance"] = {"commits": ["a", "b"], "files": None, "trace_ids": [], "note": None}
    got = {r["field"]: r for r in R.queries["p7_profile"](spark, write(tmp_path, "evidence", rows)).collect()}
    assert (got["value.num"]["low_num"], got["value.num"]["high_num"], got["value.num"]["mean"]) == (-2.0, 10.0, 17 / 3) and got["value.num"]["null_rate"] == 2 / 6
    assert (got["value.str"]["low"], got["value.str"]["high"], got["value"]["high"]) == ("TEST", "TEST", None) and got["value"]["null_rate"] == 1 / 6
    assert got["time_window.end_ts"]["null_rate"] == 4 / 6
    counts = {r["field"]: r["distinct"] for r in R.queries["p7_distincts"](spark, str(tmp_path)).collect()}
    assert counts["time_window.end_ts"] == 2 and counts["provenance.commits"] == 1 and got["provenance.commits.size"]["high_num"] == 2 and got["provenance.files"]["null_rate"] == 1
    assert got["provenance.trace_ids.size"]["low_num"] == 0 and got["provenance.trace_ids"]["null_rate"] == 5 / 6
