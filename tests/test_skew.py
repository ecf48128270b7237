import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamline.operators import skew
from loamline.plans.general import R
from tests.compare import compare
from tests.small import at, write


def rows(seed=1):
    r = random.Random(seed)
    out = [("hot", i, float(i)) for i in range(600)] + [("warm", i, None) for i in range(150)]
    out += [(f"k{r.randrange(60)}", r.randrange(9), r.choice([1.0, float("nan"), float("inf"), None])) for _ in range(300)]
    out += [(None, 3, 2.0)] * 5
    return out * 2  # repeated rows count


def test_per_key_equals_plain_grouping(spark):
    df = spark.createDataFrame(rows(), "k string, t int, v double").repartition(5)
    plan = skew.plan_load(df, "k", tasks=6)
    assert plan.total == len(rows())
    got = {r["k"]: (r["n"], r["latest"], r["mean_value"]) for r in skew.balanced_per_key(df, plan, "t", "v").collect()}
    want = {}
    for k, t, v in rows():
        n, last, s, c = want.get(k, (0, -1, 0.0, 0))
        ok = v is not None and abs(v) < 1e300
        want[k] = (n + 1, max(last, t), s + (v if ok else 0), c + ok)
    assert set(got) == set(want)
    for k, (n, last, s, c) in want.items():
        assert got[k][:2] == (n, last)
        assert got[k][2] == (pytest.approx(s / c) if c else None)


def test_per_key_with_a_matching_side(spark):
    df = spark.createDataFrame(rows(), "k string, t int, v double").repartition(5)
    plan = skew.plan_load(df, "k", tasks=6)
    facts = spark.createDataFrame([("hot", 7), ("k1", 8), ("none", 9), (None, 1)], "k string, fact int")
    plain = {r["k"]: r for r in skew.balanced_per_key(df, plan, "t", "v").collect()}
    got = {r["k"]: r for r in skew.balanced_per_key(df, plan, "t", "v", facts).collect()}
    assert {k: (r["n"], r["latest"], r["fact"]) for k, r in got.items()} == {k: (plain[k]["n"], plain[k]["latest"], f) for k, f in (("hot", 7), ("k1", 8))}
    copies = {r["k"]: r["count"] for r in skew.replicate(facts, plan).groupBy("k").count().collect()}
    shards = {r["k"]: r["n"] for r in skew.fragment(df, plan).groupBy("k").agg(F.countDistinct(skew.TASK).alias("n")).collect()}
    assert copies["hot"] == shards["hot"] > 1 and copies["k1"] == shards["k1"] == 1


def test_a_hot_key_is_spread_in_proportion_and_light_keys_stay_whole(spark):
    df = spark.createDataFrame(rows(), "k string, t int, v double").repartition(5)
    plan = skew.plan_load(df, "k", tasks=6)
    heavy = {r["k"] for r in plan.heavy.collect()}
    assert "hot" in heavy and len(heavy) <= plan.tasks * skew.SPLIT
    load = Counter()
    for r in skew.fragment(df, plan).groupBy("k", skew.TASK).count().collect():
        load[r[skew.TASK]] += r["count"]
    assert max(load.values()) < 0.5 * len(rows())
    light = skew.fragment(df.where("k like 'k%'"), plan).groupBy("k").agg(F.countDistinct(skew.TASK).alias("n"))
    assert light.agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(k, t) for k, t, _ in rows()], "k string, x int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 5), ("k2", 6), (None, 7), ("none", 8)], "k string, x int")
    plan = skew.plan_load(left, "k", tasks=5)
    got = skew.balanced_join(left, right, plan, how)
    want = left.join(right.withColumnRenamed("x", "x_right"), "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    count = lambda df: Counter(tuple(r[c] for c in sorted(want.columns)) for r in df.collect())
    assert count(got) == count(want)


def test_join_moves_each_side_once(spark):
    left, right = spark.range(1000).withColumnRenamed("id", "k"), spark.range(500).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.balanced_join(left, right, skew.plan_load(left, "k"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, t int, v double")
    assert skew.balanced_per_key(df, skew.plan_load(df, "k"), "t", "v").count() == 0


def test_found_with_nulls_and_ties(spark, tmp_path):
    cases = [{"case_id": f"c{i}", "repo_id": k, "as_of": at(i % 3)} for i, k in enumerate([" A/b", "a/B ", "x/y", None, "a/b", "z/z"] * 5 + [f"r/{j}" for j in range(40)])]
    d = write(tmp_path, "cases", cases)
    write(tmp_path, "evidence", [{"evidence_id": str(i), "component_id": c} for i, c in enumerate(["p.A", "p.B", None] * 4)])
    assert compare(spark, d, R.queries["p3_found"], R.sql["p3_found"]) == ""
    assert compare(spark, d, R.queries["p3_per_key"], R.sql["p3_per_key"]) == ""
