import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import splits
from loamline.llm.queries import R
from tests.compare import compare
from tests.small import at, write

ROOT = "m/src/main/java/"


def tables(folder, seed):
    r = random.Random(seed)
    names = [f"p.C{i}" for i in range(30)]
    cases, changes = [], []
    for i in range(120):
        n = r.choice(names)
        cases.append(
            {
                "case_id": f"c{i:03}",
                "repo_id": r.choice(["A/b", "a/b ", "a/b", "x/y", None]),
                "target_component_id": r.choice([n, n.replace(".", "/"), n + "$In$ner", None, ""]),
                "as_of": r.choice([None, at(i)]),
            }
        )
    for i in range(25):
        a, b = (ROOT + r.choice([*names, "p.package-info"]).replace(".", "/") + ".java" for _ in range(2))
        changes.append({"repo_id": r.choice(["a/b", "A/B", "x/y", None]), "sha": str(i), "file_ord": 0, "path": a, "old_path": r.choice([b, b, None, "README.java"])})
    write(folder, "file_changes", changes + changes[:5])
    return write(folder, "cases", cases + cases[:15])


@pytest.mark.parametrize("seed", range(4))
def test_found(spark, tmp_path, seed):
    d = tables(tmp_path, seed)
    sql = R.sql["p1_found"].replace("from cases)", "from cases where repo_id is not null and target_component_id is not null)")
    known = lambda s, f: R.queries["p1_found"](s, f)
    assert compare(spark, d, known, sql) == ""


def test_a_group_never_straddles_splits(spark, tmp_path):
    d = tables(tmp_path, 9)
    rows = R.queries["p1_splits"](spark, d).collect()
    where = defaultdict(set)
    for x in rows:
        where[x["group_case_id"]].add((x["bin"], x["split"]))
    assert all(len(s) == 1 for s in where.values())
    assert {x["case_id"] for x in rows} == {f"c{i:03}" for i in range(120)}


def test_empty(spark, tmp_path):
    d = tables(tmp_path, 1)
    write(tmp_path, "file_changes", [])
    assert R.queries["p1_found"](spark, d).count() > 0
    write(tmp_path, "cases", [])
    assert R.queries["p1_found"](spark, d).count() == 0 and R.queries["p1_shares"](spark, d).count() == 0


def test_largest_differencing_beats_dealing_out(spark):
    r = np.random.default_rng(1)
    loads = np.sort(r.zipf(1.6, (40, 8)).clip(max=300), axis=None)[::-1].reshape(40, 8).astype(float)
    bins = splits.largest_differencing(loads)
    assert all(sorted(b) == list(range(8)) for b in bins.tolist())
    sums = np.bincount(bins.ravel(), loads.ravel(), 8)
    assert sums.sum() == loads.sum() and np.ptp(sums) <= max(1, np.ptp(loads.sum(axis=0)))


def test_balance_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(splits, "GROUPS_PER_SHARD", 50)
    monkeypatch.setattr(splits, "FAN_IN", 4)
    r = random.Random(3)
    groups = spark.createDataFrame([(f"g{i}", r.choice([1, 1, 2, 3, 20])) for i in range(1500)], "label string, n bigint")
    placed = splits.balance(groups, 16)
    assert placed.count() == placed.select("label").distinct().count() == 1500
    sums = [x["s"] for x in placed.join(groups, "label").groupBy("bin").agg(F.sum("n").alias("s")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 0.02 * sum(sums) / 16 + 3


def test_shares_reached_with_a_hot_group(spark, tmp_path):
    rows = [{"case_id": f"h{i}", "repo_id": "r/r", "target_component_id": "p.Hot"} for i in range(300)]
    rows += [{"case_id": f"c{i}", "repo_id": "r/r", "target_component_id": f"p.C{i % 250}"} for i in range(700)]
    write(tmp_path, "file_changes", [])
    d = write(tmp_path, "cases", rows)
    got = {x["split"]: x["share"] for x in R.queries["p1_shares"](spark, d).collect()}
    for s, p in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(got[s] - p) < 0.02


def test_allot_uses_whole_bins():
    got = splits.allot({b: 10 for b in range(20)}, {"a": 0.5, "b": 0.5})
    assert Counter(got.values()) == {"a": 10, "b": 10}
