import random

import pytest

from loamline.operators import history
from loamline.plans.reference import R
from tests.compare import compare
from tests.small import at, write


def touches(folder, seed, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        sha = f"s{r.randrange(50)}"
        rows.append(
            {
                "repo_id": r.choice(["a/a", "b/b"]),
                "component_id": r.choice(["p.Hub", "p.Hub", "p.A", "p.B", "p.CTest", None]),
                "sha": sha,
                "ts": at(int(sha[1:]) // 2 * 9 + 0.25),  # pairs of commits share a time
                "author": r.choice(["X", "x ", "y", "", None]),
                "added": r.choice([None, 4, 0]),
                "deleted": r.choice([None, 2]),
                "paths": r.choice([None, [], ["src/test/java/T.java"], ["src/main/java/A.java"]]),
                "is_bulk": int(sha[1:]) % 11 == 0,
                "removes_component": r.random() < 0.15,
            }
        )
    seen, out = set(), []
    for x in rows:  # one row per commit and component, then repeats
        if (x["repo_id"], x["component_id"], x["sha"]) not in seen:
            seen.add((x["repo_id"], x["component_id"], x["sha"]))
            out.append(x)
    return write(folder, "touches", out + out[:20])


QUERIES = ("asof_activity", "co_change_before", "snapshot_cutoffs", "snapshot_activity", "alive_components", "co_change_pairs")


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("query", QUERIES)
def test_random_touches(spark, tmp_path, query, seed):
    d = touches(tmp_path, seed)
    assert compare(spark, d, R.queries[query], R.sql[query]) == ""


@pytest.mark.parametrize("query", QUERIES)
def test_empty(spark, tmp_path, query):
    assert R.queries[query](spark, write(tmp_path, "touches", [])).count() == 0


def test_running_before(spark, monkeypatch):
    monkeypatch.setattr(history, "PIECE", 10)
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.randrange(-30, 60), r.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id int, t bigint, n int")
    got = {x["id"]: (x["before_n"], x["before_id"]) for x in history.running_before(df.withColumn("id2", df["id"]).drop("id2"), ["k"], "t", ["n"], ["id"]).collect()}
    for k, i, t, _ in rows:
        earlier = [x for x in rows if x[0] == k and x[2] < t]
        assert got[i] == (sum(x[3] for x in earlier), max((x[1] for x in earlier), default=None))
