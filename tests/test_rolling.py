import random

import pytest

from loamline.operators import rolling
from loamline.plans.general import R
from tests.compare import compare
from tests.small import at, write


def brute(daily, periods):
    out = {}
    for e in {e for e, _, _ in daily}:
        n = {}
        for x, d, k in daily:
            if x == e:
                n[d] = n.get(d, 0) + k
        for d in range(min(n), max(n) + 1):
            out[e, d] = tuple(sum(n.get(x, 0) for x in range(d - p + 1, d + 1)) for p in periods)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_totals(spark, seed):
    r = random.Random(seed)
    daily = [(r.choice("abc"), r.randrange(-150, 400), r.randrange(1, 9)) for _ in range(120)]
    df = spark.createDataFrame([*daily, (None, 5, 1), ("a", None, 1)], "e string, day int, n int")
    periods = (1, 7, 30, 64, 65, 90, 129, 200)
    want = brute(daily, periods)
    take = lambda df: {(x["e"], x["day"]): tuple(x[f"n{p}"] for p in periods) for x in df.collect()}
    assert take(rolling.rolling_totals(df, "e", periods)) == want
    known = df.where("e is not null and day is not null")
    halves = rolling.rolling_totals(known.where("n < 5"), "e", periods, known.where("n >= 5"))
    assert take(halves) == want
    assert all(x["total90"] == x["n90"] and x["mean90"] == x["n90"] / 90 for x in halves.collect())


def test_late_commits(spark):
    # the log's end arrives first: c and d come after b, which is of a later day; a is repeated
    rows = [("r", "a", 0, 9), ("r", "a", 0, 2), ("r", "b", 5, 8), ("r", "c", 1, 7), ("r", "d", 3, 6), ("r", "e", 5, 5), ("r", "f", 6, 0), ("s", "a", 1, 0), ("s", "x", 1, None)]
    c = spark.createDataFrame([(r, s, at(d), o) for r, s, d, o in rows], "repo_id string, sha string, ts timestamp, log_ord bigint")
    on_time, late = ({(r["repo_id"], r["day"] - 19723): r["n"] for r in df.collect()} for df in rolling.late_commits(c))
    assert on_time == {("r", 0): 1, ("r", 5): 2, ("r", 6): 1, ("s", 1): 2} and late == {("r", 1): 1, ("r", 3): 1}


def test_corrections_touch_named_shards_only(spark):
    daily = spark.createDataFrame([("a", 3, 5), ("a", 70, 2), ("b", 3, 1)], "e string, day int, n int")
    late = spark.createDataFrame([("a", 3, -2), ("a", 5, 4), ("c", 1, 1)], "e string, day int, n int")
    trees = lambda df: {(r["e"], r["shard"]): {k: v["n"] for k, v in r["tree"].items() if v["n"]} for r in df.collect()}
    corrected = trees(rolling.correct_trees(rolling.build_trees(daily, "e"), late, "e"))
    assert corrected == trees(rolling.build_trees(daily.union(late), "e"))
    assert corrected["a", 1] == trees(rolling.build_trees(daily, "e"))["a", 1]
    assert len(corrected["a", 0]) <= 2 * (rolling.LEVELS + 1)


def test_found_on_dirty_commits(spark, tmp_path):
    r = random.Random(4)
    rows = [{"repo_id": r.choice(["a/a", "A/a", None]), "sha": f"{r.randrange(60)}", "ts": at(r.choice([0, 1, 2, 33, 34, 120]) + r.random()), "log_ord": i} for i in range(90)]
    rows += [{"repo_id": "a/a", "sha": None, "ts": at(1)}, {"repo_id": "a/a", "sha": "x", "ts": None}]
    d = write(tmp_path, "commits", rows + rows[:9])
    for q in ("p6_found", "p6_rolling"):
        assert compare(spark, d, R.queries[q], R.sql[q]) == ""
    d = write(tmp_path, "commits", [])
    assert R.queries["p6_found"](spark, d).count() == 0


def test_windows_of_evidence(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(120):
        end, length = r.choice([0, 3, 40, 100, 260]), r.choice([7, 30, 90, 12, 7.5])
        rows.append(
            {
                "evidence_id": f"e{i}", "repo_id": r.choice(["a/a", "b/b", None]), "load_id": i % 3, "evidence_type": r.choice(["recent_commit_count", "loc"]),
                "value": r.choice([None, {"num": 3.0}, {"num": float("nan")}, {"num": 0.5}, {"num": float("inf")}]),
                "time_window": r.choice([None, {"start_ts": at(end - length), "end_ts": at(end)}, {"start_ts": at(end - length), "end_ts": at(end)}, {"start_ts": None, "end_ts": at(end)}]),
            }
        )
    d = write(tmp_path, "evidence", rows + rows[:20])
    assert compare(spark, d, R.queries["p6_windows"], R.sql["p6_windows"]) == ""
    assert R.queries["p6_windows"](spark, write(tmp_path, "evidence", [])).count() == 0
