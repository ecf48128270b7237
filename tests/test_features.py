import random

import pytest

from loamline.operators import features
from loamline.plans.general import R
from tests.compare import compare
from tests.small import at, write

DAY = 86_400_000_000


def events(seed, n=2000):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 3 + [f"a{i}" for i in range(9)]), f"k{r.randrange(30)}", 1, r.randrange(50), r.randrange(400) * DAY) for _ in range(n)]


def brute(rows):
    cells = {}
    for e, k, n, t, last in rows:
        a = cells.get((e, k), (0, 0, 0))
        cells[e, k] = (a[0] + n, a[1] + t, max(a[2], last))
    newest = {}
    for (e, _), (_, _, last) in cells.items():
        newest[e] = max(newest.get(e, 0), last)
    return {(e, k): (*v, newest[e]) for (e, k), v in cells.items()}


@pytest.mark.parametrize("slab", [1 << 22, 40])
def test_cells(spark, monkeypatch, slab):
    monkeypatch.setattr(features, "SLAB_CELLS", slab)
    monkeypatch.setattr(features, "COMBINE_ROWS", 300)
    rows = events(1)
    df = spark.createDataFrame([*rows, (None, "k", 1, 1, 1), ("x", None, 1, 1, 1), ("x", "k", 1, 1, None)], "entity string, event_type string, n bigint, total bigint, last bigint")
    got = {(r["entity"], r["event_type"]): (r["n"], r["total"], r["last"], r["entity_last"]) for r in features.feature_cells(df).collect()}
    assert got == brute(rows)
    some = {(r["entity"], r["event_type"]) for r in features.feature_cells(df, 8, 200, 3 * DAY).collect()}
    assert some == {k for k, (n, t, last, newest) in brute(rows).items() if n >= 8 and t >= 200 and newest - last >= 3 * DAY}


def test_wide_table(spark):
    rows = events(2, 300)
    df = spark.createDataFrame(rows, "entity string, event_type string, n bigint, total bigint, last bigint")
    types = ["k1", "k0", "never"]
    want = brute(rows)
    for r in features.feature_table(df, types).collect():
        for i, k in enumerate(types):
            cell = want.get((r["entity"], k))
            assert r["n"][i] == (cell[0] if cell else 0) and r["total"][i] == (cell[1] if cell else 0)
            assert r["days_since"][i] == ((cell[3] - cell[2]) // DAY if cell else None)


def test_empty(spark):
    df = spark.createDataFrame([], "entity string, event_type string, n bigint, total bigint, last bigint")
    assert features.feature_cells(df).count() == 0 and features.feature_table(df, ["k"]).count() == 0


def test_found_on_dirty_tables(spark, tmp_path):
    r = random.Random(3)
    commits, files = [], []
    for i in range(80):
        c = {"repo_id": r.choice(["a/a", "b/b"]), "sha": str(i), "ts": at(r.randrange(400)), "author": r.choice(["X@y ", "x@y", " z@z", "", None]), "log_ord": i}
        commits += [c, {**c, "log_ord": i + 1000}]
        for o in range(r.randrange(4)):
            area = r.choice(["p/q/core/m/A.java", "p/q/B.java", "p/q/api/C.java"])
            f = {"repo_id": c["repo_id"], "sha": c["sha"], "file_ord": o, "path": r.choice(["m/", ""]) + r.choice(["src/main/java/", "src/test/java/", "src/"]) + area}
            f |= {"old_path": r.choice([None, None, "src/main/java/p/q/core/O.java"]), "added": r.choice([None, 30, 5]), "deleted": r.choice([None, 20]), "is_file_deletion": r.choice([True, False, None])}
            files += [f, f]
    write(tmp_path, "file_changes", files)
    d = write(tmp_path, "commits", commits)
    for q in ("p5_found", "p5_features"):
        assert compare(spark, d, R.queries[q], R.sql[q]) == ""
    d = write(tmp_path, "commits", [])
    assert R.queries["p5_found"](spark, d).count() == 0
