import random

import pytest
from pyspark.sql import functions as F

from loamline.functions.paths import component_of_path
from loamline.operators import lineage

ROOT = "src/main/java/p/"


def history(seed):
    """A random log with renames that cross, cycle and reuse paths."""
    r = random.Random(seed)
    paths = [f"{ROOT}C{i}.java" for i in range(8)] + ["README.md", f"{ROOT}package-info.java"]
    commits, changes = [], []
    for repo in ("a/a", "b/b"):
        for i in range(40):
            sha = f"{repo}{i}"
            commits += [(repo, sha, None, i, "x", "s", i)] * r.choice([1, 1, 2])
            for o in range(r.randrange(4)):
                old = r.choice([None, None, *paths])
                new = r.choice(paths)
                changes += [(repo, sha, o, new, None if old == new else old, 3, 1, r.random() < 0.2)] * r.choice([1, 1, 2])
    live = [(repo, f"p.L{i}", f"{ROOT}C{i}.java") for repo in ("a/a", "b/b") for i in range(8) if r.random() < 0.4]
    return commits, changes, live


def brute(commits, changes, live):
    """The definition, commit by commit."""
    out = {}
    order = {}
    for repo, sha, *_, place in commits:
        order[repo, sha] = min(place, order.get((repo, sha), place))
    for repo in {c[0] for c in commits}:
        files = sorted({c for c in changes if c[0] == repo}, key=lambda c: (order[repo, c[1]], c[2]))
        exists = {p for q, _, p in live if q == repo}
        newest = {}
        for c in files:
            if c[4]:
                newest.setdefault(c[4], c[3])
        stands = {}
        for c in files:
            path, old = c[3], c[4]
            if path in stands:
                final = stands[path]
            else:
                final, seen = path, {path}
                while final in newest and final not in exists:
                    final = newest[final]
                    if final in seen:
                        break
                    seen.add(final)
            if old:
                stands.pop(path, None)
                stands[old] = final
            out[repo, c[1], c[2]] = final
    return out


@pytest.mark.parametrize("seed", range(6))
def test_attribution(spark, seed):
    commits, changes, live = history(seed)
    c = spark.createDataFrame(commits, "repo_id string, sha string, parent string, ts int, author string, subject string, log_ord bigint")
    f = spark.createDataFrame(changes, "repo_id string, sha string, file_ord int, path string, old_path string, added bigint, deleted bigint, is_file_deletion boolean")
    k = spark.createDataFrame([(*x,) for x in live], "repo_id string, component_id string, file_path string")
    got = {(r["repo_id"], r["sha"], r["file_ord"]): (r["final_path"], r["component_id"]) for r in lineage.attribute_changes(c, f, k).collect()}
    owner = {(repo, p): comp for repo, comp, p in live}
    names = {r["p"]: r["c"] for r in spark.createDataFrame([(f"{ROOT}C{i}.java",) for i in range(8)], "p string").withColumn("c", component_of_path("p")).collect()}
    want = {}
    for (repo, sha, o), final in brute(commits, changes, live).items():
        comp = owner.get((repo, final)) or names.get(final)
        if comp:
            want[repo, sha, o] = (final, comp)
    assert got == want


def test_touches(spark):
    commits = spark.createDataFrame([("r", "1", 1, " A ", 5), ("r", "2", 2, "b", 4), ("r", "2", 2, "b", 9)], "repo_id string, sha string, ts int, author string, log_ord bigint")
    rows = [("r", "1", 0, f"{ROOT}A.java", None, 5, None, False), ("r", "1", 1, f"{ROOT}B.java", None, 1, 1, False), ("r", "1", 1, f"{ROOT}B.java", None, 1, 1, False)]
    rows += [("r", "2", i, f"{ROOT}X{i}.java", None, 1, 0, True) for i in range(4)]
    changes = spark.createDataFrame(rows, "repo_id string, sha string, file_ord int, path string, old_path string, added bigint, deleted bigint, is_file_deletion boolean")
    none = spark.createDataFrame([], "repo_id string, component_id string, file_path string")
    attributed = lineage.attribute_changes(commits, changes, none)
    got = {r["component_id"]: r for r in lineage.build_touches(attributed, commits, changes, bulk_above=3).collect()}
    assert got["p.A"]["partners"] == ["p.B"] and got["p.A"]["added"] == 5 and got["p.A"]["deleted"] == 0 and got["p.A"]["author"] == "a"
    assert got["p.B"]["added"] == 1 and not got["p.B"]["removes_component"]
    assert got["p.X0"]["is_bulk"] and got["p.X0"]["partners"] == [] and got["p.X0"]["removes_component"]


def test_empty(spark):
    c = spark.createDataFrame([], "repo_id string, sha string, log_ord bigint")
    f = spark.createDataFrame([], "repo_id string, sha string, file_ord int, path string, old_path string, added bigint, deleted bigint, is_file_deletion boolean")
    k = spark.createDataFrame([], "repo_id string, component_id string, file_path string")
    assert lineage.attribute_changes(c, f, k).count() == 0


def test_ranges(spark):
    df = spark.createDataFrame([("a", x) for x in (9, 3, 4, 5, 4, None)] + [("b", 1)], "k string, line int")
    assert {tuple(r) for r in lineage.contiguous_ranges(df, ["k"], "line").collect()} == {("a", 3, 5), ("a", 9, 9), ("b", 1, 1)}


def test_prints_and_duplicates(spark):
    c = spark.createDataFrame([("r", "old", 9), ("r", "new", 1), ("r", "x", 5), ("q", "new", 1)], "repo_id string, sha string, log_ord bigint")
    p = spark.createDataFrame([("r", "old", "P"), ("r", "new", "P"), ("r", "x", None), ("q", "new", "P")], "repo_id string, sha string, patch_id string")
    assert {(r["repo_id"], r["sha"]) for r in lineage.first_duplicate(c, p).where(F.col("duplicate")).collect()} == {("r", "new")}


def test_first_paths(spark):
    rows = [("r", "s", "c", 2, "b", None), ("r", "s", "c", 1, "b", "a"), ("r", "s", "d", 0, "x", None)]
    df = spark.createDataFrame(rows, "repo_id string, sha string, component_id string, file_ord int, path string, old_path string")
    assert {(r["component_id"], r["parent_path"]) for r in lineage.first_paths(df).collect()} == {("c", "a"), ("d", "x")}
