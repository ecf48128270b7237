import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loamline.operators import cases, lineage, quality
from loamline.sources import gitlog, sinks
from loamline.sources.tables import table

ROOT = "src/main/java/com/shop"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """A small history: create, edit and rename, delete."""
    d = tmp_path_factory.mktemp("repos") / "own__shop"
    d.mkdir()

    def run(*args, when=0):
        stamp = f"{1_700_000_000 + 86_400 * when} +0000"
        env = os.environ | {"GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp, "GIT_CONFIG_GLOBAL": "/dev/null"}
        return subprocess.run(["git", "-C", str(d), "-c", "user.name=N", "-c", "user.email= Dev@X.org", *args], env=env, check=True, capture_output=True, text=True).stdout

    def put(path, text):
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_text(text)

    run("init", "-q")
    put(f"{ROOT}/Cart.java", "package com.shop;\nclass Cart {\n  int x = 1;\n  int y = 2;\n}\n")
    put(f"{ROOT}/Old.java", "package com.shop;\nclass Old {\n  int a;\n  int b;\n  int c;\n}\n")
    put("pom.xml", "<p/>")
    run("add", "."), run("commit", "-qm", "Create \x1f shop", when=0)
    run("mv", f"{ROOT}/Old.java", f"{ROOT}/New.java")
    put(f"{ROOT}/Cart.java", "package com.shop;\nclass Cart {\n  int x = 7;\n  int y = 2;\n}\n")
    run("add", "."), run("commit", "-qm", "Rename", when=1)
    run("rm", "-q", f"{ROOT}/Cart.java"), run("commit", "-qm", "Drop cart", when=2)
    out = tmp_path_factory.mktemp("printed")
    log = ["log", "HEAD", "--full-history", "--no-merges", "-M"]
    first, fix = run(*log, "--format=%H").split()[-1], run(*log, "--format=%H").split()[-2]
    path = f"{ROOT}/Cart.java"
    patches = subprocess.run(["git", "-C", str(d), "patch-id", "--stable"], input=run(*log, "-p", "--", "*.java"), check=True, capture_output=True, text=True).stdout
    printed = {
        "log": run(*log, "-z", "--numstat", "--format=%x1e%H%x1f%ct%x1f%ae%x1f%P%x1f%s", "--", "*.java"),
        "gone": run(*log, "-z", "--diff-filter=D", "--name-only", "--format=%x1e%H", "--", "*.java"),
        "tree": run("ls-tree", "-r", "-z", "HEAD"),
        "patches": patches,
        "diffs": f"\x1e{fix}\x1f{path}\n" + run("diff", "-w", "-U0", "-M", first, fix, "--", path),
        "blames": f"\x1e{fix}\x1f{path}\n" + run("blame", "--porcelain", "-w", first, "--", path),
    }
    for name, text in printed.items():
        (out / f"own__shop.{name}").write_text(text)
    return str(d), str(out)


def test_log(spark, repo):
    log = gitlog.log_records(spark, repo[1])
    c = {r["subject"]: r for r in gitlog.commits(log).collect()}
    assert [c[s]["log_ord"] for s in ("Drop cart", "Rename", "Create \x1f shop")] == [0, 1, 2]
    assert c["Create \x1f shop"]["parent"] is None and c["Rename"]["parent"] == c["Create \x1f shop"]["sha"]
    assert c["Rename"]["repo_id"] == "own/shop" and c["Rename"]["author"] == "dev@x.org" and str(c["Rename"]["ts"]) == "2023-11-15 22:13:20"
    f = gitlog.file_changes(log, gitlog.deletions(spark, repo[1])).collect()
    assert [(r["path"], r["old_path"], r["added"], r["deleted"]) for r in f if r["old_path"]] == [(f"{ROOT}/New.java", f"{ROOT}/Old.java", 0, 0)]
    assert [(r["path"], r["deleted"]) for r in f if r["is_file_deletion"]] == [(f"{ROOT}/Cart.java", 5)]
    assert len(f) == 5 and not any(r["path"] == "pom.xml" for r in f)


def test_long_logs_are_read_in_pieces(spark, tmp_path):
    rows = [f"\x1e{i:040x}\x1f{1_700_000_000 - i}\x1fa@x\x1f{i + 1:040x} {i + 2:040x}\x1fs{i}\x00\n3\t-\t\x00{i}\x001\t2\tx\x00-\t7\tb\tc{i}.java\x00" for i in range(400)]
    (tmp_path / "a__b.log").write_text("".join(rows))
    (tmp_path / "c__d__e.log").write_text("".join(rows[:3]) + "\x1e" + "f" * 40 + "\x1f0\x1f\x1f\x1f")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = gitlog.log_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r for r in got if r["repo_id"] == "a/b"), key=lambda r: r["log_ord"])
    assert [r["log_ord"] for r in a] == list(range(400)) and [r["subject"] for r in a] == [f"s{i}" for i in range(400)]
    # a name that looks like a count isn't one, and tabs may be in names
    assert [tuple(x) for x in a[5]["changes"]] == [(3, 0, "1\t2\tx", "5"), (0, 7, "b\tc5.java", None)] and a[5]["parent"] == f"{6:040x}"
    other = sorted((r for r in got if r["repo_id"] != "a/b"), key=lambda r: r["log_ord"])
    assert [r["log_ord"] for r in other] == [0, 1, 2, 3] and other[3]["parent"] is None and other[3]["changes"] == []


def test_renames_carry_history(spark, repo):
    log = gitlog.log_records(spark, repo[1])
    c, f = gitlog.commits(log), gitlog.file_changes(log, gitlog.deletions(spark, repo[1]))
    now = spark.createDataFrame([("own/shop", "com.shop.New", f"{ROOT}/New.java")], "repo_id string, component_id string, file_path string")
    touches = lineage.build_touches(lineage.attribute_changes(c, f, now), c, f)
    assert touches.where("component_id = 'com.shop.New'").count() == 2
    assert touches.where("component_id = 'com.shop.Cart' and removes_component").count() == 1


def test_other_listings(spark, repo):
    folder, out = repo
    files = gitlog.tree(spark, out).collect()
    assert {r["path"] for r in files} == {"pom.xml", f"{ROOT}/New.java"} and all(len(r["blob"]) == 40 for r in files)
    assert gitlog.patches(spark, out).select("patch_id").distinct().count() == 3
    whole = gitlog.working_files(spark, os.path.dirname(folder)).collect()
    assert [(r["repo_id"], r["path"], r["text"].splitlines()[0]) for r in whole] == [("own/shop", f"{ROOT}/New.java", "package com.shop;")]
    first = gitlog.commits(gitlog.log_records(spark, out)).where("subject like 'Create%'").first()["sha"]
    gone, blamed = gitlog.fix_lines(spark, out), gitlog.blamed_lines(spark, out)
    assert [r["line"] for r in gone.collect()] == [3] and {(r["line"], r["sha"]) for r in blamed.collect()} == {(n, first) for n in range(1, 6)}
    changed = spark.createDataFrame([("own/shop", first)], "repo_id string, sha string")
    got = cases.trace_fixes(gone.withColumn("component_id", F.lit("com.shop.Cart")), blamed, changed).collect()
    assert [r["component_id"] for r in got] == ["com.shop.Cart"] and len(got[0]["fixes"]) == 1


def test_sinks(spark, tmp_path):
    c = table(spark, "/root/testdata/sf0.001", "cases").distinct()
    sinks.write_cases(c, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/cases.parquet").count() == c.count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/static_feature_requests.csv").columns == list(sinks.STATIC_REQUEST)
    line = next(f for f in os.listdir(f"{tmp_path}/out/change_cases.jsonl") if f.startswith("part"))
    assert set(json.loads(open(f"{tmp_path}/out/change_cases.jsonl/{line}").readline())) == set(c.columns)
    sinks.write_report(c, f"file://{tmp_path}/out", "v1", {"seed": 42})
    said = json.load(open(f"{tmp_path}/out/quality_report.json"))
    assert said["total_cases"] == c.count() and "splits_are_chronological" in said["leakage_checks"]
    assert "Dataset quality report" in open(f"{tmp_path}/out/quality_report.md").read()
    schema = sinks.json_schema(table(spark, "/root/testdata/sf0.001", "evidence"), "evidence_item")
    assert schema["properties"]["value"]["properties"]["num"] == {"type": ["number", "null"]} and "evidence_id" in schema["required"]


def test_reviews(spark, tmp_path):
    links = spark.createDataFrame([("a/b", f"s{i}", "p.C", [f"f{i}", "g"]) for i in range(20)], "repo_id string, sha string, component_id string, fixes array<string>")
    some = quality.link_sample(links, 7)
    assert some.count() == 7 and sorted(map(tuple, some.collect())) == sorted(map(tuple, quality.link_sample(links.repartition(5), 7).collect()))
    sinks.write_review(some.withColumn("note", F.lit('a "b",\n')), str(tmp_path / "review"))
    back = sinks.read_review(spark, str(tmp_path / "review"))
    assert back.count() == 7 and {(r["verdict"], r["note"]) for r in back.collect()} == {(None, 'a "b",\n')}
    (tmp_path / "done.csv").write_text('sha,verdict\n1,Yes\n2, no\n3,maybe\n4,\n')
    assert [r["verdict"] for r in sinks.read_review(spark, str(tmp_path / "done.csv")).orderBy("sha").collect()] == [True, False, None, None]
    links.selectExpr("'c' as case_id", "repo_id", "sha as commit_sha", "component_id as target_component_id", "fixes as fix_commit_shas").write.json(str(tmp_path / "cases"))
    assert sinks.read_case_links(spark, str(tmp_path / "cases")).select("fix").distinct().count() == 21
