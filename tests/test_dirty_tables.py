"""Queries of the evidence-mining operators on small tables with nulls, repeats and odd texts, and on empty ones."""

import random

import pytest

from loamline.plans.reference import R
from tests.compare import compare
from tests.small import at, write

TABLES = ("touches", "commits", "file_changes", "components", "cases", "evidence", "documents", "loads")


def dirty(folder, seed=1):
    r = random.Random(seed)
    repos, comps = ["a/a", "b/b"], ["com.shop.Cart", "com.shop.CartTest", "com.x.S3Client", "Top", "org.Y"]
    shas = [f"{i:040x}" for i in range(20)]
    touches = {}
    for _ in range(90):
        repo, comp, sha = r.choice(repos), r.choice([*comps, None]), r.choice(shas)
        i = int(sha, 16)
        touches[repo, comp, sha] = {
            "repo_id": repo, "component_id": comp, "sha": sha, "ts": at(i // 2 * 20), "author": r.choice(["A", None]), "added": r.choice([None, 3, 0]), "deleted": r.choice([None, 1]),
            "paths": r.choice([None, ["src/test/java/T.java"], ["src/main/java/A.java", "src/main/java/B.java"]]), "is_bulk": i % 9 == 0, "removes_component": r.random() < 0.1,
        }
    rows = list(touches.values())
    write(folder, "touches", rows + rows[:9])
    subjects = ["fix crash", "fix typo", None, "修复 x", "格式化代码", "add y", "minor formatting in z", "some formatting"]
    commits = [{"repo_id": q, "sha": s, "parent": r.choice([None, shas[0], shas[1]]), "ts": at(i), "author": "A", "subject": subjects[i % 8], "log_ord": 20 - i} for q in repos for i, s in enumerate(shas)]
    write(folder, "commits", commits + [c | {"log_ord": c["log_ord"] + 7} for c in commits[:5]])
    files = [{"repo_id": q, "sha": s, "file_ord": o, "path": r.choice(["src/main/java/A.java", "pom.xml", "x/src/test/java/p/B.java", "src/java/Z.java", "/src/main/java/Q.java"]), "added": r.choice([None, 2]), "deleted": 1} for q in repos for s in shas for o in range(r.randrange(3))]
    write(folder, "file_changes", files + files[:4])
    write(folder, "components", [{"repo_id": q, "component_id": c, "snapshot": s, "module": r.choice([None, "m"])} for q in repos for c in comps for s in ("s1", "s2")])
    kinds = [("GIT", "total_churn"), ("GIT", "churn_ratio"), ("CONFIG", "config_reference"), ("CONFIG", "config_reference_count"), (None, "loc"), ("GIT", None)]
    values = [None, {"num": None, "str": "TEST", "kind": "s"}, {"num": 2.0, "str": None, "kind": "i"}, {"num": float("nan"), "str": None, "kind": "f"}, {"num": 0.5, "str": None, "kind": "f"}]
    evidence = []
    for i in range(80):
        source, kind = r.choice(kinds)
        files_ = r.choice([None, [], [{"path": "src/main/resources/a.xml", "line": r.choice([None, 1, 2, 3, 9])}, {"path": "build.gradle", "line": 4}]])
        evidence.append(
            {
                "evidence_id": f"e{i}", "repo_id": r.choice([*repos, None]), "component_id": r.choice(comps), "snapshot": r.choice(["s1", None]), "source": source, "evidence_type": kind, "load_id": r.choice([1, 2]),
                "value": r.choice(values), "availability": r.choice(["AVAILABLE", "UNKNOWN", None]), "as_of": r.choice([at(1), at(1.123456789), None]),
                "time_window": r.choice([None, {"start_ts": at(0), "end_ts": None}, {"start_ts": None, "end_ts": at(3)}]),
                "provenance": r.choice([None, {"commits": [], "files": files_, "trace_ids": None, "note": None}]),
            }
        )
    write(folder, "evidence", evidence + evidence[:9])
    texts = [None, "", "  \n", "<beans>\n <!-- com.shop.Cart -->\n <bean class=\"com.shop.Cart\" ref=\"cart\"/>\n</beans>", "a:\n  b: com.shop.Cart # com.x.Gone\n  c: com.shop.Dead\n", "#x\nk=com.x.S3Client$In\r\nz=在com.shop.Cart\nw=org.Y.com.shop.Cart", "k=" + "com.shop.Cart " * 3000]
    write(folder, "documents", [{"doc_id": i, "text": t, "source": r.choice(["config_file", "config_file", None]), "repo_id": r.choice([*repos, None])} for i, t in enumerate(texts * 6)])
    write(folder, "loads", [])
    rows = [{"case_id": f"c{i}", "repo_id": r.choice([*repos, None]), "commit_sha": shas[i % 7], "as_of": r.choice([None, at(i)]), "action": r.choice(["MODIFY", None])} for i in range(30)]
    return write(folder, "cases", rows)


@pytest.mark.parametrize("query", list(R.sql))
def test_dirty(spark, tmp_path, query):
    if query in ("label_rule", "labels_by_action"):
        pytest.skip("tested on cases of their own")
    d = dirty(tmp_path)
    assert compare(spark, d, R.queries[query], R.sql[query]) == ""


def test_all_run_on_empty_tables(spark, tmp_path):
    for t in TABLES:
        d = write(tmp_path, t, [])
    for name, query in R.queries.items():
        assert query(spark, d).count() >= 0, name
