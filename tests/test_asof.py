import random

import pytest

from loamline.operators import asof
from loamline.plans.general import R
from tests.compare import compare
from tests.small import at, write


def tables(folder, seed, n_cases=150, n_evidence=400, one_entity=False):
    r = random.Random(seed)
    repos, comps = (["r/a"], ["p.A"]) if one_entity else (["r/a", "r/b", None], ["p.A", "p.B", "p.C"])
    shas = [f"{i:040x}" for i in range(12)]
    cases, evidence = [], []
    for i in range(n_cases):
        cases.append(
            {
                "case_id": f"c{i}",
                "repo_id": r.choice(repos),
                "target_component_id": r.choice(comps),
                "as_of": r.choice([None, at(r.randrange(40)), at(r.random() * 40)]),
                "parent_sha": r.choice([None, *shas]),
                "commit_sha": r.choice([None, *shas]),
            }
        )
    kinds = ["total_churn", "unique_contributors", "config_reference_count", "loc"]
    for i in range(n_evidence):
        evidence.append(
            {
                "evidence_id": f"e{r.randrange(n_evidence)}",
                "repo_id": r.choice(repos),
                "component_id": r.choice(comps),
                "snapshot": r.choice(shas),
                "evidence_type": r.choice(kinds),
                "value": r.choice([None, {"num": None, "str": "x", "kind": "s"}, {"num": float("nan"), "str": None, "kind": "f"}, *[{"num": 1.0, "str": None, "kind": "i"}] * 5]),
                "availability": r.choice(["AVAILABLE"] * 5 + ["UNKNOWN", None]),
                "as_of": r.choice([at(r.randrange(40)), at(r.random() * 40)]),
                "load_id": r.choice([1, 2, 3, 4, 9]),
            }
        )
    write(folder, "cases", cases + cases[:20])
    write(folder, "evidence", evidence + evidence[:40])
    return write(folder, "loads", [{"load_id": i, "loaded_at": at(10 * i - 9)} for i in (1, 2, 3, 4)])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("one_entity", [False, True])
def test_random_tables(spark, tmp_path, seed, one_entity):
    d = tables(tmp_path, seed, one_entity=one_entity)
    assert compare(spark, d, R.queries["p4_found"], R.sql["p4_found"]) == ""


@pytest.mark.parametrize("seed", range(3))
def test_hot_entities_in_pieces(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(asof, "HOT_ROWS", 10)
    d = tables(tmp_path, seed, one_entity=True)
    assert compare(spark, d, R.queries["p4_found"], R.sql["p4_found"]) == ""


def test_nan_is_a_value_and_wins(spark, tmp_path):
    shared = {"repo_id": "r/a", "component_id": "p.A", "snapshot": "1" * 40, "evidence_type": "total_churn", "availability": "AVAILABLE", "load_id": 1}
    nan, one = {"num": float("nan"), "str": None, "kind": "f"}, {"num": 1.0, "str": None, "kind": "i"}
    write(tmp_path, "evidence", [shared | {"evidence_id": "early", "value": one, "as_of": at(1)}, shared | {"evidence_id": "late", "value": nan, "as_of": at(2)}])
    write(tmp_path, "cases", [{"case_id": "c", "repo_id": "r/a", "target_component_id": "p.A", "as_of": at(9), "commit_sha": "2" * 40}])
    d = write(tmp_path, "loads", [{"load_id": 1, "loaded_at": at(3)}])
    assert [tuple(r) for r in R.queries["p4_found"](spark, d).collect()] == [("c", "total_churn", "late", 1)]


def test_empty_tables(spark, tmp_path):
    for empty in ("cases", "evidence", "loads"):
        d = tables(tmp_path, 1, 20, 40)
        write(tmp_path, empty, [])
        assert R.queries["p4_found"](spark, d).count() == 0


def test_nodes_cover_the_interval_exactly(spark):
    top = 6
    rows = spark.range(64).crossJoin(spark.range(1, 65).withColumnRenamed("id", "hi")).where("id < hi").selectExpr("id as lo", "hi", "0 as leaf")
    for r in rows.select("lo", "hi", asof.dyadic_nodes("lo", "hi", "leaf", top).alias("nodes")).collect():
        covered = []
        for node in r["nodes"]:
            level = top - (node.bit_length() - 1)
            first = (node << level) - (1 << top)
            covered += range(first, first + (1 << level))
        assert sorted(covered) == list(range(r["lo"], r["hi"]))
        assert len(r["nodes"]) <= 2 * top
