import datetime

from loamline.operators import config


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_evidence_at_the_parent_of_each_case(spark):
    touch = "repo_id string, component_id string, sha string, ts timestamp, author string, added int, deleted int, is_bulk boolean, removes_component boolean"
    touches = spark.createDataFrame(
        [
            ("r", "com.shop.Cart", "1", day(1), "a", 1, 0, False, False),
            ("r", "com.shop.Gone", "1", day(1), "a", 1, 0, False, False),
            ("r", "com.shop.Gone", "2", day(5), "a", 0, 1, False, True),
            ("r", "com.other.Cart", "4", day(30), "a", 1, 0, False, False),
        ],
        touch,
    )
    xml = '<b class="com.shop.Cart"/>\n<b class="com.shop.Gone" ref="cart"/>\n'
    tree = spark.createDataFrame(
        [("r", p, "src/main/resources/a.xml", "b1") for p in ("p1", "p2", "p3")] + [("r", "p2", "src/test/resources/t.properties", "b2"), ("r", "p2", "A.java", "b1")],
        "repo_id string, revision string, path string, blob string",
    )
    blobs = spark.createDataFrame([("r", "b1", xml), ("r", "b2", "x=com.shop.Cart")], "repo_id string, blob string, text string")
    cases = spark.createDataFrame(
        [("c1", "r", "p1", "com.shop.Gone", day(3)), ("c2", "r", "p2", "com.shop.Cart", day(9)), ("c3", "r", "p3", "com.shop.Cart", day(40)), ("c4", "r", None, "com.shop.Cart", day(3)), ("c5", "r", "p2", "com.none.X", day(9))],
        "case_id string, repo_id string, parent_sha string, target_component_id string, as_of timestamp",
    )
    rows = config.config_evidence_by_case(cases, tree, blobs, touches).collect()
    counts = {r["case_id"]: r["value"]["num"] for r in rows if r["evidence_type"] == "config_reference_count"}
    # c2: the class on line 1 and the bean on line 2; c3: another Cart has made the bean name ambiguous
    assert counts == {"c1": 1.0, "c2": 2.0, "c3": 1.0, "c5": 0.0}
    refs = {(r["case_id"], r["value"]["str"], r["provenance"]["files"][0]["path"], r["provenance"]["files"][0]["line"]) for r in rows if r["evidence_type"] == "config_reference"}
    a = "src/main/resources/a.xml"
    assert refs == {("c1", "RUNTIME", a, 2), ("c2", "RUNTIME", a, 1), ("c2", "RUNTIME", a, 2), ("c2", "TEST", "src/test/resources/t.properties", 1), ("c3", "RUNTIME", a, 1)}
    assert all(r["repo_id"] == "r" and r["snapshot"] in ("p1", "p2", "p3") for r in rows)
    assert len({(r["evidence_id"]) for r in rows}) == len(rows)
    assert config.config_evidence_by_case(cases.where("false"), tree, blobs, touches).count() == 0
