import random

import pytest

from loamline.operators.graph import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    r = random.Random(1)
    links = {
        "random": [(f"n{r.randrange(90):02}", f"n{r.randrange(90):02}") for _ in range(70)],
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)],
        "star": [("hub", f"n{i}") for i in range(50)] + [("zz", "n7")],
        "none": [],
    }[kind]
    rows = {(max(p), min(p)) for p in links if p[0] != p[1]}
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(list(rows), "u string, v string")).collect()}
    assert got == brute(rows)
