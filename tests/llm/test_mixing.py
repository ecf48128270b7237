import random

import pytest
from pyspark.sql import functions as F

from loamline.llm import mixing

DOCS = "doc_id bigint, source string, tokens bigint, h bigint"
TARGETS = "source string, target_share double, max_repeats int"


def docs(seed, sizes, big=400):
    r = random.Random(seed)
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i, s, r.randrange(0, big), r.getrandbits(63)))
            i += 1
    return out


def brute(rows, targets):
    have = {s: [(h, n, i) for i, q, n, h in rows if q == s and n > 0] for s, _, _ in targets}
    total = min(m * sum(n for _, n, _ in have[s]) / p for s, p, m in targets if p > 0)
    out = {}
    for s, p, m in targets:
        tokens = sum(n for _, n, _ in have[s])
        if not p or not tokens:
            continue
        budget = min(int(p * total), m * tokens)
        passes = min(budget // tokens, m)
        left, open_ = budget - passes * tokens, True
        for _, n, i in sorted(have[s]):
            open_ = open_ and n <= left
            left -= n if open_ else 0
            if passes + open_:
                out[i] = passes + open_
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_taking_documents_in_order_of_hash(spark, seed):
    rows = docs(seed, {"a": 300, "b": 40, "c": 7, "unlisted": 50, None: 9})
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.0, 2)]
    df = spark.createDataFrame(rows, DOCS).where("source is not null")
    t = spark.createDataFrame(targets, TARGETS)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, t).collect()}
    assert got == brute([x for x in rows if x[1]], targets)


def test_shares_and_caps(spark):
    rows = docs(1, {"a": 3000, "b": 900})
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], TARGETS)
    chosen = mixing.mix(spark.createDataFrame(rows, DOCS), targets)
    for r in mixing.shares(chosen, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.002 and r["most_copies"] <= {"a": 1, "b": 3}[r["source"]]


def test_a_listed_source_without_tokens_leaves_nothing(spark):
    df = spark.createDataFrame(docs(1, {"a": 10}), DOCS)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 9)], TARGETS)
    chosen = mixing.mix(df, t)
    assert chosen.count() == 0
    assert {(r["source"], r["actual_share"]) for r in mixing.shares(chosen, t).collect()} == {("a", 0.0), ("b", 0.0)}


def test_equal_hashes_go_together(spark):
    rows = [(i, "a", 10, 5 if i < 8 else 100 + i) for i in range(20)] + [(99, "b", 70, 3)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    got = {r["doc_id"] for r in mixing.mix(spark.createDataFrame(rows, DOCS), t).where("source = 'a'").collect()}
    assert got == set()  # the eight of equal hash need 80 of 70 tokens
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], TARGETS)
    got = {r["doc_id"] for r in mixing.mix(spark.createDataFrame(rows, DOCS), t).where("source = 'a'").collect()}
    assert got == set(range(10))


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(spark.createDataFrame([], DOCS), t).count() == 0
    one = spark.createDataFrame(docs(1, {"a": 5}), DOCS)
    assert mixing.mix(one, t.where("false")).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    sized = mixing.sized(spark.read.parquet(f"{d}/documents.parquet"))
    targets = spark.read.parquet(f"{d}/mix_targets.parquet")
    rows = [tuple(r) for r in sized.collect()]
    want = brute(rows, [tuple(r) for r in targets.collect()])
    chosen = mixing.mix(sized, targets)
    assert {r["doc_id"]: r["copies"] for r in chosen.collect()} == want
    worst = mixing.shares(chosen, targets).agg(F.max(F.abs(F.col("actual_share") - F.col("target_share")))).first()[0]
    assert worst < 0.03
