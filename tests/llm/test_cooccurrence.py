import random
from collections import Counter
from itertools import combinations

import pytest

from loamline.llm import cooccurrence
from loamline.llm.cooccurrence import PairCounts
from loamline.llm.queries import R
from tests.compare import compare
from tests.small import at, write

SHAPE = "repo_id string, module string, basket string, items array<string>"


def dictionary(spark):
    rows = [(r, m, x) for r in "ab" for m in (None, "m") for x in "uvwxyz"]
    return cooccurrence.dictionary(spark.createDataFrame(rows, "repo_id string, module string, component_id string"))


def batch_of(spark, names, rows):
    """Baskets by name as baskets by number."""
    ids = {(n["repo_id"], n["module"], n["component_id"]): n for n in names.collect()}
    scope = {k[:2]: n["scope"] for k, n in ids.items()}
    out = [(scope[r, m], hash(b) % 99991, 7, None if x is None else sorted({ids[r, m, i]["id"] for i in x if i is not None})) for r, m, b, x in rows]
    return spark.createDataFrame(out, "scope bigint, b1 bigint, b2 bigint, ids array<bigint>")


def counted(baskets):
    pairs, items, totals = Counter(), Counter(), Counter()
    for (repo, module, _), content in baskets.items():
        members = sorted({x for x in content or [] if x is not None})
        if members:
            totals[repo, module] += 1
            items.update((repo, module, x) for x in members)
            pairs.update((repo, module, a, b) for a, b in combinations(members, 2))
    return pairs, items, totals


@pytest.mark.parametrize("small_buckets", [False, True])
def test_batches_add_up_to_a_recount(spark, monkeypatch, small_buckets):
    if small_buckets:
        monkeypatch.setattr(cooccurrence, "PAIRS_PER_BUCKET", 8)
        monkeypatch.setattr(cooccurrence, "BASKETS_PER_BUCKET", 4)
    r = random.Random(1)
    names = dictionary(spark)
    state, baskets, scores = PairCounts(), {}, None
    for size in (25, 25, 6):
        batch = {}
        for _ in range(size):
            key = (r.choice(["a", "b"]), r.choice([None, "m"]), f"s{r.randrange(30)}")
            batch[key] = r.choice([None, [], [r.choice([*"uvwxyz", None]) for _ in range(r.randrange(7))]])
        state = state.apply(batch_of(spark, names, [(*k, v) for k, v in batch.items()]))
        scores = state.scores() if scores is None else state.rescored(scores)
        baskets |= batch
        pairs, items, totals = counted(baskets)
        for s in (state.scores(), scores):
            got = {(x["repo_id"], x["module"], x["a"], x["b"]): x for x in cooccurrence.named(s, names).collect()}
            assert {k: x["n_ab"] for k, x in got.items()} == dict(pairs)
            for (repo, module, a, b), x in got.items():
                assert (x["n_a"], x["n_b"], x["n"]) == (items[repo, module, a], items[repo, module, b], totals[repo, module])
                assert x["lift"] == pytest.approx(x["n_ab"] * x["n"] / (x["n_a"] * x["n_b"]))
    assert (state.buckets[0] > 3) == small_buckets


def test_only_moved_pairs_are_scored_again(spark):
    names = dictionary(spark)
    first = [("a", "m", "1", ["x", "y"]), ("a", "m", "2", ["u", "v"]), ("b", None, "1", ["x", "y"])]
    state = PairCounts().apply(batch_of(spark, names, first))
    same_count = state.apply(batch_of(spark, names, [("a", "m", "1", ["x", "z"]), ("b", None, "1", ["y", "x"])]))
    pairs = lambda s: {(x["repo_id"], x["a"], x["b"]) for x in cooccurrence.named(s, names).collect()}
    assert pairs(same_count.scores(only_moved=True)) == {("a", "x", "z")} and len(pairs(same_count.scores())) == 3
    gone = same_count.apply(batch_of(spark, names, [("a", "m", "1", [])]))  # one basket less: all scores of the scope move
    assert pairs(gone.scores(only_moved=True)) == {("a", "u", "v")} and pairs(gone.scores()) == {("a", "u", "v"), ("b", "x", "y")}


def test_a_batch_touches_its_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "PAIRS_PER_BUCKET", 2)
    names = dictionary(spark)
    state = PairCounts().apply(batch_of(spark, names, [("a", "m", "1", [*"uvwxyz"])]))
    files = lambda s: set(s.pairs.inputFiles())
    then = state.apply(batch_of(spark, names, [("b", None, "1", ["x", "y"])]))
    assert len(files(state) & files(then)) >= len(files(state)) - 1 > 2


def test_found_on_dirty_touches(spark, tmp_path):
    r = random.Random(2)
    names = [f"p.C{i}" for i in range(8)]
    components = [{"repo_id": repo, "component_id": n, "module": r.choice([None, "m1"])} for repo in ("a/a", "b/b") for n in names]
    touches = []
    for i in range(300):
        touches.append(
            {
                "repo_id": r.choice(["a/a", "b/b", None]), "sha": f"s{r.randrange(70)}", "component_id": r.choice([*names, None, "p.Gone"]), "ts": at(r.randrange(400)),
                "is_bulk": r.choice([False, False, True, None]), "partners": r.choice([None, [], [r.choice([*names, None]) for _ in range(3)]]),
            }
        )
    write(tmp_path, "components", components + components[:4])
    d = write(tmp_path, "touches", touches + touches[:40])
    for q in ("p2_found", "p2_scores"):
        assert compare(spark, d, R.queries[q], R.sql[q]) == ""
    assert R.queries["p2_found"](spark, write(tmp_path, "touches", [])).count() == 0


def test_two_items_under_one_number_are_an_error(spark):
    names = dictionary(spark)
    cooccurrence.check_dictionary(names)
    with pytest.raises(ValueError, match="another seed"):
        cooccurrence.check_dictionary(names.withColumn("c", names["scope"]))
