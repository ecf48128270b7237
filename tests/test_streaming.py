from collections import Counter

from loamline.operators import rolling
from loamline.streaming.activity import LiveTrees, commit_stream, daily_counts
from tests.small import at, write


def stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        rows = [{"repo_id": "a/a", "sha": f"s{part}-{i}", "ts": at(70 * part + i % 3)} for i in range(7)]
        rows += rows[:2] + [{"repo_id": None, "sha": "x", "ts": at(1)}]
        (folder / str(part)).mkdir()
        write(folder / str(part), "commits", rows)
        (folder / str(part) / "commits.parquet").rename(folder / f"{part}.parquet")
        (folder / str(part)).rmdir()
    schema = spark.read.parquet(str(folder)).schema
    return commit_stream(spark, str(folder), schema, files=1)


def test_daily_counts(spark, tmp_path):
    q = daily_counts(stream(spark, tmp_path), "400 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = Counter({str(r["window"]["start"])[:10]: r["n"] for r in spark.table("days").collect()})
    assert sum(got.values()) == 21 and got["2024-01-01"] == 3


def plain(df):
    return {(r["repo_id"], r["shard"]): r["tree"] for r in df.collect()}


def test_trees_follow_the_stream_over_a_restart(spark, tmp_path):
    commits = stream(spark, tmp_path)
    held = (tmp_path / "in" / "2.parquet").rename(tmp_path / "2.parquet")
    LiveTrees(spark, str(tmp_path / "state")).follow(commits, str(tmp_path / "cp"), "400 days").awaitTermination()
    held.rename(tmp_path / "in" / "2.parquet")
    live = LiveTrees(spark, str(tmp_path / "state"))  # a new process knows nothing but the folder
    live.follow(commits, str(tmp_path / "cp"), "400 days").awaitTermination()
    whole = rolling.build_trees(rolling.commits_per_day(spark.read.parquet(str(tmp_path / "in"))), "repo_id")
    assert plain(live.trees()) == plain(whole) and len(plain(whole)) == 3


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    live = LiveTrees(spark, str(tmp_path / "state"))
    batch = lambda *shas: spark.createDataFrame([("a/a", s, at(3)) for s in shas] + [("b/b", "x", at(5))], "repo_id string, sha string, ts timestamp")
    live.take(batch("1", "2"), 0)
    live.take(batch("3"), 1)
    live.take(batch("3"), 1)
    assert {k[0]: v[1]["n"] for k, v in plain(live.trees()).items()} == {"a/a": 3, "b/b": 2}
    assert {k[0]: v[1]["n"] for k, v in plain(live.trees(before=1)).items()} == {"a/a": 2, "b/b": 1}
    for number in (2, 3):
        live.take(batch(f"n{number}").where("repo_id = 'a/a'"), number)
    versions = live._versions().values()
    assert sorted(len(v) for v in versions) == [2, 2] and max(max(v) for v in versions) == 3
