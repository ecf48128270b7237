"""Commit activity from a stream of commit files.

Commits arrive as Parquet files. Each is counted once although it may be delivered again, and days are counted per
repository; a watermark bounds the state by the delay up to which late commits are still taken.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loamline.operators import rolling
from loamline.plans.storage import cut


def commit_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def daily_counts(commits: DataFrame, late: str = "30 days") -> DataFrame:
    """(repo_id, window, n) of a stream: distinct commits per UTC day; later repeats and too late commits are dropped."""
    c = commits.where("repo_id is not null and sha is not null and ts is not null").select("repo_id", "sha", F.col("ts").cast("timestamp").alias("ts"))
    c = c.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo_id", "sha"])
    return c.groupBy("repo_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))


#: Buckets of the live trees; a batch writes those that it changes.
BUCKETS = 64
STATE = f"repo_id string, shard int, tree {rolling.TREE}"


class LiveTrees:
    """Segment trees of daily counts that each micro-batch corrects; see operators.rolling.

    folder, on storage that all executors share, has a version of a bucket for each batch that changed it. A batch reads
    the versions of earlier batches only and replaces its own, so one that is tried again, or comes again after a
    restart, counts once. The version before a bucket's newest is kept, older ones are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> dict[int, list[int]]:
        """bucket -> the batches that it has versions of; at most BUCKETS times a few."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bucket=*/batch=*")
        out: dict[int, list[int]] = {}
        for at in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []:
            bucket, batch = (int(x.partition("=")[2]) for x in str(at.getPath()).split("/")[-2:])
            out.setdefault(bucket, []).append(batch)
        return {b: sorted(v) for b, v in out.items()}

    def trees(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """(repo_id, shard, tree) as the newest batch left them, or the newest below `before`; only: of these buckets."""
        newest = {b: max((v for v in vs if before is None or v < before), default=None) for b, vs in self._versions().items() if only is None or b in only}
        paths = [f"{self.folder}/bucket={b}/batch={v}" for b, v in newest.items() if v is not None]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def take(self, batch: DataFrame, number: int) -> None:
        """Commits of a micro-batch that came once each."""
        days = cut(rolling.commits_per_day(batch), "days")
        bucket = F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in days.select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return
        new = rolling.correct_trees(self.trees(number, touched), days, "repo_id")
        new = new.select("*", bucket.alias("bucket"), F.lit(number).alias("batch")).repartition("bucket")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.folder)
        for b, versions in self._versions().items():
            for old in [v for v in versions if v < number][:-1] if b in touched else []:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bucket={b}/batch={old}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def follow(self, commits: DataFrame, checkpoint: str, late: str = "30 days") -> StreamingQuery:
        """Start correcting from a stream; repeats within the delay are dropped first."""
        once = commits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo_id", "sha"])
        return once.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
