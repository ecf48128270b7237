"""Tables from what git prints about repositories, kept as files in the shared folder.

Whoever has the repositories writes one file for each repository and listing, named `owner__name.listing`; any number of
machines may do so. Spark then reads all of them at once, long logs in pieces:

| listing | command |
|-|-|
| log | git log REV --full-history --no-merges -M -z --numstat --format=%x1e%H%x1f%ct%x1f%ae%x1f%P%x1f%s -- '*.java' |
| gone | git log REV --full-history --no-merges -M -z --diff-filter=D --name-only --format=%x1e%H -- '*.java' |
| tree | git ls-tree -r -z REV |
| patches | git log -p REV --no-merges --full-history -- '*.java' \\| git patch-id --stable |
| diffs | for each fix and path: printf '\\x1eFIX\\x1fPATH\\n', then git diff -w -U0 -M FIX^ FIX -- PATH |
| blames | for each fix and path: printf '\\x1eFIX\\x1fPATH\\n', then git blame --porcelain -w FIX^ -- PATH |

Null or empty fields are null; a repository without a listing has no rows. Files elsewhere in the folder aren't read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions.text import faulty_lines, numstat_count
from loamline.plans.storage import cut

#: What git puts between records, fields and, with -z, names.
RECORD, FIELD, NUL = "\x1e", r"\x1f", r"\x00"


def _listing(spark: SparkSession, folder: str, listing: str, sep: str) -> DataFrame:
    """(repo_id, value, block): the parts of all files of a listing between separators, as far as they hold anything."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.\w+$", 1)
    d = spark.read.option("lineSep", sep).option("pathGlobFilter", f"*.{listing}").text(folder)
    return d.where("value <> ''").select(F.replace(name, F.lit("__"), F.lit("/")).alias("repo_id"), "value", F.col("_metadata.file_block_start").alias("block"))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _changes(parts: Column) -> Column:
    """The changes among a log record's NUL-separated parts: `added TAB deleted TAB path`, where an empty path says that old and new path follow."""
    entry, renaming = r"^\n?(\d+|-)\t(\d+|-)\t", r"^\n?(\d+|-)\t(\d+|-)\t$"
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))

    def one(x: Column, i: Column) -> Column:
        name_of_rename = at(i - 1).rlike(renaming) | at(i - 2).rlike(renaming)
        renamed = x.rlike(renaming)
        return F.when(
            x.rlike(entry) & ~name_of_rename,
            F.struct(
                numstat_count(F.regexp_extract(x, entry, 1)).alias("added"),
                numstat_count(F.regexp_extract(x, entry, 2)).alias("deleted"),
                F.when(renamed, at(i + 2)).otherwise(F.regexp_replace(x, entry, "")).alias("path"),
                F.when(renamed, at(i + 1)).alias("old_path"),
            ),
        )

    return F.array_compact(F.transform(parts, one))


def log_records(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, sha, parent, ts, author, subject, log_ord, changes): a written table with a row per commit of each log.

    log_ord counts from 0, the newest commit first: rows are counted by block of their file, and what earlier blocks hold
    is added.
    """
    d = _listing(spark, folder, "log", RECORD).withColumn("parts", F.split("value", NUL)).withColumn("_at", F.monotonically_increasing_id())
    head = F.split(F.get("parts", F.lit(0)), FIELD, 5)
    field = lambda i: F.trim(F.regexp_replace(F.get(head, F.lit(i)), r"^\n|\n$", ""))
    d = d.select(
        "repo_id",
        field(0).alias("sha"),
        _some(F.split(field(3), " ")[0]).alias("parent"),
        F.timestamp_seconds(field(1).cast("bigint")).alias("ts"),
        F.lower(field(2)).alias("author"),
        field(4).alias("subject"),
        _changes(F.col("parts")).alias("changes"),
        "block",
        "_at",
    )
    d = cut(d, "log")
    blocks = d.groupBy("repo_id", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy("repo_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row per block
    blocks = blocks.withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_n")
    d = d.join(blocks, ["repo_id", "block"]).withColumn("log_ord", F.col("_before") + F.col("_at") - F.col("_first"))
    return cut(d.select("repo_id", "sha", "parent", "ts", "author", "subject", "log_ord", "changes"), "log")


def commits(log: DataFrame) -> DataFrame:
    return log.drop("changes")


def file_changes(log: DataFrame, gone: DataFrame) -> DataFrame:
    """(repo_id, sha, file_ord, path, old_path, added, deleted, is_file_deletion); gone as read by deletions(). A rename deletes no file."""
    f = log.select("repo_id", "sha", F.posexplode("changes").alias("file_ord", "_c")).select("repo_id", "sha", "file_ord", "_c.path", "_c.old_path", "_c.added", "_c.deleted")
    f = f.join(gone.withColumn("_gone", F.lit(True)), ["repo_id", "sha", "path"], "left")
    dead = F.coalesce("_gone", F.lit(False)) & F.col("old_path").isNull()
    return f.select("repo_id", "sha", "file_ord", "path", "old_path", "added", "deleted", dead.alias("is_file_deletion"))


def deletions(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, sha, path): files that commits delete."""
    names = F.transform(F.split("value", NUL), lambda x: F.regexp_replace(x, r"^\n+|\n+$", ""))
    d = _listing(spark, folder, "gone", RECORD).select("repo_id", names.alias("_n"))
    return d.select("repo_id", F.get("_n", F.lit(0)).alias("sha"), F.explode(F.slice("_n", F.lit(2), F.size("_n"))).alias("path")).where("path <> ''").distinct()


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, path, blob): the files of the listed revision."""
    d = _listing(spark, folder, "tree", "\0")
    part = lambda i: F.regexp_extract("value", r"^\d+ \w+ ([0-9a-f]+)\t([\s\S]*)$", i)
    return d.select("repo_id", part(2).alias("path"), part(1).alias("blob")).where("blob <> ''")


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, sha, patch_id)."""
    p = F.split("value", " ")
    return _listing(spark, folder, "patches", "\n").select("repo_id", p[1].alias("sha"), p[0].alias("patch_id"))


def _requests(spark: SparkSession, folder: str, listing: str) -> DataFrame:
    """(repo_id, fix_sha, path, body) of listings that answer one request after another."""
    d = _listing(spark, folder, listing, RECORD)
    part = lambda i: F.regexp_extract("value", r"^([^\x1f]*)\x1f([^\n]*)\n?([\s\S]*)$", i)
    return d.select("repo_id", part(1).alias("fix_sha"), part(2).alias("path"), part(3).alias("body"))


def fix_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, fix_sha, path, line): the lines of the parent that fixes take away."""
    return _requests(spark, folder, "diffs").select("repo_id", "fix_sha", "path", F.explode(faulty_lines("body")).alias("line"))


def blamed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, fix_sha, path, line, sha): the commit that each line of the parent comes from."""
    pattern = r"(?m)^([0-9a-f]{40}) \d+ (\d+)"
    pair = F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("sha"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("line"))
    d = _requests(spark, folder, "blames").select("repo_id", "fix_sha", "path", F.explode(pair).alias("_p"))
    return d.select("repo_id", "fix_sha", "path", F.col("_p.line").cast("int").alias("line"), "_p.sha")


def working_files(spark: SparkSession, folder: str, pattern: str = "*.java") -> DataFrame:
    """(repo_id, path, text): files below folder/owner__name, each read whole."""
    root = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+__[^/]+)/(.*)$", 1)
    below = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+__[^/]+)/(.*)$", 2)
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return d.select(F.replace(root, F.lit("__"), F.lit("/")).alias("repo_id"), F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))
