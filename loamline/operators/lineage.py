"""Attribution of file changes to components, following renames.

The log lists the newest change first. A rename is the end of one stretch of the log on each of its two paths, and the
beginning of one, on its old path: below it, older changes of the old path belong to whatever the new path stood for at
that place. A window over the renames that touch a path gives its stretches, and for each rename the one whose meaning
it hands on; chains of such renames are shortened by pointer doubling. No group of paths is gathered.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.paths import component_of_path
from loamline.operators.graph import ends
from loamline.plans.storage import cut


def ordered_changes(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with `seq`, their place in the log. A repeated commit counts at its first place; repeated files once."""
    place = commits.where("repo_id is not null and sha is not null").groupBy("repo_id", "sha").agg(F.min("log_ord").alias("log_ord"))
    files = changes.select("repo_id", "sha", "file_ord", "path", "old_path", "added", "deleted", "is_file_deletion").distinct()
    seq = F.struct("log_ord", "file_ord", "sha", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("old_path", F.lit("")).alias("old_path"))
    return files.join(place, ["repo_id", "sha"]).withColumn("seq", seq)


def live_paths(components: DataFrame) -> DataFrame:
    """(repo_id, path, component_id): a component's file; the first path wins for a component, the least id for a path."""
    first = components.groupBy("repo_id", "component_id").agg(F.min("file_path").alias("path")).where("path is not null")
    return first.groupBy("repo_id", "path").agg(F.min("component_id").alias("component_id"))


def stretches(ordered: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, path, begin, end, then) and (repo_id, path, leads).

    Below `begin` and down to `end` (null: to the log's last change) the path stands for `then`. leads is where a path
    that no file has any more leads in general: along the newest rename of each path, until one is the file of a known
    component, is never renamed, or was met before.
    """
    r = cut(ordered.where("old_path is not null and path is not null and path <> old_path").select("repo_id", "seq", "path", "old_path"), "renames")
    newest = r.groupBy("repo_id", F.col("old_path").alias("path")).agg(F.min_by("path", "seq").alias("_to")).join(live, ["repo_id", "path"], "left_anti")
    leads = ends(newest.select(F.struct("repo_id", "path").alias("node"), F.struct("repo_id", F.col("_to").alias("path")).alias("to")))
    leads = leads.select("node.repo_id", "node.path", F.col("end.path").alias("leads"))

    side = lambda path, begins: F.struct(F.col(path).alias("path"), F.lit(begins).alias("begins"))
    marks = r.select("repo_id", "seq", F.explode(F.array(side("old_path", True), side("path", False))).alias("_m")).select("repo_id", "seq", "_m.*")
    w = Window.partitionBy("repo_id", "path").orderBy("seq")
    marks = marks.withColumns({"_above": F.when(F.lag("begins").over(w), F.lag("seq").over(w)), "_next": F.lead("seq").over(w)})
    marks = cut(marks, "marks")
    # a rename hands on what the stretch of its new path means that it ends, if there is one
    above = marks.where("not begins and _above is not null").select(F.struct("repo_id", "seq").alias("node"), F.struct("repo_id", F.col("_above").alias("seq")).alias("to"))
    first = ends(above).select("node.repo_id", "node.seq", F.col("end.seq").alias("_first"))
    means = r.select("repo_id", "seq").join(first, ["repo_id", "seq"], "left").select("repo_id", "seq", F.coalesce("_first", "seq").alias("_first"))
    means = means.join(r.select("repo_id", F.col("seq").alias("_first"), "path"), ["repo_id", "_first"]).join(leads, ["repo_id", "path"], "left")
    means = means.select("repo_id", "seq", F.coalesce("leads", "path").alias("then"))
    begun = marks.where("begins").select("repo_id", "path", "seq", F.col("_next").alias("end"))
    return begun.join(means, ["repo_id", "seq"]).withColumnRenamed("seq", "begin"), leads


def attribute_changes(commits: DataFrame, changes: DataFrame, components: DataFrame) -> DataFrame:
    """File changes with `final_path` and `component_id`; changes that belong to no component are left out.

    A path is looked up in the stretches first, then among the files of known components, then along all renames. The
    component is the one whose file it is, else the type that the path itself names. Rows without commit don't count.
    """
    ordered = ordered_changes(commits, changes)
    live = live_paths(components)
    begun, leads = stretches(ordered, live)
    begun = cut(begun, "stretches")
    c, s = ordered.alias("c"), begun.alias("s")
    on = [F.col("c.repo_id") == F.col("s.repo_id"), F.col("c.path") == F.col("s.path"), F.col("seq") > F.col("begin"), F.col("end").isNull() | (F.col("seq") <= F.col("end"))]
    found = c.join(s, on, "left").select("c.*", "then")
    found = found.join(live.select("repo_id", "path", F.lit(True).alias("_live")), ["repo_id", "path"], "left").join(leads, ["repo_id", "path"], "left")
    found = found.withColumn("final_path", F.coalesce("then", F.when(F.col("_live"), F.col("path")), "leads", "path")).drop("then", "_live", "leads")
    owner = live.withColumnRenamed("path", "final_path")
    found = found.join(owner, ["repo_id", "final_path"], "left")
    return found.withColumn("component_id", F.coalesce("component_id", component_of_path("final_path"))).where("component_id is not null")


def build_touches(attributed: DataFrame, commits: DataFrame, changes: DataFrame, bulk_above: int = 30) -> DataFrame:
    """One row per commit and component: lines, paths, whether the component goes, and who else changed.

    A commit is bulk if it changes more than `bulk_above` files of any kind; bulk commits have no partners. Null line
    counts are 0. A component goes if all its changes in the commit are deletions.
    """
    per = attributed.groupBy("repo_id", "sha", "component_id").agg(
        F.sum(F.coalesce("added", F.lit(0))).alias("added"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted"),
        F.array_sort(F.collect_set("path")).alias("paths"),
        F.bool_and(F.coalesce("is_file_deletion", F.lit(False)) & F.col("old_path").isNull()).alias("removes_component"),
    )
    size = changes.select("repo_id", "sha", "file_ord", "path").distinct().groupBy("repo_id", "sha").agg((F.count(F.lit(1)) > bulk_above).alias("is_bulk"))
    heads = commits.groupBy("repo_id", "sha").agg(F.min(F.struct("log_ord", "ts", F.lower(F.trim("author")).alias("author"))).alias("_h"))
    flagged = per.join(size, ["repo_id", "sha"]).join(heads.select("repo_id", "sha", "_h.ts", "_h.author"), ["repo_id", "sha"])
    members = flagged.where("not is_bulk").groupBy("repo_id", "sha").agg(F.array_sort(F.collect_set("component_id")).alias("_members"))  # bulk_above at most
    out = flagged.join(members, ["repo_id", "sha"], "left")
    partners = F.coalesce(F.array_remove("_members", F.col("component_id")), F.array().cast("array<string>"))
    return out.select("repo_id", "component_id", "sha", "ts", "author", "added", "deleted", "paths", "is_bulk", "removes_component", partners.alias("partners"))


def first_duplicate(commits: DataFrame, prints: DataFrame) -> DataFrame:
    """(repo_id, sha, patch_id, duplicate): commits whose patch an older commit of the log already brought.

    prints (repo_id, sha, patch_id); a null patch_id is no patch and never a duplicate.
    """
    place = commits.groupBy("repo_id", "sha").agg(F.min("log_ord").alias("log_ord"))
    p = prints.where("patch_id is not null").select("repo_id", "sha", "patch_id").distinct().join(place, ["repo_id", "sha"])
    oldest = p.groupBy("repo_id", "patch_id").agg(F.max(F.struct("log_ord", "sha")).alias("_o"))
    return p.join(oldest, ["repo_id", "patch_id"]).select("repo_id", "sha", "patch_id", (F.struct("log_ord", "sha") != F.col("_o")).alias("duplicate"))


def patch_prints(changes: DataFrame) -> DataFrame:
    """(repo_id, sha, patch_id): a fingerprint of each commit's paths and line counts, for logs without patch ids."""
    line = F.concat_ws(":", "path", F.coalesce(F.col("added").cast("string"), F.lit("-")), F.coalesce(F.col("deleted").cast("string"), F.lit("-")))
    files = changes.select("repo_id", "sha", "file_ord", line.alias("_l")).distinct()
    return files.groupBy("repo_id", "sha").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_l")), "\n"), 256).alias("patch_id"))


def contiguous_ranges(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, first, last): runs of neighbouring line numbers, repeats once; nulls don't count."""
    d = lines.where(F.col(line).isNotNull()).select(*keys, line).distinct()
    island = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return d.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("_i")


def first_paths(attributed: DataFrame) -> DataFrame:
    """(repo_id, sha, component_id, parent_path): where a commit found the component: the old path of its first change, else the path."""
    first = F.min_by(F.coalesce("old_path", "path"), "file_ord")
    return attributed.groupBy("repo_id", "sha", "component_id").agg(first.alias("parent_path"))
