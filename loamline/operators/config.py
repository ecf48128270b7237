"""References to components in configuration files."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.paths import SERVICES_DIR, config_category, reference_kind
from loamline.functions.text import BEAN_REFERENCE, CLASS_NAME, CONTEXT_CHARS, LINE_END, bean_name, package_of, strip_comments
from loamline.operators import evidence
from loamline.operators.history import clean_touches, running_before


def classify(files: DataFrame) -> DataFrame:
    """Files (…, path) that are configuration, with `category`."""
    return files.withColumn("category", config_category("path")).where("category is not null")


def tokens(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, line, position, kind, token, context): names in the text of files, comments left out.

    A file is scanned once per distinct keys, path and text. line is null for an interface that a file name names.
    Null texts have no lines.
    """
    f = files.select(*keys, "path", "text").distinct()
    line = f.select(*keys, "path", F.posexplode(F.split(strip_comments("path", "text"), LINE_END)).alias("_n", "_line"))
    names = F.transform(F.regexp_extract_all("_line", F.lit(CLASS_NAME), F.lit(1)), lambda x: F.struct(reference_kind("path").alias("kind"), x.alias("token")))
    beans = F.transform(F.regexp_extract_all("_line", F.lit(BEAN_REFERENCE), F.lit(1)), lambda x: F.struct(F.lit("BEAN_REFERENCE").alias("kind"), x.alias("token")))
    none = F.expr("cast(array() as array<struct<kind string, token string>>)")
    found = F.concat(names, F.when(F.col("path").endswith(".xml"), beans).otherwise(none))
    inside = line.select(*keys, "path", (F.col("_n") + 1).alias("line"), F.substr(F.trim("_line"), F.lit(1), F.lit(CONTEXT_CHARS)).alias("context"), F.posexplode(found).alias("position", "_t"))
    inside = inside.select(*keys, "path", "line", "position", "_t.kind", "_t.token", "context")
    name = F.regexp_extract("path", "[^/]*$", 0)
    services = F.col("path").startswith(SERVICES_DIR) | F.col("path").contains("/" + SERVICES_DIR)
    whole = F.regexp_extract(name, CLASS_NAME, 1)
    named = f.where(services & (whole == name) & (name != "")).select(
        *keys, "path", F.lit(None).cast("int").alias("line"), F.lit(-1).alias("position"), F.lit("SERVICE_INTERFACE").alias("kind"), name.alias("token"), F.col("path").alias("context")
    )
    return inside.unionByName(named)


def resolve(found: DataFrame, components: DataFrame, scope: list[str], known: DataFrame | None = None) -> DataFrame:
    """Tokens with `resolution` and `component_id`.

    A class name is tried as it stands (up to a `$`), then without its last capitalised segments; the longest that is
    a component wins. A bean reference names the only component with that default bean name. Names in a package that
    is or was one of ours, or below one, are UNRESOLVED, all others EXTERNAL. components (scope, component_id) is what exists,
    known what ever existed, with all columns of scope or some; a name without package never resolves.
    """
    have = components.select(*scope, "component_id").where("component_id is not null").distinct()
    parts = F.split(F.substring_index("token", "$", 1), r"\.")
    prefixes = F.filter(F.sequence(F.size("_p"), F.lit(1), F.lit(-1)), lambda n: n > 1)
    names = found.where("kind <> 'BEAN_REFERENCE'").select(*scope, "token").distinct().withColumn("_p", parts)
    tries = names.select(*scope, "token", "_p", F.explode(prefixes).alias("_n")).where(F.forall(F.slice("_p", F.col("_n"), F.size("_p") - F.col("_n") + 1), lambda x: x.rlike(r"^\p{Lu}")))
    tries = tries.withColumn("component_id", F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "."))
    best = tries.join(have, [*scope, "component_id"]).groupBy(*scope, "token").agg(F.max_by("component_id", "_n").alias("_class"))
    simple = F.regexp_extract("component_id", r"[^.]*$", 0)
    beans = have.groupBy(*scope, bean_name(simple).alias("token")).agg(F.count(F.lit(1)).alias("_n"), F.min("component_id").alias("_bean")).where("_n = 1").drop("_n")
    packages_of = lambda df, by: df.select(*by, package_of("component_id").alias("package")).where("package <> ''").distinct()
    seg = F.split("_package", r"\.")
    above = names.select(*scope, "token", package_of("token").alias("_package"))
    above = above.select(*scope, "token", F.explode(F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, F.lit(1), n), "."))).alias("package"))
    ours = above.join(packages_of(have, scope), [*scope, "package"], "left_semi").select(*scope, "token")
    if known is not None:
        by = [c for c in scope if c in known.columns]
        ours = ours.unionByName(above.join(packages_of(known, by), [*by, "package"], "left_semi").select(*scope, "token"))
    ours = ours.distinct().withColumn("_ours", F.lit(True))
    bean = F.col("kind") == "BEAN_REFERENCE"
    out = found.join(best, [*scope, "token"], "left").join(beans, [*scope, "token"], "left").join(ours, [*scope, "token"], "left")
    component = F.when(bean, F.col("_bean")).otherwise(F.col("_class"))
    state = F.when(component.isNotNull(), "RESOLVED").when(~bean & F.col("_ours"), "UNRESOLVED").otherwise("EXTERNAL")
    return out.withColumns({"component_id": component, "resolution": state}).drop("_class", "_bean", "_ours")


def references(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, path, line, token, kind), the first on its line."""
    same = [*keys, "path", "line", "token", "kind"]
    rest = [c for c in found.columns if c not in same]
    return found.groupBy(*same).agg(F.min_by(F.struct(*rest), "position").alias("_r")).select(*same, *[f"_r.{c}" for c in rest])


#: Fixed value: shorter names say too little.
NAME_CHARS = 4


def misses(files: DataFrame, components: DataFrame, refs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path, line, component_id, name): lines that hold a component's simple or default bean name as a word, but no resolved reference to it.

    Comments are left out. Several names of a component on a line count once, the least is shown.
    """
    simple = F.regexp_extract("component_id", r"[^.]*$", 0)
    c = components.select(*scope, "component_id", simple.alias("_s")).where(F.length("_s") >= NAME_CHARS).distinct()
    names = c.select(*scope, "component_id", F.explode(F.array_distinct(F.array(F.col("_s"), bean_name("_s")))).alias("name"))
    lines = files.select(*scope, "path", F.posexplode(F.split(strip_comments("path", "text"), LINE_END)).alias("_n", "_line"))
    words = lines.select(*scope, "path", (F.col("_n") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("_line", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    hits = words.join(names, [*scope, "name"]).groupBy(*scope, "path", "line", "component_id").agg(F.min("name").alias("name"))
    return hits.join(refs.where("resolution = 'RESOLVED'"), [*scope, "path", "line", "component_id"], "left_anti")


def scan_counts(files: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, what, name, n): files by category, references by resolution, resolved references by category."""
    parts = (
        files.groupBy(*keys, F.lit("files_scanned").alias("what"), F.col("category").alias("name")),
        refs.groupBy(*keys, F.lit("references").alias("what"), F.col("resolution").alias("name")),
        refs.where("resolution = 'RESOLVED'").groupBy(*keys, F.lit("resolved_by_category").alias("what"), F.col("category").alias("name")),
    )
    a, b, c = (p.agg(F.count(F.lit(1)).alias("n")) for p in parts)
    return a.unionByName(b).unionByName(c)


def config_evidence(refs: DataFrame, scope: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """config_reference rows, one per component, path and line, and a config_reference_count row for every component.

    refs: repo_id, path, line, position, category, kind, context, resolution, component_id. scope: repo_id,
    component_id, snapshot. The count is of distinct RUNTIME places; none is a measured 0.
    """
    keys = ["repo_id", "component_id"]
    r = refs.where("resolution = 'RESOLVED'")
    first = r.groupBy(*keys, "path", "line").agg(F.min_by(F.struct("category", "kind", "context"), F.struct("position", "kind")).alias("_r"))
    base = scope.select(*keys, "snapshot").distinct().join(cutoffs.withColumn("as_of", F.timestamp_micros("as_of")), "repo_id")
    place = lambda p, n: F.array(F.struct(F.col(p).alias("path"), F.col(n).cast("int").alias("line")))
    none = lambda t: F.lit(None).cast(t)
    one = base.join(first, keys).select(
        "*",
        F.lit("config_reference").alias("evidence_type"),
        F.struct(none("double").alias("num"), F.col("_r.category").alias("str"), F.lit("str").alias("kind")).alias("value"),
        none("string").alias("unit"),
        place("path", "line").alias("_files"),
        F.concat("_r.kind", F.lit(": "), "_r.context").alias("_note"),
    )
    spots = first.where("_r.category = 'RUNTIME'").select(*keys, "path", F.coalesce("line", F.lit(0)).alias("line")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("path", "line"))
    few = spots.withColumn("_rank", rank).where(F.col("_rank") <= evidence.LISTED_FILES)
    files = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "path", F.nullif(F.col("line"), F.lit(0)).alias("line")))), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line")))
    n = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(few.groupBy(*keys).agg(files.alias("_files")), keys)
    no_files = F.expr("cast(array() as array<struct<path string, line int>>)")
    count = base.join(n, keys, "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_files": F.coalesce("_files", no_files)}).select(
        "*",
        F.lit("config_reference_count").alias("evidence_type"),
        F.struct(F.col("_n").cast("double").alias("num"), none("string").alias("str"), F.lit("int").alias("kind")).alias("value"),
        F.lit("references").alias("unit"),
        F.concat(F.col("_n").cast("string"), F.lit(" RUNTIME configuration references")).alias("_note"),
    )
    shape = [*keys, "snapshot", "as_of", "evidence_type", "value", "unit", "_files", "_note"]
    d = one.select(*shape).unionByName(count.select(*shape))
    texts = F.expr("cast(array() as array<string>)")
    d = d.select(
        F.lit(evidence.SCHEMA_VERSION).alias("schema_version"), "repo_id", "snapshot", "component_id", F.lit("CONFIG").alias("source"), "evidence_type", "value", "unit",
        F.lit("AVAILABLE").alias("availability"), "as_of", none("struct<start_ts: timestamp, end_ts: timestamp>").alias("time_window"),
        F.struct(texts.alias("commits"), F.col("_files").alias("files"), texts.alias("trace_ids"), F.col("_note").alias("note")).alias("provenance"),
        F.lit(evidence.CONFIG_METHOD).alias("extraction_method"),
    )
    return evidence.with_ids(d)


def config_evidence_by_case(cases: DataFrame, tree: DataFrame, blobs: DataFrame, touches: DataFrame) -> DataFrame:
    """Configuration evidence for each case as of its parent commit: (case_id, evidence_type, value, …).

    tree (repo_id, revision, path, blob), blobs (repo_id, blob, text). Every distinct file content is scanned once,
    whatever the number of revisions that hold it. A revision's references resolve to the components that were alive
    just before the earliest of its cases; packages of components that ever existed count as ours. Only components that a
    revision's files could mean are looked up, each as of that moment. Cases without parent have no evidence.
    """
    asked = cases.where("parent_sha is not null").groupBy("repo_id", F.col("parent_sha").alias("revision")).agg(F.min(F.unix_micros(F.col("as_of").cast("timestamp"))).alias("_t"))
    files = classify(tree.join(asked, ["repo_id", "revision"])).select("repo_id", "revision", "path", "blob", "category", "_t")
    texts = files.select("repo_id", "path", "blob").distinct().join(blobs, ["repo_id", "blob"])
    found = tokens(texts, ["repo_id", "blob"])
    at = found.join(files, ["repo_id", "blob", "path"]).drop("blob")

    t = clean_touches(touches)
    ever = t.select("repo_id", "component_id").distinct()
    parts = F.split(F.substring_index("token", "$", 1), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    revision = ["repo_id", "revision", "_t"]
    meant = at.where("kind <> 'BEAN_REFERENCE'").select(*revision, F.explode(ends).alias("component_id"))
    meant = meant.distinct().join(ever, ["repo_id", "component_id"], "left_semi")
    beans = at.where("kind = 'BEAN_REFERENCE'").select(*revision, F.col("token").alias("_bean")).distinct()
    # all components of a bean name, as only one alive of them makes it unambiguous
    named = ever.withColumn("_bean", bean_name(F.regexp_extract("component_id", r"[^.]*$", 0))).join(beans, ["repo_id", "_bean"]).select(*revision, "component_id")
    asks = meant.unionByName(named.select(meant.columns)).distinct()
    # what each of them was just before its revision's cutoff: a question and the touches before it lie on one time line
    last = F.struct("t", "sha", "removes_component")
    line = t.select("repo_id", "component_id", "t", last.alias("last"), F.lit(None).cast("string").alias("revision"))
    line = line.unionByName(asks.select("repo_id", "component_id", F.col("_t").alias("t"), F.lit(None).cast(line.schema["last"].dataType).alias("last"), "revision"))
    alive = running_before(line, ["repo_id", "component_id"], "t", [], ["last"]).where("revision is not null and not before_last.removes_component")
    alive = alive.select("repo_id", "revision", "component_id")
    refs = references(resolve(at, alive, ["repo_id", "revision"], ever), ["repo_id", "revision"]).where("resolution = 'RESOLVED'")

    target = cases.select("case_id", "repo_id", F.col("parent_sha").alias("revision"), F.col("target_component_id").alias("component_id"), "as_of").where("revision is not null")
    # a case stands where a component stands in a snapshot: its id takes the repository's place
    r = refs.join(target, ["repo_id", "revision", "component_id"]).drop("repo_id", "as_of").withColumnRenamed("case_id", "repo_id")
    scope = target.select(F.col("case_id").alias("repo_id"), "component_id", F.col("revision").alias("snapshot"))
    cutoffs = target.select(F.col("case_id").alias("repo_id"), F.unix_micros(F.col("as_of").cast("timestamp")).alias("as_of")).distinct()
    e = config_evidence(r, scope, cutoffs).withColumnRenamed("repo_id", "case_id")
    repo = target.select("case_id", "repo_id").distinct()
    return evidence.with_ids(e.drop("evidence_id").join(repo, "case_id"))
