"""Column-level quality profile: declared constraints, one shared aggregate scan, mergeable states per load.

A suite names the columns to profile and the constraints on them as SQL conditions that hold for a *broken* row. It is
compiled into one aggregation over the partition key: rows, nulls, range, moments, a distinct sketch and broken rows
per column, all in one pass. The resulting states merge, so a new load adds its own states and touches no old ones.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.plans.storage import cut


@dataclass(frozen=True)
class Check:
    """field: the column it is reported under; broken: SQL condition, where null counts as kept."""

    field: str
    broken: str


@dataclass(frozen=True)
class Suite:
    partition: str
    columns: dict[str, str]  # name -> SQL expression of an orderable value
    checks: tuple[Check, ...]
    unordered: frozenset[str] = frozenset()  # names of columns that have no range

    def broken(self, field: str) -> Column:
        conditions = [F.coalesce(F.expr(c.broken), F.lit(False)) for c in self.checks if c.field == field]
        out = F.lit(False)
        for c in conditions:
            out = out | c
        return out

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(c.field for c in self.checks))


#: What a state holds besides n: columns and their types; all but sketch are sums, low and low_num least, high and high_num greatest values.
STATE = {
    "nulls": "bigint", "low": "string", "high": "string", "low_num": "double", "high_num": "double", "finite": "bigint", "total": "double", "squares": "double",
    "sketch": "binary", "broken": "bigint",
}


def states(df: DataFrame, suite: Suite) -> DataFrame:
    """(partition, field, n, *STATE), from a single scan of df.

    Numbers have their range in low_num and high_num and the count, sum and sum of squares of the finite ones in finite,
    total and squares; all others have a range in low and high, as texts (times so that they compare as texts). Ranges
    and the sketch leave nulls out, ranges NaN too. A null partition is a partition of its own.
    """
    parts: list[Column] = [F.count(F.lit(1)).alias("n")]
    names = list(dict.fromkeys([*suite.columns, *suite.fields]))
    for i, name in enumerate(names):
        if name in suite.columns:
            v = F.expr(suite.columns[name])
            of = df.select(v.alias("v")).schema["v"].dataType
            number = isinstance(of, T.NumericType)
            ranged = F.when(~F.isnan(v), v) if isinstance(of, (T.FloatType, T.DoubleType)) else v
            tail, kind = ("_num", "double") if number else ("", "string")
            parts += [
                F.count(F.when(v.isNull(), 1)).alias(f"nulls{i}"),
                *([] if name in suite.unordered else [F.min(ranged.cast(kind)).alias(f"low{tail}{i}"), F.max(ranged.cast(kind)).alias(f"high{tail}{i}")]),
                F.hll_sketch_agg(F.coalesce(v.cast("string"), F.lit(None).cast("string"))).alias(f"sketch{i}"),
            ]
            if number:
                x = v.cast("double")
                x = F.when(F.abs(x) < float("inf"), x)  # NaN is above infinity
                parts += [F.count(x).alias(f"finite{i}"), F.sum(x).alias(f"total{i}"), F.sum(x * x).alias(f"squares{i}")]
        if name in suite.fields:
            parts.append(F.count(F.when(suite.broken(name), 1)).alias(f"broken{i}"))
    wide = df.groupBy(F.col(suite.partition).alias("partition")).agg(*parts)
    made = set(wide.columns)
    rows = [
        F.struct(F.lit(name).alias("field"), *[(F.col(f"{k}{i}") if f"{k}{i}" in made else F.lit(None)).cast(t).alias(k) for k, t in STATE.items()])
        for i, name in enumerate(names)
    ]
    return wide.select("partition", "n", F.explode(F.array(*rows)).alias("_s")).select("partition", F.col("_s.field").alias("field"), "n", *[f"_s.{k}" for k in STATE])


def merge_states(*tables: DataFrame) -> DataFrame:
    """States of disjoint rows as one table."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    merge = {"low": F.min, "low_num": F.min, "high": F.max, "high_num": F.max, "sketch": F.hll_union_agg}
    return out.groupBy("partition", "field").agg(F.sum("n").alias("n"), *[merge.get(k, F.sum)(k).alias(k) for k in STATE])


#: Metrics held against control limits, with the deviation that is always allowed: absolute, and as a part of the usual value.
LIMITS = {
    "n": (0.0, 0.001), "null_rate": (0.001, 0.0), "broken_rate": (0.001, 0.0), "distinct": (0.0, 0.02), "mean": (0.0, 0.001), "low_num": (0.0, 0.001), "high_num": (0.0, 0.001),
}


def profile(st: DataFrame, sigmas: float = 3.0, least_history: int = 8) -> DataFrame:
    """Metrics of each (partition, field) with their change since the partition before and control-limit alarms.

    A metric is null where the field has none of that kind. It is out of control if it lies more than `sigmas`
    deviations from the mean over all earlier partitions that have it, of which `least_history` must exist; LIMITS
    gives the least deviation. distinct is an estimate from the sketch. A null partition comes first.
    """
    w = Window.partitionBy("field").orderBy("partition")  # a row per partition and field
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.col("total") / F.nullif(F.col("finite"), F.lit(0))
    out = st.select(
        "partition",
        "field",
        "n",
        (F.col("nulls") / F.col("n")).alias("null_rate"),
        F.hll_sketch_estimate("sketch").alias("distinct"),
        "low",
        "high",
        "low_num",
        "high_num",
        mean.alias("mean"),
        F.when(mean.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("finite") - mean * mean))).alias("deviation"),
        "broken",
        (F.col("broken") / F.col("n")).alias("broken_rate"),
    )
    made = {}
    for m, (least, part) in LIMITS.items():
        usual = F.avg(m).over(before)
        far = F.abs(F.col(m) - usual) > sigmas * F.greatest(F.stddev_samp(m).over(before), F.lit(least), F.abs(usual) * part)
        made[f"{m}_alarm"] = F.coalesce((F.count(m).over(before) >= least_history) & far, F.lit(False))
        made[f"{m}_change"] = F.col(m) - F.lag(m).over(w)
    return out.withColumns(made)


#: Parts of a doubling that a bin of numbers spans.
BINS_PER_DOUBLING = 2


def distribution_states(df: DataFrame, partition: str, group: str, number: str, categories: dict[str, str]) -> DataFrame:
    """(partition, group, *categories, bin, n, total, squares) of all rows, from one scan; sums of equal keys merge.

    number and categories are SQL expressions. bin is the number's place on a fixed logarithmic scale, mirrored below
    zero, "nan" or infinite; null for null. total and squares are sums over finite numbers.
    """
    x = F.expr(number).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    step = F.floor(F.log2(F.abs(x)) * BINS_PER_DOUBLING).cast("string")
    place = (
        F.when(x.isNull(), None).when(F.isnan(x), "nan").when(~finite, F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0").otherwise(F.concat(F.when(x > 0, "+").otherwise("-"), step))
    )
    keys = [F.expr(partition).alias("partition"), F.expr(group).alias("group"), *[F.expr(e).cast("string").alias(c) for c, e in categories.items()], place.alias("bin")]
    kept = F.when(finite, x)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(kept).alias("total"), F.sum(kept * kept).alias("squares"))


def merge_distributions(*tables: DataFrame) -> DataFrame:
    """Distribution states of disjoint rows as one table."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    keys = [c for c in out.columns if c not in ("n", "total", "squares")]
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def drift(st: DataFrame, number: str, sigmas: float = 3.0, least_history: int = 8) -> DataFrame:
    """Where distributions change: one row per (partition, group, field) with the number's name or a category's as field.

    A row has n, the mean and deviation of the finite numbers, mean_change and the total variation distance of bins or
    categories to the earlier partition that has this group and field. mean_alarm: the mean lies more than `sigmas`
    deviations from the mean of earlier means; the deviation is that of earlier means, or that of a mean of so many
    rows if larger. distance_alarm: the distance lies so far above earlier distances and above what chance gives for
    so few rows. Field "group" is the mix of groups of a whole partition. `least_history` earlier values must exist.
    """
    names = [c for c in st.columns if c not in ("partition", "group", "bin", "n", "total", "squares")]
    none = F.lit(None)

    def side(field: str, group: Column, category: Column, num: bool) -> Column:
        sums = [(F.col(c) if num else none).cast("double").alias(f"_{c}") for c in ("total", "squares")]
        finite = F.when(~F.col("bin").isin("nan", "inf", "-inf"), F.col("n")) if num else none
        return F.struct(F.lit(field).alias("field"), group.cast("string").alias("group"), category.alias("category"), *sums, finite.cast("bigint").alias("_finite"))

    sides = [side(number, F.col("group"), F.col("bin"), True), *[side(c, F.col("group"), F.col(c), False) for c in names], side("group", none, F.col("group"), False)]
    long = st.select("partition", "n", F.explode(F.array(*sides)).alias("_s")).select("partition", "n", "_s.*").where((F.col("field") != number) | F.col("category").isNotNull())
    # keys that hold no null: of partition, and of group and field
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    long = long.withColumn("_p", mark("partition")).withColumn("_key", F.concat("field", F.lit("\n"), mark("group")))
    sums = [F.sum(c).alias(c) for c in ("n", "_total", "_squares", "_finite")]
    cells = cut(long.groupBy("_p", "_key", "category").agg(*sums, *[F.first(c).alias(c) for c in ("partition", "group", "field")]), "cells")
    w = Window.partitionBy("_key").orderBy("partition")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = cells.groupBy("_p", "_key").agg(*sums, F.count(F.lit(1)).alias("_cells"), *[F.first(c).alias(c) for c in ("partition", "group", "field")])
    whole = whole.withColumn("_next", F.lead("_p").over(w)).withColumn("_n_before", F.lag("n").over(w))

    # each share counts for its own partition and against the next one that has this key
    share = cells.select("_p", "_key", "category", F.col("n").alias("_n")).join(whole.select("_p", "_key", "_next", F.col("n").alias("_all")), ["_p", "_key"])
    signed = share.select(
        "_key", "category", F.explode(F.array(F.struct(F.col("_p").alias("at"), (F.col("_n") / F.col("_all")).alias("s")), F.struct(F.col("_next").alias("at"), (-F.col("_n") / F.col("_all")).alias("s")))).alias("_e")
    ).where("_e.at is not null")
    gaps = signed.groupBy("_key", F.col("_e.at").alias("_p"), "category").agg(F.sum("_e.s").alias("_gap"))
    gaps = gaps.groupBy("_key", "_p").agg((F.sum(F.abs("_gap")) / 2).alias("_distance"))

    out = whole.join(gaps, ["_p", "_key"]).withColumn("distance", F.when(F.col("_n_before").isNotNull(), F.col("_distance")))
    out = out.withColumn("mean", F.col("_total") / F.expr("nullif(_finite, 0)"))
    out = out.withColumn("deviation", F.when(F.col("mean").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / F.col("_finite") - F.col("mean") * F.col("mean")))))
    seen = F.sum("_finite").over(before)
    pooled = F.greatest(F.lit(0.0), F.sum("_squares").over(before) / F.nullif(seen, F.lit(0)) - F.pow(F.sum("_total").over(before) / F.nullif(seen, F.lit(0)), 2))
    usual = F.avg("mean").over(before)
    spread = F.greatest(F.stddev_samp("mean").over(before), F.sqrt(pooled / F.nullif(F.col("_finite"), F.lit(0))), F.abs(usual) * 0.001)
    out = out.withColumn("mean_alarm", F.coalesce((F.count("mean").over(before) >= least_history) & (F.abs(F.col("mean") - usual) > sigmas * spread), F.lit(False)))
    out = out.withColumn("mean_change", F.col("mean") - F.lag("mean").over(w))
    chance = F.sqrt(F.col("_cells") * (1 / F.col("n") + 1 / F.col("_n_before")) / 6.283)  # the mean of a distance by chance is at most this
    limit = F.greatest(F.avg("distance").over(before), chance) + sigmas * F.greatest(F.stddev_samp("distance").over(before), F.lit(0.001))
    out = out.withColumn("distance_alarm", F.coalesce((F.count("distance").over(before) >= least_history) & (F.col("distance") > limit), F.lit(False)))
    return out.select("partition", "group", "field", "n", "mean", "deviation", "mean_change", "mean_alarm", "distance", "distance_alarm")


def broken_states(df: DataFrame, suite: Suite, ids: Sequence[str]) -> DataFrame:
    """(partition, fields, row, n), from a single scan of df: the counts of rows by what is broken in them.

    fields are the names of the fields whose constraints a row breaks. row holds the row's ids where there are any, else
    null, so that all sound rows of a partition are one state, combined within each task of the scan. Sums of equal
    keys merge.
    """
    fields = F.array_compact(F.array(*[F.when(suite.broken(f), F.lit(f)) for f in suite.fields]))
    d = df.select(F.col(suite.partition).alias("partition"), fields.alias("fields"), F.struct(*ids).alias("row"))
    return d.groupBy("partition", "fields", F.when(F.size("fields") > 0, F.col("row")).alias("row")).agg(F.count(F.lit(1)).alias("n"))


def broken_counts(st: DataFrame, suite: Suite) -> DataFrame:
    """(partition, field, n, broken) of every field with constraints, from broken states."""
    counts = [F.struct(F.lit(f).alias("field"), F.when(F.array_contains("fields", f), F.col("n")).otherwise(0).alias("broken")) for f in suite.fields]
    each = st.select("partition", "n", F.explode(F.array(*counts)).alias("_c"))
    return each.groupBy("partition", "_c.field").agg(F.sum("n").alias("n"), F.sum("_c.broken").alias("broken"))


def violations(st: DataFrame) -> DataFrame:
    """(*ids, field) from broken states: one row per row and field that breaks a constraint, repeats once."""
    return st.where("row is not null").select("row.*", F.explode("fields").alias("field")).distinct()


#: Which evidence types each source may report.
REGISTRY = {
    "STATIC": "dependency_count dependent_count transitive_dependent_count graph_depth loc cyclomatic_complexity",
    "GIT": "recent_commit_count historical_commit_count days_since_last_change unique_contributors lines_added lines_deleted"
    " total_churn churn_ratio co_change_count",
    "CONFIG": "config_reference config_reference_count",
    "RUNTIME": "observed_use execution_count days_since_last_observed runtime_coverage",
    "EXTERNAL": "possible_external_reference public_endpoint_count",
}


def evidence_suite() -> Suite:
    """The contract of the evidence table.

    A null or empty identifier breaks its pattern. value is judged only where availability is one of the three valid
    words; NaN counts as present. value is null where it holds neither number nor text; structs and lists as wholes have
    no range, their fields and sizes do.
    """
    pairs = ", ".join(f"'{s}:{t}'" for s, types in REGISTRY.items() for t in types.split())
    registered = f"coalesce(concat(source, ':', evidence_type) in ({pairs}), false)"
    valid = "coalesce(availability in ('AVAILABLE', 'UNKNOWN', 'UNAVAILABLE'), false)"
    present = "(value.num is not null or value.str is not null)"
    num, word = "value.num", "value.str"
    reference_ok = f"({word} is not null and {word} in ('RUNTIME', 'TEST', 'BUILD') and {num} is null)"
    number_ok = (
        f"({word} is null and {num} is not null and not isnan({num}) and {num} >= 0 and {num} < double('infinity')"
        f" and if(evidence_type = 'churn_ratio', {num} <= 1, {num} = floor({num})))"
    )
    typed_ok = (
        f"case when evidence_type = 'config_reference' then {reference_ok}"
        f" when evidence_type in ('observed_use', 'runtime_coverage', 'possible_external_reference') then true else {number_ok} end"
    )
    pattern = lambda c, p: f"not coalesce({c} rlike '\\\\A(?:{p})\\\\z', false)"
    checks = (
        Check("repo_id", pattern("repo_id", r"[\\w.-]+/[\\w.-]+")),
        Check("component_id", pattern("component_id", r"[A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)*")),
        Check("snapshot", pattern("snapshot", "[0-9a-f]{40}")),
        Check("time_window", "time_window.start_ts > time_window.end_ts"),
        Check("evidence_type", f"not {registered}"),
        Check("availability", f"not {valid}"),
        Check("value", f"{valid} and {present} <> (availability = 'AVAILABLE')"),
        Check("value", f"{valid} and {present} and {registered} and not ({typed_ok})"),
    )
    plain = "evidence_id schema_version repo_id snapshot component_id source evidence_type unit availability as_of extraction_method"
    json = lambda c: f"case when {c} is not null then to_json({c}) end"
    lists = ("provenance.commits", "provenance.files", "provenance.trace_ids")
    fields = ("value.num", "value.str", "value.kind", "time_window.start_ts", "time_window.end_ts", "provenance.note")
    unordered = {"value": "coalesce(value.str, cast(value.num as string))"} | {c: json(c) for c in ("time_window", "provenance", *lists)}
    sizes = {f"{c}.size": f"case when {c} is not null then size({c}) end" for c in lists}
    columns = {c: c for c in (*plain.split(), *fields)} | unordered | sizes
    return Suite("load_id", columns, checks, frozenset(unordered))
