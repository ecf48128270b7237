"""Queries of the general operators: skew, as-of, features, rolling totals, quality profile."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import asof, features, profile, rolling, skew
from loamline.plans.registry import Registry
from loamline.sources.tables import table

R = Registry()

# -- 3: a few keys holding most records ---------------------------------------------------------------------------


def _cases_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select(F.lower(F.trim("repo_id")).alias("key"), "as_of", F.expr("try_cast(git_total_churn as decimal(24, 4))").alias("value"))


def _evidence_by_component(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select(F.col("component_id").alias("key"), "as_of", F.expr("try_cast(value.num as decimal(24, 4))").alias("value"))


_FIELDS = (("cases.repo_id", _cases_by_repo), ("evidence.component_id", _evidence_by_component))


@R.add(
    "p3_found",
    """
with a as (select lower(trim(repo_id)) k from cases), b as (select component_id k from evidence)
select 'cases.repo_id' as field, k as key_value from a where k is not null group by k having 25 * count(*) >= (select count(*) from a)
union all
select 'evidence.component_id', k from b where k is not null group by k having 25 * count(*) >= (select count(*) from b)
""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that own at least a twenty-fifth of their table's rows."""
    out = []
    for field, rows in _FIELDS:
        df = rows(spark, d)
        plan = skew.plan_load(df, "key")
        large = plan.loads.where(25 * F.col("n") >= plan.total).select("key")  # meets the shards in their tasks
        per_key = skew.balanced_per_key(df, plan, "as_of", "value", large)
        out.append(per_key.where(f"25 * n >= {plan.total}").select(F.lit(field).alias("field"), F.col("key").alias("key_value")))
    return out[0].unionByName(out[1])


@R.add(
    "p3_per_key",
    """
with r as (
  select 'cases.repo_id' as field, lower(trim(repo_id)) as key_value, as_of, try_cast(git_total_churn as decimal(24, 4)) as v from cases
  union all select 'evidence.component_id', component_id, as_of, try_cast(value.num as decimal(24, 4)) from evidence)
select field, key_value, count(*) as n, max(as_of) as latest,
  sum(v)::double / count(v) as mean_value
from r group by 1, 2
""",
)
def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Count, latest as_of and mean value of every repository and component."""
    out = []
    for field, rows in _FIELDS:
        df = rows(spark, d)
        per_key = skew.balanced_per_key(df, skew.plan_load(df, "key"), "as_of", "value")
        out.append(per_key.select(F.lit(field).alias("field"), F.col("key").alias("key_value"), "n", "latest", "mean_value"))
    return out[0].unionByName(out[1])


@R.add(
    "p3_join",
    """
with c as (select component_id, max(loc) as loc, count(distinct repo_id) as repos from components group by 1)
select e.component_id, any_value(c.loc) as loc, any_value(c.repos) as repos, count(*) as n, max(e.as_of) as latest
from evidence e join c using (component_id) group by 1
""",
)
def p3_join(spark: SparkSession, d: str) -> DataFrame:
    """Evidence beside its component's facts, joined by fragments of hot components."""
    e = table(spark, d, "evidence").select("component_id", "as_of")
    c = table(spark, d, "components").groupBy("component_id").agg(F.max("loc").alias("loc"), F.countDistinct("repo_id").alias("repos"))
    joined = skew.balanced_join(e, c, skew.plan_load(e, "component_id"))
    return joined.groupBy("component_id").agg(F.max("loc").alias("loc"), F.max("repos").alias("repos"), F.count(F.lit(1)).alias("n"), F.max("as_of").alias("latest"))


# -- 4: attributes as known at event time -------------------------------------------------------------------------

ASOF_TYPES = ("total_churn", "unique_contributors", "config_reference_count")


@R.add(
    "p4_found",
    """
with c as (select distinct case_id, repo_id, target_component_id, as_of, parent_sha, commit_sha from cases where as_of is not null),
e as (select distinct e.repo_id, component_id, evidence_type, evidence_id, e.load_id, snapshot, as_of, loaded_at
  from evidence e join loads l on e.load_id = l.load_id
  where evidence_type in ('total_churn', 'unique_contributors', 'config_reference_count') and availability = 'AVAILABLE'
    and value.num is not null)
select case_id, evidence_type, evidence_id, load_id from (
  select case_id, evidence_type, evidence_id, load_id,
    row_number() over (partition by case_id, evidence_type
      order by (snapshot = coalesce(parent_sha, '')) desc, e.as_of desc, load_id desc, evidence_id) as rn
  from c join e on c.repo_id = e.repo_id and c.target_component_id = e.component_id
    and e.as_of <= c.as_of and e.loaded_at <= c.as_of and e.snapshot <> coalesce(c.commit_sha, ''))
where rn = 1
""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Evidence on each case's target as it was known at the case's cutoff."""
    return asof.evidence_asof_cases(table(spark, d, "cases"), table(spark, d, "evidence"), table(spark, d, "loads"), ASOF_TYPES)


# -- 5: per-entity feature table -----------------------------------------------------------------------------------

_P5 = r"""
with c as (select distinct repo_id, sha, lower(trim(author)) as author_key, ts from commits
  where trim(author) <> '' and ts is not null),
f as (select distinct repo_id, sha, file_ord, path, old_path, added, deleted, is_file_deletion from file_changes),
e as (select author_key, ts, coalesce(added, 0) + coalesce(deleted, 0) as lines,
    (case when old_path is not null then 'rename' when is_file_deletion then 'delete' else 'modify' end) || ':' || area as event_type
  from (select f.*, regexp_extract(path, '(?:^|/)src/(?:main|test)/java/[^/]+/[^/]+/([^/]+)/', 1) as area from f) f
  join c using (repo_id, sha) where area <> ''),
g as (select author_key, event_type, count(*) as n, sum(lines) as total, max(ts) as last from e group by 1, 2),
h as (select *, max(last) over (partition by author_key) as newest from g)
"""


@R.add("p5_found", _P5 + "select author_key, event_type from h where n >= 3 and total >= 40 and last <= newest - interval 120 day")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Authors' kinds of work that they did often enough and gave up at least 120 days before their last commit."""
    events = features.author_events(table(spark, d, "commits"), table(spark, d, "file_changes"))
    cells = features.feature_cells(events, min_count=3, min_total=40, min_gap=120 * 86_400_000_000)
    return cells.select(F.col("entity").alias("author_key"), "event_type")


@R.add(
    "p5_features",
    _P5
    + """, v as (select distinct event_type from g), a as (select distinct author_key, newest from h)
select a.author_key, string_agg(coalesce(h.n, 0)::varchar, ',' order by v.event_type) as n,
  string_agg(coalesce(h.total, 0)::varchar, ',' order by v.event_type) as total,
  string_agg(coalesce((epoch_us(a.newest) - epoch_us(h.last)) // 86400000000, -1)::varchar, ',' order by v.event_type) as days_since
from a cross join v left join h on h.author_key = a.author_key and h.event_type = v.event_type group by 1
""",
)
def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per author; the element of each list belongs to one of the event types in order of their names."""
    events = features.author_events(table(spark, d, "commits"), table(spark, d, "file_changes"))
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())  # the table's columns, so to say
    wide = features.feature_table(events, types)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.coalesce(x, F.lit(-1)).cast("string"))).alias(c)
    return wide.select(F.col("entity").alias("author_key"), text("n"), text("total"), text("days_since"))


# -- 6: rolling totals ---------------------------------------------------------------------------------------------

_P6 = """
with c as (select distinct repo_id, sha, cast(ts as date) as day from commits where repo_id is not null and sha is not null and ts is not null),
n as (select repo_id, day, count(*) as n from c group by 1, 2),
s as (select repo_id, min(day) as a, max(day) as b from n group by 1),
g as (select repo_id, a, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s),
r as (select g.repo_id, g.a, g.day,
    sum(coalesce(n, 0)) over (partition by g.repo_id order by g.day rows between 6 preceding and current row) as n7,
    sum(coalesce(n, 0)) over (partition by g.repo_id order by g.day rows between 29 preceding and current row) as n30
  from g left join n on g.repo_id = n.repo_id and g.day = n.day)
"""


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trees of the commits that came in order, corrected by those that came late."""
    on_time, late = rolling.late_commits(table(spark, d, "commits"))
    r = rolling.rolling_totals(on_time, "repo_id", late=late)
    return r.withColumn("date", F.date_from_unix_date("day"))


@R.add(
    "p6_found",
    _P6
    + """select repo_id, cast(strftime(day, '%Y%m%d') as integer) as day_key, case when n30 = 0 then 'quiet' else 'surge' end as kind
from r where day >= a + 29 and (n30 = 0 or (n7 >= 6 and 10 * n7 >= 7 * n30))""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Quiet and busy days of repositories, by their trailing commit counts."""
    r = _rolling(spark, d).where("day >= first_day + 29")
    kind = F.when(F.col("n30") == 0, "quiet").when((F.col("n7") >= 6) & (10 * F.col("n7") >= 7 * F.col("n30")), "surge")
    some = F.explode(F.array_compact(F.array(kind)))  # a filter would look everything up once more
    return r.select("repo_id", F.date_format("date", "yyyyMMdd").cast("int").alias("day_key"), some.alias("kind"))


@R.add(
    "p6_rolling",
    _P6 + "select repo_id, day as date, n7::bigint as n7, round(n7 / 7.0, 6) as mean7, n30::bigint as n30, round(n30 / 30.0, 6) as mean30 from r",
)
def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trailing commit counts and means of each repository and day."""
    return _rolling(spark, d).select("repo_id", "date", "n7", F.round("mean7", 6).alias("mean7"), "n30", F.round("mean30", 6).alias("mean30"))


@R.add(
    "p6_windows",
    """
with e as (select distinct repo_id, evidence_id, load_id, cast(time_window.end_ts as date) as day,
    (epoch_us(time_window.end_ts) - epoch_us(time_window.start_ts)) / 86400000000 as window_days,
    case when isfinite(value.num) then value.num else 0 end as v from evidence where evidence_type = 'recent_commit_count'),
c as (select * from e where repo_id is not null and window_days in (7, 30, 90)),
n as (select repo_id, window_days, day, count(*) as n, sum(v) as v from c group by 1, 2, 3),
s as (select repo_id, window_days, min(day) as a, max(day) as b from n group by 1, 2),
g as (select repo_id, window_days, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s),
r as (select g.repo_id, g.window_days, g.day, coalesce(n, 0) as n, coalesce(v, 0) as v from g left join n on g.repo_id = n.repo_id and g.window_days = n.window_days and g.day = n.day)
select repo_id, window_days::integer as window_days, day as date, """
    + ", ".join(
        f"(sum(n) over w{p})::bigint as n{p}, round(sum(v) over w{p}, 6) as total{p}, round((sum(v) over w{p}) / {p}.0, 6) as mean{p}" for p in (7, 30, 90)
    )
    + " from r window "
    + ", ".join(f"w{p} as (partition by repo_id, window_days order by day rows between {p - 1} preceding and current row)" for p in (7, 30, 90)),
)
def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of 7-, 30- and 90-day commit counts: how many windows ended, and the commits reported, in the trailing 7, 30 and 90 days."""
    t = F.col("time_window")
    days = (F.unix_micros(t["end_ts"].cast("timestamp")) - F.unix_micros(t["start_ts"].cast("timestamp"))) / F.lit(86_400_000_000)
    amount = F.when(F.abs("value.num") < float("inf"), F.col("value.num")).otherwise(0.0)
    e = table(spark, d, "evidence").where("evidence_type = 'recent_commit_count'")
    e = e.select("repo_id", "evidence_id", "load_id", days.alias("window_days"), rolling.day_number("time_window.end_ts").alias("day"), amount.alias("v")).distinct()
    daily = e.where(F.col("window_days").isin(7, 30, 90)).groupBy("repo_id", F.col("window_days").cast("int").alias("window_days"), "day")
    r = rolling.rolling_totals(daily.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), ["repo_id", "window_days"], (7, 30, 90))
    sums = [c for p in (7, 30, 90) for c in (F.col(f"n{p}"), F.round(f"total{p}", 6).alias(f"total{p}"), F.round(f"mean{p}", 6).alias(f"mean{p}"))]
    return r.select("repo_id", "window_days", F.date_from_unix_date("day").alias("date"), *sums)


# -- 7: quality profile --------------------------------------------------------------------------------------------

_PAIRS = ", ".join(f"'{s}:{t}'" for s, types in profile.REGISTRY.items() for t in types.split())

_P7 = rf"""
with e as (select *, coalesce(source || ':' || evidence_type in ({_PAIRS}), false) as registered,
    coalesce(availability in ('AVAILABLE', 'UNKNOWN', 'UNAVAILABLE'), false) as valid,
    (value.num is not null or value.str is not null) as present from evidence),
b as (select evidence_id, load_id,
    not coalesce(regexp_full_match(repo_id, '[\w.-]+/[\w.-]+'), false) as b_repo,
    not coalesce(regexp_full_match(component_id, '[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*'), false) as b_comp,
    not coalesce(regexp_full_match(snapshot, '[0-9a-f]{{40}}'), false) as b_snap,
    coalesce(time_window.start_ts > time_window.end_ts, false) as b_win,
    not registered as b_type, not valid as b_avail,
    valid and ((present <> (availability = 'AVAILABLE')) or (present and registered and not (case
      when evidence_type = 'config_reference' then coalesce(value.str in ('RUNTIME', 'TEST', 'BUILD'), false) and value.num is null
      when evidence_type in ('observed_use', 'runtime_coverage', 'possible_external_reference') then true
      else value.str is null and value.num is not null and not isnan(value.num) and not isinf(value.num) and value.num >= 0
        and (case when evidence_type = 'churn_ratio' then value.num <= 1 else value.num = floor(value.num) end) end))) as b_value
  from e)
"""
_P7_FIELDS = (("repo_id", "b_repo"), ("component_id", "b_comp"), ("snapshot", "b_snap"), ("time_window", "b_win"), ("evidence_type", "b_type"), ("availability", "b_avail"), ("value", "b_value"))


@R.add("p7_found", _P7 + " union ".join(f"select evidence_id, load_id, '{f}' as field from b where {c}" for f, c in _P7_FIELDS))
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows and the fields in which they break the contract."""
    return profile.violations(profile.broken_states(table(spark, d, "evidence"), profile.evidence_suite(), ["evidence_id", "load_id"]))


@R.add(
    "p7_states",
    _P7
    + " union all ".join(f"select load_id, '{f}' as field, count(*) as n, count(*) filter (where {c}) as broken from b group by 1" for f, c in _P7_FIELDS),
)
def p7_states(spark: SparkSession, d: str) -> DataFrame:
    """Rows and broken rows of each load and constrained field, merged from the states of two halves of the loads."""
    e, suite = table(spark, d, "evidence"), profile.evidence_suite()
    late = F.coalesce(F.col("load_id") >= 70, F.lit(False))
    halves = (profile.broken_counts(profile.broken_states(e.where(c), suite, ["evidence_id", "load_id"]), suite) for c in (~late, late))
    old, new = (h.withColumns({k: F.lit(None).cast(t) for k, t in profile.STATE.items() if k != "broken"}) for h in halves)
    return profile.merge_states(old, new).select(F.col("partition").alias("load_id"), "field", "n", "broken")


_P7_LISTS = ("commits", "files", "trace_ids")
_P7_NUMBERS = {"value.num": "value.num"} | {f"provenance.{c}.size": f"len(provenance.{c})" for c in _P7_LISTS}
_P7_TEXTS = {
    c: c for c in "evidence_id schema_version repo_id snapshot component_id source evidence_type unit availability extraction_method value.str value.kind provenance.note".split()
}
_P7_TIMES = {c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') || case when epoch_us({c}) % 1000000 <> 0 then rtrim(strftime({c}, '.%f'), '0') else '' end" for c in ("as_of", "time_window.start_ts", "time_window.end_ts")}
_P7_WHOLE = {"value": "coalesce(value.str, value.num::varchar)", "time_window": "time_window", "provenance": "provenance"} | {f"provenance.{c}": f"provenance.{c}" for c in _P7_LISTS}
_P7_ENTRIES = [
    *[(f, v, f"{v}::varchar", "null") for f, v in (_P7_TEXTS | _P7_TIMES).items()],
    *[(f, v, "null", f"{v}::double") for f, v in _P7_NUMBERS.items()],
    *[(f, v, "null", "null") for f, v in _P7_WHOLE.items()],
]
_P7_LIMITS = {m: x for m, x in profile.LIMITS.items() if m != "distinct"}


def _limit_sql(m: str, least: float, part: float) -> str:
    usual = f"avg({m}) over w"
    far = f"abs({m} - {usual}) > 3 * greatest(coalesce(stddev_samp({m}) over w, 0), {least}, abs({usual}) * {part})"
    return f"coalesce(count({m}) over w >= 8 and {far}, false) as {m}_alarm, {m} - lag({m}) over (partition by field order by load_id nulls first) as {m}_change"


@R.add(
    "p7_profile",
    _P7
    + ", k as ("
    + " union all ".join(f"select load_id, '{f}' as field, count(*) filter (where {c}) as broken from b group by 1" for f, c in _P7_FIELDS)
    + "), v as ("
    + " union all ".join(f"select load_id, '{f}' as field, ({v}) is null as void, {t} as t, {x} as x from evidence" for f, v, t, x in _P7_ENTRIES)
    + """), s as (select load_id, field, count(*) as n, avg(void::integer) as null_rate, min(t) as low, max(t) as high,
    min(x) filter (where not isnan(x)) as low_num, max(x) filter (where not isnan(x)) as high_num, avg(x) filter (where isfinite(x)) as mean,
    stddev_pop(x) filter (where isfinite(x)) as deviation from v group by 1, 2),
p as (select s.*, broken, broken / n as broken_rate from s left join k on s.load_id is not distinct from k.load_id and s.field = k.field)
select *, """
    + ", ".join(_limit_sql(m, *x) for m, x in _P7_LIMITS.items())
    + " from p window w as (partition by field order by load_id nulls first rows between unbounded preceding and 1 preceding)",
)
def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column's rates, range and moments by load, with changes and control-limit alarms; p7_distincts has the distinct counts."""
    out = profile.profile(profile.states(table(spark, d, "evidence"), profile.evidence_suite()))
    return out.withColumnRenamed("partition", "load_id").drop("distinct", "distinct_alarm", "distinct_change")


@R.add("p7_distincts")
def p7_distincts(spark: SparkSession, d: str) -> DataFrame:
    """Every column's distinct count by load with its alarm: estimates, so no SQL; a test bounds their error."""
    out = profile.profile(profile.states(table(spark, d, "evidence"), profile.evidence_suite()))
    return out.select(F.col("partition").alias("load_id"), "field", "distinct", "distinct_change", "distinct_alarm")


@R.add("p7_value_drift")
def p7_value_drift(spark: SparkSession, d: str) -> DataFrame:
    """Loads whose values, words or kinds of an evidence type, or mix of types, are distributed unlike those before; no SQL."""
    words = {"value.str": "value.str", "value.kind": "value.kind", "availability": "availability"}
    st = profile.distribution_states(table(spark, d, "evidence"), "load_id", "evidence_type", "value.num", {k.replace(".", "_"): v for k, v in words.items()})
    out = profile.drift(st, "value_num")
    return out.select(F.col("partition").alias("load_id"), F.col("group").alias("evidence_type"), *out.columns[2:])


@R.add(
    "p7_availability_drift",
    """
with n as (select load_id, availability as v, count(*) as n from evidence group by 1, 2),
o as (select load_id, row_number() over (order by load_id nulls first) as i from (select distinct load_id from n)),
s as (select i, v, n / sum(n) over (partition by i) as share from n join o on n.load_id is not distinct from o.load_id),
g as (select i, v, share from s union all select i + 1, v, -share from s),
x as (select i, v, abs(sum(share)) as gap from g group by 1, 2),
t as (select i, sum(gap) / 2 as distance from x group by 1)
select o.load_id, round(case when o.i > 1 then t.distance end, 6) as distance from o join t using (i)
""",
)
def p7_availability_drift(spark: SparkSession, d: str) -> DataFrame:
    """How far the mix of availability words in a load is from the load before."""
    st = profile.distribution_states(table(spark, d, "evidence"), "load_id", "null", "cast(null as double)", {"availability": "availability"})
    out = profile.drift(st, "none").where("field = 'availability'")
    return out.select(F.col("partition").alias("load_id"), F.round("distance", 6).alias("distance"))
