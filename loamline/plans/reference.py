"""Queries of the evidence-mining operators, on the project's own tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import paths, subjects, text
from loamline.functions.ids import evidence_id, iso_time
from loamline.operators import cases, config, evidence, history, lineage, quality
from loamline.plans.registry import Registry
from loamline.plans.storage import cut
from loamline.sources.tables import table

R = Registry()
DAY = 86_400_000_000

_T = """
t as (select distinct repo_id, component_id, sha, epoch_us(ts) as t, nullif(lower(trim(author)), '') as author,
  coalesce(added, 0) as added, coalesce(deleted, 0) as deleted, coalesce(is_bulk, false) as is_bulk,
  coalesce(removes_component, false) as gone from touches
  where repo_id is not null and component_id is not null and sha is not null and ts is not null)
"""
_CUT = "k as (select repo_id, max(t) + 1000000 as as_of from t group by 1)"
_BEFORE = f"""
b as (select a.repo_id, a.component_id, a.sha, a.t as as_of, count(b.sha) as n,
    count(b.sha) filter (where b.t >= a.t - 90 * {DAY}) as recent,
    coalesce(sum(b.added), 0)::bigint as added, coalesce(sum(b.deleted), 0)::bigint as deleted,
    coalesce(sum(b.added + b.deleted) filter (where b.t >= a.t - 90 * {DAY}), 0)::bigint as recent_churn,
    count(distinct b.author) as authors, (a.t - max(b.t)) // {DAY} as days,
    max((b.t, b.sha, b.gone)) filter (where b.sha is not null) as last
  from t a left join t b on a.repo_id = b.repo_id and a.component_id = b.component_id and b.t < a.t group by 1, 2, 3, 4)
"""


@R.add(
    "asof_activity",
    f"""with {_T}, {_BEFORE}
select repo_id, component_id, sha, as_of, n as historical_commit_count, recent as recent_commit_count, added as lines_added,
  deleted as lines_deleted, added + deleted as total_churn, recent_churn, authors as unique_contributors, days as days_since_last_change,
  case when added + deleted > 0 then round_even(recent_churn / (added + deleted), 4) end as churn_ratio, struct_extract(last, 2) as last_sha,
  coalesce(not struct_extract(last, 3), false) as alive
from b""",
)
def asof_activity(spark: SparkSession, d: str) -> DataFrame:
    """What was known of a component just before each of its touches."""
    return history.asof_activity(table(spark, d, "touches"))


_PARTNERS_BEFORE = """
pb as (select x.repo_id, x.component_id, y.component_id as partner, x.sha, x.t from t x join t y on x.repo_id = y.repo_id and x.sha = y.sha
  and x.component_id <> y.component_id where not x.is_bulk and not y.is_bulk),
qb as (select a.repo_id, a.component_id, a.sha, a.t, pb.partner from t a join pb on a.repo_id = pb.repo_id and a.component_id = pb.component_id and pb.t < a.t
  group by 1, 2, 3, 4, 5 having count(*) >= 2),
lb as (select qb.repo_id, qb.component_id, qb.sha, qb.partner, max((c.t, c.sha, c.gone)) as last from qb
  join t c on qb.repo_id = c.repo_id and qb.partner = c.component_id and c.t < qb.t group by 1, 2, 3, 4),
nb as (select repo_id, component_id, sha, count(*) as n from lb where not struct_extract(last, 3) group by 1, 2, 3),
cb as (select repo_id, component_id, sha, coalesce(n, 0) as n from t left join nb using (repo_id, component_id, sha))
"""


@R.add("co_change_before", f"with {_T}, {_PARTNERS_BEFORE} select repo_id, component_id, sha, n as co_change_count from cb")
def co_change_before(spark: SparkSession, d: str) -> DataFrame:
    """How many partners a component had just before each of its touches."""
    return history.co_change_before(table(spark, d, "touches"))


@R.add("snapshot_cutoffs", f"with {_T}, {_CUT} select * from k")
def snapshot_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """One second after each repository's last touch."""
    return history.snapshot_cutoffs(table(spark, d, "touches"))


_NOW = f"""
n as (select t.repo_id, t.component_id, as_of, count(*) as n, count(*) filter (where t.t >= as_of - 90 * {DAY}) as recent,
    count(distinct author) as authors, sum(added)::bigint as added, sum(deleted)::bigint as deleted,
    coalesce(sum(added + deleted) filter (where t.t >= as_of - 90 * {DAY}), 0)::bigint as recent_churn,
    (as_of - max(t.t)) // {DAY} as days, min(t.t) as first_t, max((t.t, sha, gone)) as last,
    array_to_string((list(sha order by t.t desc, sha desc))[1:20], ',') as shas
  from t join k using (repo_id) where t.t < as_of group by 1, 2, 3)
"""


@R.add(
    "snapshot_activity",
    f"""with {_T}, {_CUT}, {_NOW}
select repo_id, component_id, as_of, n as historical_commit_count, recent as recent_commit_count, authors as unique_contributors,
  added as lines_added, deleted as lines_deleted, added + deleted as total_churn, recent_churn, days as days_since_last_change,
  case when added + deleted > 0 then round_even(recent_churn / (added + deleted), 4) end as churn_ratio, first_t, struct_extract(last, 1) as last_t,
  struct_extract(last, 2) as last_sha, not struct_extract(last, 3) as alive, shas as latest_shas from n""",
)
def snapshot_activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity of every component at its repository's cutoff, with the latest commits."""
    t = table(spark, d, "touches")
    return history.activity_at(t, history.snapshot_cutoffs(t)).withColumn("latest_shas", F.array_join("latest_shas", ","))


@R.add("alive_components", f"with {_T}, {_CUT}, {_NOW} select repo_id, component_id from n where not struct_extract(last, 3)")
def alive_components(spark: SparkSession, d: str) -> DataFrame:
    """Components that exist at the cutoff."""
    t = table(spark, d, "touches")
    return history.activity_at(t, history.snapshot_cutoffs(t)).where("alive").select("repo_id", "component_id")


_PARTNERS = """
p as (select x.repo_id, x.component_id, y.component_id as partner, count(*) as n from t x join t y on x.repo_id = y.repo_id and x.sha = y.sha
  and x.component_id <> y.component_id join k on x.repo_id = k.repo_id where not x.is_bulk and not y.is_bulk and x.t < as_of group by 1, 2, 3 having count(*) >= 2),
a as (select repo_id, component_id as partner from (select t.repo_id, component_id, max((t.t, sha, gone)) as last from t join k using (repo_id)
  where t.t < as_of group by 1, 2) where not struct_extract(last, 3)),
pp as (select p.* from p semi join a on p.repo_id = a.repo_id and p.partner = a.partner)
"""


@R.add("co_change_pairs", f"with {_T}, {_CUT}, {_PARTNERS} select * from pp")
def co_change_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Living partners that changed with a component at least twice."""
    t = table(spark, d, "touches")
    return history.partners_at(t, history.snapshot_cutoffs(t))


_SCOPE = "s as (select repo_id, component_id, min(snapshot) as snapshot from components group by 1, 2)"
_ISO = lambda c: f"strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S') || case when {c} % 1000000 = 0 then '' else strftime(make_timestamp({c}), '.%f') end || '+00:00'"
_GIT = f"""
cc as (select repo_id, component_id, count(*) as cc from pp group by 1, 2),
pa as (select repo_id, component_id, array_to_string(list_sort(list_distinct(list(path))), ',') as files from (select t.repo_id, component_id, unnest(paths) as path
    from touches t join k using (repo_id) where epoch_us(ts) < as_of) where path is not null group by 1, 2),
top as (select repo_id, component_id, string_agg(partner || ' (' || n || ')', ', ' order by n desc, partner) as top from (select *, row_number() over (partition by repo_id, component_id order by n desc, partner) as i from pp)
  where i <= 10 group by 1, 2),
base as (select s.repo_id, s.component_id, s.snapshot, k.as_of, n.n, recent, days, authors, added, deleted, recent_churn, first_t, coalesce(files, '') as files, shas, struct_extract(last, 2) as last_sha, top,
    case when n.n is not null then coalesce(cc, 0) end as cc
  from s join k using (repo_id) left join n on s.repo_id = n.repo_id and s.component_id = n.component_id
  left join cc on s.repo_id = cc.repo_id and s.component_id = cc.component_id left join pa on s.repo_id = pa.repo_id and s.component_id = pa.component_id
  left join top on s.repo_id = top.repo_id and s.component_id = top.component_id),
long as (
  select *, 'recent_commit_count' as evidence_type, recent::double as num, as_of - 90 * {DAY} as w from base
  union all select *, 'historical_commit_count', n::double, first_t from base
  union all select *, 'days_since_last_change', days::double, null from base
  union all select *, 'unique_contributors', authors::double, first_t from base
  union all select *, 'lines_added', added::double, first_t from base
  union all select *, 'lines_deleted', deleted::double, first_t from base
  union all select *, 'total_churn', (added + deleted)::double, first_t from base
  union all select *, 'churn_ratio', case when added + deleted > 0 then round_even(recent_churn / (added + deleted), 4) end, as_of - 90 * {DAY} from base
  union all select *, 'co_change_count', cc::double, first_t from base),
ge as (select 'ev_' || left(sha1(concat_ws('|', repo_id, snapshot, component_id, 'GIT', evidence_type, {_ISO("as_of")},
    case when n is null or w is null then '' else {_ISO("w")} end, case when n is null or w is null then '' else {_ISO("as_of")} end)), 16) as evidence_id,
  repo_id, component_id, snapshot, evidence_type, num, case when num is null then 'UNKNOWN' else 'AVAILABLE' end as availability,
  case when num is null then '' else files end as files,
  case when num is null or evidence_type = 'co_change_count' then '' when evidence_type = 'days_since_last_change' then last_sha
    when evidence_type in ('recent_commit_count', 'churn_ratio') then array_to_string((string_split(shas, ','))[1:least(recent, 20)], ',') else shas end as commits,
  case when num is null then case when n is null then '{evidence.NOTE_NO_HISTORY}' else '{evidence.NOTE_NO_CHURN}' end
    when evidence_type = 'days_since_last_change' then null when evidence_type in ('recent_commit_count', 'churn_ratio') then recent || '{evidence.NOTE_RECENT.format(90)}'
    when evidence_type = 'co_change_count' then case when cc > 0 then '{evidence.NOTE_TOGETHER.format(2)}' || top else '{evidence.NOTE_ALONE}' end
    else n || '{evidence.NOTE_LIFE[0]}' || least(n, 20) || '{evidence.NOTE_LIFE[1]}' end as note from long)
"""


def _scope(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "components").groupBy("repo_id", "component_id").agg(F.min("snapshot").alias("snapshot"))


def _git_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "touches")
    return evidence.git_evidence(t, _scope(spark, d), history.snapshot_cutoffs(t))


@R.add("git_evidence", f"with {_T}, {_CUT}, {_NOW}, {_PARTNERS}, {_SCOPE}, {_GIT} select * from ge")
def git_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Nine evidence rows for each component, with ids."""
    return _git_evidence(spark, d).select("evidence_id", "repo_id", "component_id", "snapshot", "evidence_type", F.col("value.num").alias("num"), "availability",
        F.array_join("provenance.files.path", ",").alias("files"), F.array_join("provenance.commits", ",").alias("commits"), "provenance.note")


@R.add(
    "co_change_edges",
    f"""with {_T}, {_CUT}, {_NOW}, {_PARTNERS}, {_SCOPE}, {_GIT}
select p.repo_id, s.snapshot, p.component_id as source_id, p.partner as target_id, 'CO_CHANGE' as edge_type, p.n as count, evidence_id as evidence_ids
from pp p join s on p.repo_id = s.repo_id and p.component_id = s.component_id
semi join s s2 on p.repo_id = s2.repo_id and p.partner = s2.component_id
left join ge on ge.repo_id = p.repo_id and ge.component_id = p.component_id and ge.evidence_type = 'co_change_count'""",
)
def co_change_edges(spark: SparkSession, d: str) -> DataFrame:
    """Co-change edges between components in scope, with the evidence behind them."""
    t = table(spark, d, "touches")
    e = evidence.co_change_edges(t, _scope(spark, d), history.snapshot_cutoffs(t), _git_evidence(spark, d))
    return e.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


# -- lineage and touches ---------------------------------------------------------------------------------------------


_BELOW = " ".join(
    f"when starts_with(path, '{r}') then path[{len(r) + 1}:] when instr(path, '/{r}') > 0 then path[instr(path, '/{r}') + {len(r) + 1}:]" for r in paths.SOURCE_ROOTS
)
_COMPONENT = f"case when ends_with(path, '.java') and not regexp_matches(path, '(^|/)(package|module)-info\\.java$') then replace(regexp_replace(case {_BELOW} end, '\\.java$', ''), '/', '.') end"
# by walks: along the newest renames where a path leads, and from each rename up to the one whose meaning it hands on
_LINEAGE = f"""
place as (select repo_id, sha, min(log_ord) as log_ord from commits where repo_id is not null and sha is not null group by 1, 2),
od as (select *, row_number() over (partition by repo_id order by log_ord, file_ord, sha, coalesce(path, ''), coalesce(old_path, '')) as seq
  from (select distinct repo_id, sha, file_ord, path, old_path, added, deleted, is_file_deletion from file_changes) join place using (repo_id, sha)),
lv as (select repo_id, path, min(component_id) as owner from (select repo_id, component_id, min(file_path) as path from components group by 1, 2) where path is not null group by 1, 2),
rn as (select repo_id, seq, path, old_path from od where path <> old_path),
nw as (select * from (select repo_id, old_path as path, arg_min(path, seq) as nxt from rn group by 1, 2) x anti join lv on x.repo_id = lv.repo_id and x.path = lv.path),
walk as (select repo_id, path, nxt as hop, [path, nxt] as trail, nxt = path as met from nw
  union all select w.repo_id, w.path, n.nxt, list_append(trail, n.nxt), list_contains(trail, n.nxt) from walk w join nw n on w.repo_id = n.repo_id and w.hop = n.path where not met),
ld as (select repo_id, path, arg_max(hop, len(trail)) as leads from walk group by 1, 2),
mk as (select *, lag(begins) over w as above, lag(seq) over w as above_seq, lead(seq) over w as below from
  (select repo_id, old_path as path, seq, true as begins from rn union all select repo_id, path, seq, false from rn) window w as (partition by repo_id, path order by seq)),
up as (select repo_id, seq, above_seq from mk where not begins and above),
tops as (select repo_id, seq, seq as top from rn anti join up using (repo_id, seq) union all select u.repo_id, u.seq, t.top from up u join tops t on u.repo_id = t.repo_id and u.above_seq = t.seq),
mn as (select t.repo_id, t.seq, coalesce(leads, r.path) as stands from tops t join rn r on r.repo_id = t.repo_id and r.seq = t.top left join ld on ld.repo_id = r.repo_id and ld.path = r.path),
st as (select mk.repo_id, mk.path, mk.seq as top, mk.below, stands from mk join mn on mk.repo_id = mn.repo_id and mk.seq = mn.seq where begins),
fp as (select od.*, coalesce(st.stands, case when lv.path is not null then od.path end, leads, od.path) as final_path from od
  left join st on st.repo_id = od.repo_id and st.path = od.path and od.seq > st.top and (st.below is null or od.seq <= st.below)
  left join lv on lv.repo_id = od.repo_id and lv.path = od.path left join ld on ld.repo_id = od.repo_id and ld.path = od.path),
nm as (select distinct path, {_COMPONENT} as named from (select final_path as path from fp)),
atc as (select fp.*, coalesce(owner, named) as component_id from fp left join lv on lv.repo_id = fp.repo_id and lv.path = fp.final_path left join nm on nm.path = fp.final_path
  where coalesce(owner, named) is not null),
fst as (select repo_id, sha, component_id, arg_min(coalesce(old_path, path), file_ord) as parent_path from atc group by 1, 2, 3)
"""
_BUILT = """
pc as (select repo_id, sha, component_id, sum(coalesce(added, 0))::bigint as added, sum(coalesce(deleted, 0))::bigint as deleted, list_sort(list_distinct(list(path))) as paths,
    bool_and(coalesce(is_file_deletion, false) and old_path is null) as removes_component from atc group by 1, 2, 3),
sz as (select repo_id, sha, count(*) > 30 as is_bulk from (select distinct repo_id, sha, file_ord, path from file_changes) group by 1, 2),
hx as (select repo_id, sha, min((log_ord, ts, lower(trim(author)))) as h from commits group by 1, 2),
mb as (select repo_id, sha, list_sort(list(component_id)) as members from pc join sz using (repo_id, sha) where not is_bulk group by 1, 2),
bt as (select pc.repo_id, pc.component_id, pc.sha, struct_extract(h, 2) as ts, struct_extract(h, 3) as author, added, deleted, array_to_string(paths, ',') as paths, is_bulk, removes_component,
    coalesce(array_to_string(list_filter(members, lambda x: x <> pc.component_id), ','), '') as partners
  from pc join sz using (repo_id, sha) join hx using (repo_id, sha) left join mb using (repo_id, sha))
"""


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    return lineage.attribute_changes(table(spark, d, "commits"), table(spark, d, "file_changes"), table(spark, d, "components"))


@R.add("attributed_changes", f"with recursive {_LINEAGE} select repo_id, sha, file_ord, path, final_path, component_id from atc")
def attributed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each file change with the component that it belongs to by renames."""
    return _attributed(spark, d).select("repo_id", "sha", "file_ord", "path", "final_path", "component_id")


def _built_touches(spark: SparkSession, d: str) -> DataFrame:
    return lineage.build_touches(_attributed(spark, d), table(spark, d, "commits"), table(spark, d, "file_changes"))


@R.add("built_touches", f"with recursive {_LINEAGE}, {_BUILT} select * from bt")
def built_touches(spark: SparkSession, d: str) -> DataFrame:
    """Touches made from commits and attributed changes."""
    return _built_touches(spark, d).withColumns({c: F.array_join(c, ",") for c in ("paths", "partners")})


@R.add("first_paths", f"with recursive {_LINEAGE} select * from fst")
def first_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where each commit found the components that it changes."""
    return lineage.first_paths(_attributed(spark, d))


@R.add("review_sample")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty components to look at; the limit is the sample's size, the order Spark's hash, so no SQL."""
    return quality.sample(table(spark, d, "components"), ["repo_id", "component_id"], 30)


@R.add(
    "touch_differences",
    f"""with recursive {_LINEAGE}, {_BUILT}, x as (select distinct repo_id, component_id, sha, added, deleted from touches)
select coalesce(bt.repo_id, x.repo_id) as repo_id, count(*) filter (where bt.sha is not null and x.sha is not null) as in_both, count(*) filter (where x.sha is null) as only_ours,
  count(*) filter (where bt.sha is null) as only_theirs, count(*) filter (where not (bt.added = coalesce(x.added, 0) and bt.deleted = coalesce(x.deleted, 0)) and x.sha is not null) as other_lines
from bt full join x on bt.repo_id = x.repo_id and bt.component_id = x.component_id and bt.sha = x.sha group by 1""",
)
def touch_differences(spark: SparkSession, d: str) -> DataFrame:
    """How the touches that we make differ from those delivered, per repository."""
    keys = ["repo_id", "component_id", "sha"]
    ours = _built_touches(spark, d).select(*keys, "added", "deleted", F.lit(1).alias("_ours"))
    theirs = table(spark, d, "touches").select(*keys, F.col("added").alias("a"), F.col("deleted").alias("d"), F.lit(1).alias("_theirs")).distinct()
    both = ours.join(theirs, keys, "full")
    same = (F.col("added") == F.coalesce("a", F.lit(0))) & (F.col("deleted") == F.coalesce("d", F.lit(0)))
    return both.groupBy("repo_id").agg(
        F.count_if(F.col("_ours").isNotNull() & F.col("_theirs").isNotNull()).alias("in_both"),
        F.count_if(F.col("_theirs").isNull()).alias("only_ours"),
        F.count_if(F.col("_ours").isNull()).alias("only_theirs"),
        F.count_if(F.col("_theirs").isNotNull() & ~same).alias("other_lines"),
    )


_PRINT = """
f as (select distinct repo_id, sha, file_ord, path || ':' || coalesce(added::varchar, '-') || ':' || coalesce(deleted::varchar, '-') as l from file_changes),
pr as (select repo_id, sha, sha256(string_agg(l, chr(10) order by l)) as patch_id from f group by 1, 2),
pl as (select repo_id, sha, min(log_ord) as log_ord from commits group by 1, 2),
du as (select repo_id, sha, patch_id, row_number() over (partition by repo_id, patch_id order by log_ord desc, sha desc) > 1 as duplicate
  from pr join pl using (repo_id, sha))
"""


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return lineage.first_duplicate(table(spark, d, "commits"), lineage.patch_prints(table(spark, d, "file_changes")))


@R.add("duplicate_commits", f"with {_PRINT} select * from du")
def duplicate_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits whose patch an older commit brought already."""
    return _duplicates(spark, d)


@R.add(
    "line_ranges",
    """with l as (select distinct repo_id, f.path as path, f.line as line from (select repo_id, unnest(provenance.files) as f from evidence) where f.line is not null),
i as (select *, line - row_number() over (partition by repo_id, path order by line) as i from l)
select repo_id, path, min(line) as first, max(line) as last from i group by repo_id, path, i""",
)
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring lines that evidence points to."""
    f = table(spark, d, "evidence").select("repo_id", F.explode("provenance.files").alias("f")).select("repo_id", "f.path", "f.line")
    return lineage.contiguous_ranges(f, ["repo_id", "path"], "line")


# -- cases -----------------------------------------------------------------------------------------------------------

_NO_AHEAD = [p.replace(r"(?!\s+(in|of|for)\b)", "") for p in subjects.COSMETIC]
_WEIRD = next(p for p in subjects.COSMETIC if "(?!" in p).replace(r"(?!\s+(in|of|for)\b)", r"\s+(in|of|for)\b")
_OTHERS = "|".join(p for p in subjects.COSMETIC if "(?!" not in p)
_FORMATTING = next(p for p in _NO_AHEAD if "formatting" in p and "weird" in p)
_COSMETIC_SQL = (
    rf"(regexp_matches(s, '(?i)\b({_OTHERS})') or regexp_matches(s, '{subjects.COSMETIC_CJK}')"
    rf" or (regexp_matches(s, '(?i)\b{_FORMATTING}') and not regexp_matches(s, '(?i)\b{_WEIRD}')))"
)
_BUG_SQL = f"((regexp_matches(s, '(?i){subjects.BUG_FIX}') or regexp_matches(s, '{subjects.BUG_FIX_CJK}')) and not {_COSMETIC_SQL})"


@R.add(
    "commit_filters",
    f"with c as (select distinct repo_id, sha, coalesce(subject, '') as s from commits) select repo_id, sha, {_COSMETIC_SQL} as cosmetic, {_BUG_SQL} as bug_fix from c",
)
def commit_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which commits are cosmetic and which fix bugs, by their subjects."""
    c = table(spark, d, "commits").select("repo_id", "sha", F.coalesce("subject", F.lit("")).alias("subject")).distinct()
    return c.select("repo_id", "sha", subjects.is_cosmetic("subject").alias("cosmetic"), subjects.is_bug_fix("subject").alias("bug_fix"))


_CANDIDATES = f"""
h as (select repo_id, sha, arg_min(parent, (log_ord, parent, subject)) as p0, min((log_ord, parent, subject)) as h from commits group by 1, 2),
hd as (select repo_id, sha, struct_extract(h, 2) as parent, coalesce(struct_extract(h, 3), '') as s from h),
fl as (select repo_id, component_id, sha, bool_and(len(list_filter(coalesce(paths, []), lambda x: not (starts_with(x, 'src/test/') or contains(x, '/src/test/')))) = 0) as test,
    bool_or(is_bulk) as bulk, bool_and(removes_component) as removes, min(list_min(paths)) as path from touches group by 1, 2, 3),
ce as (select repo_id, max(as_of) - 180 * {DAY} as censor from b group by 1),
dd as (select b.repo_id, b.sha, b.component_id, b.as_of, coalesce(not struct_extract(last, 3), false) as existing, test, bulk, removes, coalesce(fst.parent_path, path) as path, parent, s,
    coalesce(du.duplicate, false) as dup, b.as_of >= censor as censored
  from b join fl using (repo_id, component_id, sha) join hd using (repo_id, sha) left join du using (repo_id, sha) join ce using (repo_id) left join fst using (repo_id, component_id, sha)),
pe as (select *, count(*) filter (where not test and existing) over (partition by repo_id, sha) as ex, count(*) filter (where test) over (partition by repo_id, sha) as tests from dd),
ca as (select repo_id, sha, component_id, make_timestamp(as_of) as as_of, existing,
    case when parent is null then 'root_commit' when dup then 'duplicate_patch' when bulk then 'bulk_commit' when {_COSMETIC_SQL} then 'cosmetic_commit'
      when censored then 'censored_recent' end as reason,
    case when removes then 'DELETE' else 'MODIFY' end as action, ex - 1 as spread, tests as impacted_test_count, parent, path as target_path
  from pe where not test)
"""
_INDUCING = f"""
fx as (select repo_id, sha from hd where {_BUG_SQL}),
li as (select t.repo_id, t.component_id, t.sha as fix, max((x.t, x.sha)) as src from t join fx using (repo_id, sha)
  join t x on x.repo_id = t.repo_id and x.component_id = t.component_id and x.t < t.t and x.added > 0 group by 1, 2, 3),
ind as (select repo_id, struct_extract(src, 2) as sha, component_id, list(fix order by fix) as fixes from li group by 1, 2, 3)
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return cases.candidates(table(spark, d, "touches"), table(spark, d, "commits"), _duplicates(spark, d), lineage.first_paths(_attributed(spark, d)))


@R.add("case_candidates", f"with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES} select * from ca")
def case_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Production components changed by each commit, and why a commit gives no cases."""
    return _candidates(spark, d)


@R.add(
    "exclusion_tally",
    f"""with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES}
select repo_id, reason, count(*) as n from ca where existing and reason is not null group by 1, 2
union all select repo_id, 'new_component', count(*) filter (where not existing) from ca group by 1""",
)
def exclusion_tally(spark: SparkSession, d: str) -> DataFrame:
    """Excluded components by reason."""
    return cases.exclusion_tally(_candidates(spark, d))


@R.add(
    "inducing_commits",
    f"with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES}, {_INDUCING} select repo_id, sha, component_id, array_to_string(fixes, ',') as fixes from ind",
)
def inducing_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits that last added lines to what a later fix changed."""
    return cases.inducing_commits(table(spark, d, "touches"), table(spark, d, "commits")).withColumn("fixes", F.array_join("fixes", ","))


@R.add(
    "fixes_traced",
    f"""with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES}, {_INDUCING}, x as (select repo_id, sha, unnest(fixes) as fix from ind)
select repo_id, count(distinct sha) as inducing, count(distinct fix) as fixes from x group by 1""",
)
def fixes_traced(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes each repository's links come from."""
    return quality.fixes_traced(cases.inducing_commits(table(spark, d, "touches"), table(spark, d, "commits")))


_MINED = """
mc as (select repo_id || '@' || left(sha, 12) || ':' || component_id as case_id, repo_id, sha as commit_sha, parent as parent_sha, as_of, component_id as target_component_id,
  target_path as target_parent_path, action, spread as label_spread, impacted_test_count as label_impacted_test_count, fixes is not null as label_caused_bug_fix,
  coalesce(len(fixes), 0)::integer as label_fix_commit_count,
  case when fixes is not null or spread >= 4 then 'HIGH' when spread >= 1 then 'MEDIUM' else 'LOW' end as label
from ca left join ind using (repo_id, sha, component_id) where existing and reason is null)
"""


def _mined(spark: SparkSession, d: str) -> DataFrame:
    return cases.mined(_candidates(spark, d), cases.inducing_commits(table(spark, d, "touches"), table(spark, d, "commits")))


@R.add("mined_cases", f"with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES}, {_INDUCING}, {_MINED} select * from mc")
def mined_cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled change cases."""
    return _mined(spark, d)


@R.add(
    "case_rows",
    f"""with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES}, {_INDUCING}, {_MINED}, {_PARTNERS_BEFORE},
cf as (select repo_id, component_id, snapshot, arg_min(value.num, (-load_id, evidence_id, value.num)) as refs from evidence
  where evidence_type = 'config_reference_count' and availability = 'AVAILABLE' and value.num is not null group by 1, 2, 3),
qs as (select repo_id, quantile_cont(epoch_us(as_of)::double, 0.7) as q1, quantile_cont(epoch_us(as_of)::double, 0.85) as q2 from mc group by 1)
select mc.case_id, mc.repo_id, commit_sha, parent_sha, mc.as_of, target_component_id, target_parent_path, action,
  case when action = 'DELETE' then 1.0 else 0.0 end as action_is_delete,
  case when b.added + b.deleted > 0 then round_even(recent_churn / (b.added + b.deleted), 4) end as git_churn_ratio, cb.n::double as git_co_change_count,
  days::double as git_days_since_last_change, b.n::double as git_historical_commit_count, b.added::double as git_lines_added, b.deleted::double as git_lines_deleted,
  recent::double as git_recent_commit_count, (b.added + b.deleted)::double as git_total_churn, authors::double as git_unique_contributors, refs as config_config_reference_count,
  label_spread, label_impacted_test_count, label_caused_bug_fix, label_fix_commit_count, label,
  case when epoch_us(mc.as_of) < q1 then 'train' when epoch_us(mc.as_of) < q2 then 'validation' else 'test' end as split
from mc join b on b.repo_id = mc.repo_id and b.sha = commit_sha and b.component_id = target_component_id
join cb on cb.repo_id = mc.repo_id and cb.sha = commit_sha and cb.component_id = target_component_id
left join cf on cf.repo_id = mc.repo_id and cf.component_id = target_component_id and cf.snapshot = parent_sha left join qs on qs.repo_id = mc.repo_id""",
)
def case_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole data set from commits, touches and evidence: cases with features as of their parent, labels and splits."""
    m = cut(_mined(spark, d), "mined")
    rows = cases.with_features(m, table(spark, d, "touches"), cases.config_counts_at_parent(m, table(spark, d, "evidence")))
    return cases.chronological_splits(rows)


@R.add("capped_cases")
def capped_cases(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 delivered cases of each repository, whole commits chosen by hash."""
    return cases.cap_cases(_distinct_cases(spark, d), 200).select("case_id", "repo_id", "commit_sha")


def _distinct_cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").distinct()


_C = "c as (select distinct * from cases)"


@R.add(
    "label_rule",
    f"""with {_C} select case_id, case when coalesce(label_caused_bug_fix, false) or label_spread >= 4 then 'HIGH' when label_spread >= 1 then 'MEDIUM' else 'LOW' end as label from c""",
)
def label_rule(spark: SparkSession, d: str) -> DataFrame:
    """The label that each delivered case's spread and bug flag give."""
    return _distinct_cases(spark, d).select("case_id", cases.label("label_spread", "label_caused_bug_fix").alias("label"))


@R.add(
    "chronological_splits",
    f"""with {_C}, q as (select repo_id, quantile_cont(epoch_us(as_of)::double, 0.7) as a, quantile_cont(epoch_us(as_of)::double, 0.85) as b from c
  where repo_id <> 'tallowbrook/auditkit' group by 1)
select case_id, case when repo_id = 'tallowbrook/auditkit' then 'holdout' when epoch_us(as_of) < a then 'train' when epoch_us(as_of) < b then 'validation'
  when as_of is not null then 'test' end as split from c left join q using (repo_id)""",
)
def chronological_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each repository's cases split by time, one repository held out."""
    return cases.chronological_splits(_distinct_cases(spark, d), ["tallowbrook/auditkit"]).select("case_id", "split")


# -- quality ---------------------------------------------------------------------------------------------------------

_COUNTS = "count(*) filter (where label = 'LOW') as LOW, count(*) filter (where label = 'MEDIUM') as MEDIUM, count(*) filter (where label = 'HIGH') as HIGH, count(*) filter (where label in ('LOW', 'MEDIUM', 'HIGH')) as total"

for _by in ("repo_id", "split", "action"):
    R.add(f"labels_by_{_by}", f"with {_C} select {_by}, {_COUNTS} from c group by 1")(
        lambda spark, d, by=_by: quality.label_table(_distinct_cases(spark, d), by)
    )

_FEATURES = evidence.FEATURES


@R.add(
    "missing_rates",
    f"with {_C} " + " union all ".join(f"select '{f}' as feature, count(*) filter (where {f} is null or isnan({f})) as missing, count(*) as n from c" for f in _FEATURES),
)
def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each feature is unknown."""
    return quality.missing_rates(_distinct_cases(spark, d), _FEATURES)


@R.add(
    "repo_shares",
    f"with {_C}, n as (select repo_id, count(*) as n from c group by 1) select repo_id, n, n / sum(n) over () as share, n / sum(n) over () > 0.6 as dominant from n",
)
def repo_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each repository's share of the cases."""
    return quality.repo_shares(_distinct_cases(spark, d))


@R.add(
    "medians_by_label",
    f"with {_C}, l as ("
    + " union all ".join(f"select label, '{f}' as feature, {f}::double as v from c" for f in _FEATURES)
    + ") select label, feature, median(v) as median from l where label is not null and v is not null and not isnan(v) group by 1, 2",
)
def medians_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's median by label."""
    return quality.medians_by_label(_distinct_cases(spark, d), _FEATURES)


@R.add(
    "leakage_checks",
    f"""with {_C}, e as (select repo_id, max(as_of) filter (where split = 'train') as t1, min(as_of) filter (where split = 'validation') as v0,
    max(as_of) filter (where split = 'validation') as v1, min(as_of) filter (where split = 'test') as s0 from c group by 1)
select 'no_forbidden_column_used_as_feature' as "check", true as passed
union all select 'case_ids_unique', count(*) = count(distinct case_id) from c
union all select 'days_since_last_change_non_negative', coalesce(min(git_days_since_last_change) filter (where not isnan(git_days_since_last_change)) >= 0, true) from c
union all select 'splits_are_chronological', count(*) filter (where t1 > v0 or v1 > s0) = 0 from e""",
)
def leakage_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the cases give anything away."""
    forbidden = ["label", "label_spread", "label_impacted_test_count", "label_caused_bug_fix", "label_fix_commit_count"]
    return quality.leakage_checks(_distinct_cases(spark, d), _FEATURES, forbidden)


@R.add(
    "review_metrics",
    f"""with recursive {_LINEAGE}, {_T}, {_BEFORE}, {_PRINT}, {_CANDIDATES}, {_INDUCING}, {_C},
v as (select c.repo_id, label = 'HIGH' as high, ind.fixes is not null as bug from c left join ind on ind.repo_id = c.repo_id and ind.sha = commit_sha and ind.component_id = target_component_id
  where label is not null),
g as (select repo_id, count(*) as reviewed, count(*) filter (where high and bug) as "right", count(*) filter (where high) as predicted, count(*) filter (where bug) as actual from v group by 1)
select *, case when predicted > 0 then "right" / predicted end as precision, case when actual > 0 then "right" / actual end as recall,
  case when predicted > 0 then greatest(0, ("right" / predicted + 3.8416 / (2 * predicted)) / (1 + 3.8416 / predicted)
    - 1.96 * sqrt("right" / predicted * (1 - "right" / predicted) / predicted + 3.8416 / (4 * predicted * predicted)) / (1 + 3.8416 / predicted)) end as low,
  case when predicted > 0 then least(1, ("right" / predicted + 3.8416 / (2 * predicted)) / (1 + 3.8416 / predicted)
    + 1.96 * sqrt("right" / predicted * (1 - "right" / predicted) / predicted + 3.8416 / (4 * predicted * predicted)) / (1 + 3.8416 / predicted)) end as high from g""",
)
def review_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Delivered HIGH labels held against bug fixes that we trace ourselves from touches: precision with its interval, and recall, by repository."""
    traced = cases.inducing_commits(table(spark, d, "touches"), table(spark, d, "commits"))
    traced = traced.select("repo_id", F.col("sha").alias("commit_sha"), F.col("component_id").alias("target_component_id"), F.lit(True).alias("_bug"))
    c = _distinct_cases(spark, d).where("label is not null").join(traced, ["repo_id", "commit_sha", "target_component_id"], "left")
    c = c.withColumns({"predicted_high": F.col("label") == "HIGH", "traced": F.coalesce("_bug", F.lit(False))})
    return quality.review(c, ["repo_id"], "predicted_high", "traced")


@R.add(
    "count_bounds",
    f"""with {_T}, {_CUT}, {_NOW}, lv as (select repo_id, component_id, min(file_path) as path from components where file_path is not null group by 1, 2),
cm as (select distinct repo_id, sha, epoch_us(ts) as t from commits where ts is not null),
pl as (select lv.repo_id, lv.component_id, count(distinct f.sha) as plain from lv join file_changes f on f.repo_id = lv.repo_id and f.path = lv.path
  join cm on cm.repo_id = f.repo_id and cm.sha = f.sha join k on k.repo_id = lv.repo_id where cm.t < k.as_of group by 1, 2)
select repo_id, component_id, n.n as counted, plain from n join pl using (repo_id, component_id) where n.n < plain""",
)
def count_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Components with fewer delivered touches than commits that plainly name their present file: counts that can't be right."""
    t, k = table(spark, d, "touches"), history.snapshot_cutoffs(table(spark, d, "touches"))
    return quality.count_bounds(history.activity_at(t, k), table(spark, d, "components"), table(spark, d, "file_changes"), table(spark, d, "commits"), k)


# -- evidence --------------------------------------------------------------------------------------------------------


@R.add(
    "feature_pivot",
    "with e as (select distinct repo_id, component_id, snapshot, lower(source) || '_' || evidence_type as c,"
    " case when availability = 'AVAILABLE' and not isnan(value.num) then value.num end as v from evidence where evidence_type <> 'config_reference')"
    " select repo_id, component_id, snapshot, 0.0::double as action_is_delete, "
    + ", ".join(f"max(v) filter (where c = '{f}') as {f}" for f in _FEATURES[1:])
    + ", ("
    + " + ".join(f"coalesce((min(v) filter (where c = '{f}') <> max(v) filter (where c = '{f}'))::integer, 0)" for f in _FEATURES[1:])
    + ")::integer as conflicts from e group by 1, 2, 3",
)
def feature_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Feature columns from all evidence of a component at a snapshot, contradictions counted."""
    return evidence.features(table(spark, d, "evidence"), ["repo_id", "component_id", "snapshot"], strict=False)


@R.add(
    "evidence_ids",
    f"""with e as (select distinct evidence_id, load_id, repo_id, snapshot, component_id, source, evidence_type, epoch_us(as_of) as t,
  epoch_us(time_window.start_ts) as a, epoch_us(time_window.end_ts) as b from evidence)
select evidence_id, load_id, 'ev_' || left(sha1(concat_ws('|', coalesce(repo_id, ''), coalesce(snapshot, ''), coalesce(component_id, ''), coalesce(source, ''),
  coalesce(evidence_type, ''), coalesce({_ISO("t")}, ''), coalesce({_ISO("a")}, ''), coalesce({_ISO("b")}, ''))), 16) as made_id from e""",
)
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id that each delivered row's identifying fields give."""
    e = table(spark, d, "evidence").select("evidence_id", "load_id", "repo_id", "snapshot", "component_id", "source", "evidence_type", "as_of", "time_window").distinct()
    parts = [F.col(c) for c in ("repo_id", "snapshot", "component_id", "source", "evidence_type")]
    parts += [iso_time(c) for c in (F.col("as_of"), F.col("time_window.start_ts"), F.col("time_window.end_ts"))]
    return e.select("evidence_id", "load_id", evidence_id(parts).alias("made_id"))


@R.add("evidence_fingerprint")
def evidence_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of all evidence rows, whatever their order. Made from Spark's JSON, so no SQL."""
    return evidence.fingerprint(table(spark, d, "evidence"))


@R.add(
    "busiest_components",
    f"""with {_T}, {_CUT}, {_NOW} select repo_id, component_id, n as commits, added + deleted as churn, authors from n
order by commits desc, repo_id, component_id limit 10""",
)
def busiest_components(spark: SparkSession, d: str) -> DataFrame:
    """The ten components with the most commits; the limit is the report."""
    t = table(spark, d, "touches")
    a = history.activity_at(t, history.snapshot_cutoffs(t))
    a = a.select("repo_id", "component_id", F.col("historical_commit_count").alias("commits"), F.col("total_churn").alias("churn"), F.col("unique_contributors").alias("authors"))
    return a.orderBy(F.desc("commits"), "repo_id", "component_id").limit(10)


@R.add(
    "pipeline_stats",
    f"""with {_T}, {_SCOPE}, a as (select repo_id, count(*) as components from s group by 1),
b as (select repo_id, count(distinct sha) as commits, count(distinct component_id) as ever from t group by 1),
c as (select repo_id, count(distinct component_id) as with_history from t semi join s using (repo_id, component_id) group by 1)
select repo_id, coalesce(components, 0) as components, coalesce(commits, 0) as commits, coalesce(ever, 0) as components_ever, coalesce(with_history, 0) as with_history
from a full join b using (repo_id) left join c using (repo_id)""",
)
def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    """Components, commits and components with history of each repository."""
    t = history.clean_touches(table(spark, d, "touches"))
    pairs, shas = t.select("repo_id", "component_id").distinct(), t.select("repo_id", "sha").distinct()
    scope = _scope(spark, d)
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    out = count(scope, "components").join(count(shas, "commits"), "repo_id", "full").join(count(pairs, "components_ever"), "repo_id", "full")
    return out.join(count(pairs.join(scope, ["repo_id", "component_id"], "left_semi"), "with_history"), "repo_id", "left").fillna(0)


# -- paths and configuration -----------------------------------------------------------------------------------------

_MODULE = " ".join(f"when instr(path, '/{r}') > 1 then left(path, instr(path, '/{r}') - 1)" for r in paths.SOURCE_ROOTS)
_PATHS = "p as (select distinct path from file_changes where path is not null union select distinct f.path from (select unnest(provenance.files) as f from evidence) where f.path is not null)"


@R.add(
    "path_functions",
    f"""with {_PATHS} select path,
  {_COMPONENT} as component_id,
  case {_MODULE} end as module, starts_with(path, 'src/test/') or contains(path, '/src/test/') as is_test from p""",
)
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """What a path says of component, module and test code."""
    return _all_paths(spark, d).select("path", paths.component_of_path("path").alias("component_id"), paths.module_of_path("path").alias("module"), paths.is_test_path("path").alias("is_test"))


def _all_paths(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "evidence").select(F.explode("provenance.files.path").alias("path"))
    return table(spark, d, "file_changes").select("path").unionByName(listed).where("path is not null").distinct()


_SUFFIX = "regexp_extract(path, '[^/](\\.[^./]+)$', 1)"
_CATEGORY = f"""case when (contains('/' || path, '/META-INF/services/') or {_SUFFIX} in ({", ".join(f"'{s}'" for s in paths.CONFIG_SUFFIXES)}))
  and not ({_SUFFIX} = '.kts' and not ends_with(path, '.gradle.kts')) and not regexp_matches(path, '{paths.IGNORED}')
  then case when regexp_matches(path, '{paths.BUILD}') then 'BUILD' when regexp_matches(path, '{paths.TEST}') then 'TEST' when regexp_matches(path, '{paths.RUNTIME}') then 'RUNTIME' end end"""


@R.add("config_paths", f"with {_PATHS} select path, {_CATEGORY} as category from p")
def config_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which paths are configuration, and of what kind."""
    return _all_paths(spark, d).select("path", paths.config_category("path").alias("category"))


_BEAN = "case when regexp_matches(simple, '^(\\p{Lu}[^\\p{Ll}\\p{Lt}]|[^\\p{Ll}\\p{Lt}]\\p{Lu})') then simple else lower(left(simple, 1)) || simple[2:] end"


@R.add(
    "component_names",
    f"""with n as (select distinct component_id, regexp_extract(component_id, '[^.]*$') as simple from components)
select component_id, regexp_replace(regexp_extract(component_id, '^((?:[^.\\p{{Lu}}][^.]*\\.?)*)', 1), '\\.$', '') as package, {_BEAN} as bean from n""",
)
def component_names(spark: SparkSession, d: str) -> DataFrame:
    """Package and default bean name of every component."""
    n = table(spark, d, "components").select("component_id").distinct()
    return n.select("component_id", text.package_of("component_id").alias("package"), text.bean_name(F.regexp_extract("component_id", "[^.]*$", 0)).alias("bean"))


def config_files(spark: SparkSession, d: str) -> DataFrame:
    """Configuration texts among the documents as files: repo_id, path (made from the look of the text), text."""
    t = F.col("text")
    folder = F.when(F.col("doc_id") % 7 == 0, "src/test/resources/").otherwise("src/main/resources/")
    end = F.when(t.startswith("<"), ".xml").when(t.rlike(r"\A\w+:\s*\n"), ".yml").otherwise(".properties")
    docs = table(spark, d, "documents").where("source = 'config_file' and text is not null and repo_id is not null")
    return docs.select("repo_id", F.concat(folder, F.lit("c"), F.col("doc_id").cast("string"), end).alias("path"), "text").distinct()


_FILES = r"""
cf as (select distinct repo_id, case when doc_id % 7 = 0 then 'src/test/resources/' else 'src/main/resources/' end || 'c' || doc_id
    || case when starts_with(text, '<') then '.xml' when regexp_matches(text, '^[0-9A-Za-z_]+:\s*\n') then '.yml' else '.properties' end as path, text
  from documents where source = 'config_file' and text is not null and repo_id is not null)
"""
_LINES = r"""
xm as (select repo_id, path, regexp_replace(text, '<!--[^\n]*?-->', '', 'g') as text from cf where ends_with(path, '.xml')
  union all select repo_id, path, text from cf where not ends_with(path, '.xml')),
sp as (select repo_id, path, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]') as ls from xm),
l0 as (select repo_id, path, unnest(ls) as l, generate_subscripts(ls, 1) as line from sp),
l1 as (select repo_id, path, line, case when ends_with(path, '.xml') then l when regexp_matches(l, '^\s*[#!]') then ''
    when ends_with(path, '.yml') and contains(l, ' #') then left(l, instr(l, ' #') - 1) else l end as l from l0)
"""
_TOKENS = r"""
tk as (select repo_id, path, line, unnest(regexp_extract_all(l, '(?:^|[^\p{L}\p{N}_$.])((?:[a-z_][a-z0-9_]*\.)+[A-Z][\p{L}\p{N}_$]*(?:\.[A-Z][\p{L}\p{N}_$]*)*)', 1)) as token, 'CLASS_NAME' as kind from l1
  union all select repo_id, path, line, unnest(regexp_extract_all(l, '(?:^|[^\p{L}\p{N}_-])(?:[\p{L}\p{N}_:.-]*-ref|ref|bean|depends-on)\s*=\s*"([A-Za-z_][\p{L}\p{N}_]*)"', 1)), 'BEAN_REFERENCE'
    from l1 where ends_with(path, '.xml'))
"""


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Configuration files and the references in them, as one row per place and name."""
    files = config.classify(config_files(spark, d))
    found = config.resolve(config.tokens(files, ["repo_id"]), table(spark, d, "components"), ["repo_id"])
    return files, config.references(found, ["repo_id"]).join(files.select("repo_id", "path", "category"), ["repo_id", "path"])


@R.add(
    "stripped_config",
    f"with {_FILES}, {_LINES} select repo_id, path, count(*) as lines, count(*) filter (where trim(l) <> '') as kept, sum(length(l))::bigint as chars from l1 group by 1, 2",
)
def stripped_config(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters of configuration files that are left without comments."""
    ls = F.split(text.strip_comments("path", "text"), text.LINE_END)
    f = config_files(spark, d).select("repo_id", "path", ls.alias("ls"))
    size = lambda s, x: s + F.length(x).cast("bigint")
    return f.select("repo_id", "path", F.size("ls").cast("bigint").alias("lines"), F.size(F.filter("ls", lambda x: F.trim(x) != "")).cast("bigint").alias("kept"), F.aggregate("ls", F.lit(0).cast("bigint"), size).alias("chars"))


@R.add("config_tokens", f"with {_FILES}, {_LINES}, {_TOKENS} select repo_id, path, line, kind, token, count(*) as n from tk group by 1, 2, 3, 4, 5")
def config_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Class and bean names in configuration."""
    t = config.tokens(config.classify(config_files(spark, d)), ["repo_id"])
    return t.groupBy("repo_id", "path", F.col("line").cast("bigint").alias("line"), "kind", "token").agg(F.count(F.lit(1)).alias("n"))


_RESOLVED = r"""
co as (select distinct repo_id, component_id, regexp_extract(component_id, '[^.]*$') as simple from components),
pk as (select distinct repo_id, regexp_replace(regexp_extract(component_id, '^((?:[^.\p{Lu}][^.]*\.?)*)', 1), '\.$', '') as package from co),
be as (select repo_id, """ + _BEAN + r""" as token, min(component_id) as component_id from co group by 1, 2 having count(*) = 1),
tn as (select distinct repo_id, token, string_split(string_split(token, '$')[1], '.') as ps, regexp_replace(regexp_extract(token, '^((?:[^.\p{Lu}][^.]*\.?)*)', 1), '\.$', '') as package
  from tk where kind = 'CLASS_NAME'),
tr as (select repo_id, token, ps, unnest(generate_series(2, len(ps))) as n from tn),
hit as (select tr.repo_id, tr.token, arg_max(component_id, n) as component_id from tr join co on co.repo_id = tr.repo_id and co.component_id = array_to_string(ps[1:n], '.')
  where len(list_filter(ps[n:], lambda x: not regexp_matches(x, '^\p{Lu}'))) = 0 group by 1, 2),
ours as (select distinct tn.repo_id, tn.token from tn join pk on tn.repo_id = pk.repo_id and pk.package <> '' and (tn.package = pk.package or starts_with(tn.package, pk.package || '.'))),
rf as (select distinct tk.repo_id, tk.path, tk.line, tk.kind, tk.token, coalesce(hit.component_id, be.component_id) as component_id,
    case when coalesce(hit.component_id, be.component_id) is not null then 'RESOLVED' when ours.token is not null then 'UNRESOLVED' else 'EXTERNAL' end as resolution
  from tk left join hit on kind = 'CLASS_NAME' and hit.repo_id = tk.repo_id and hit.token = tk.token
  left join be on kind = 'BEAN_REFERENCE' and be.repo_id = tk.repo_id and be.token = tk.token
  left join ours on kind = 'CLASS_NAME' and ours.repo_id = tk.repo_id and ours.token = tk.token)
"""


@R.add("config_references", f"with {_FILES}, {_LINES}, {_TOKENS}, {_RESOLVED} select * from rf")
def config_references(spark: SparkSession, d: str) -> DataFrame:
    """Names in configuration and the components that they mean."""
    return _references(spark, d)[1].select("repo_id", "path", F.col("line").cast("bigint").alias("line"), "kind", "token", "component_id", "resolution")


@R.add(
    "config_misses",
    f"""with {_FILES}, {_LINES}, {_TOKENS}, {_RESOLVED},
sn as (select repo_id, component_id, simple as name from co where length(simple) >= 4 union select repo_id, component_id, {_BEAN} from co where length(simple) >= 4),
ws as (select repo_id, path, line, unnest(list_distinct(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}_]+'))) as name from l1),
hits as (select ws.repo_id, ws.path, ws.line, sn.component_id, min(ws.name) as name from ws join sn using (repo_id, name) group by 1, 2, 3, 4)
select hits.* from hits anti join (select * from rf where resolution = 'RESOLVED') r on hits.repo_id = r.repo_id and hits.path = r.path and hits.line = r.line and hits.component_id = r.component_id""",
)
def config_misses(spark: SparkSession, d: str) -> DataFrame:
    """Places in configuration that hold a component's simple or bean name without a reference to it being reported there."""
    return config.misses(config.classify(config_files(spark, d)), table(spark, d, "components"), _references(spark, d)[1], ["repo_id"]).withColumn("line", F.col("line").cast("bigint"))


@R.add(
    "config_counts",
    f"""with {_FILES}, {_LINES}, {_TOKENS}, {_RESOLVED}, ct as (select repo_id, path, {_CATEGORY} as category from cf)
select repo_id, 'files_scanned' as what, category as name, count(*) as n from ct where category is not null group by 1, 2, 3
union all select repo_id, 'references', resolution, count(*) from rf group by 1, 2, 3
union all select rf.repo_id, 'resolved_by_category', category, count(*) from rf join ct using (repo_id, path) where resolution = 'RESOLVED' group by 1, 2, 3""",
)
def config_counts(spark: SparkSession, d: str) -> DataFrame:
    """Configuration files by category and references by resolution."""
    files, refs = _references(spark, d)
    return config.scan_counts(files, refs, ["repo_id"])


@R.add(
    "config_evidence",
    f"""with {_T}, {_CUT}, {_SCOPE}, {_FILES}, {_LINES}, {_TOKENS}, {_RESOLVED}, ct as (select repo_id, path, {_CATEGORY} as category from cf),
sc as (select s.*, as_of from s join k using (repo_id)),
pl as (select distinct rf.repo_id, rf.component_id, rf.path, rf.line, category from rf join ct using (repo_id, path) where resolution = 'RESOLVED'),
ev as (select sc.repo_id, sc.component_id, sc.snapshot, as_of, 'config_reference' as evidence_type, category as str, null::double as num, path || ':' || line as spot from sc join pl using (repo_id, component_id)
  union all select sc.repo_id, sc.component_id, sc.snapshot, as_of, 'config_reference_count', null, count(distinct (path, line)) filter (where category = 'RUNTIME')::double, null
    from sc left join pl using (repo_id, component_id) group by 1, 2, 3, 4)
select 'ev_' || left(sha1(concat_ws('|', repo_id, snapshot, component_id, 'CONFIG', evidence_type, {_ISO("as_of")}, '', '') || case when evidence_type = 'config_reference' then '|' || spot else '' end), 16) as evidence_id,
  repo_id, component_id, evidence_type, str, num from ev""",
)
def config_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows from configuration for every component."""
    t = table(spark, d, "touches")
    e = config.config_evidence(_references(spark, d)[1], _scope(spark, d), history.snapshot_cutoffs(t))
    return e.select("evidence_id", "repo_id", "component_id", "evidence_type", F.col("value.str").alias("str"), F.col("value.num").alias("num"))


@R.add("snapshot_features")
def snapshot_features(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors of all components from our own evidence, git and configuration together."""
    t = table(spark, d, "touches")
    c = config.config_evidence(_references(spark, d)[1], _scope(spark, d), history.snapshot_cutoffs(t))
    return evidence.to_vector(evidence.features(_git_evidence(spark, d).unionByName(c), ["repo_id", "component_id", "snapshot"]))
