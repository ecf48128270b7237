"""Registered queries of the training-data operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import cooccurrence, encoding, mixing, splits, tokens
from loamline.plans.registry import Registry
from loamline.plans.storage import cut
from loamline.sources.tables import table

R = Registry()

# -- 1: splits that keep related records together -------------------------------------------------------------------

_P1 = r"""
with recursive raw as (select distinct case_id, repo_id, target_component_id,
    lower(trim(repo_id)) || chr(10) || split_part(replace(target_component_id, '/', '.'), '$', 1) as node from cases),
p as (select lower(trim(repo_id)) as r, regexp_extract(old_path, '(?:^|/)src/(?:main|test)/java/(.+)\.java$', 1) as x,
    regexp_extract(path, '(?:^|/)src/(?:main|test)/java/(.+)\.java$', 1) as y from file_changes where old_path is not null),
e as (select distinct r || chr(10) || replace(x, '/', '.') as u, r || chr(10) || replace(y, '/', '.') as v from p
  where x <> '' and y <> '' and not regexp_matches(x, '(^|/)package-info$') and not regexp_matches(y, '(^|/)package-info$') and x <> y),
both_ways as (select u, v from e union select v, u from e),
reach as (select u, u as v from both_ways union select r.u, b.v from reach r join both_ways b on r.v = b.u),
label as (select u, min(v) as label from reach group by 1),
g as (select raw.*, coalesce(label, node) as grp from raw left join label on node = u)
"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "cases"), table(spark, d, "file_changes"))


@R.add(
    "p1_found",
    _P1
    + """, h as (select case_id, min(case_id) over (partition by grp) as group_case_id, grp,
    min((repo_id, target_component_id)) over (partition by grp) as a, max((repo_id, target_component_id)) over (partition by grp) as b from g)
select distinct case_id, group_case_id from h where a <> b""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose group goes by more than one raw name."""
    return _assigned(spark, d).where("several_spellings").select("case_id", "group_case_id").distinct()


@R.add("p1_splits")
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every case with its group, bin and split; how bins are filled can't be put in SQL."""
    return _assigned(spark, d).drop("several_spellings").distinct()


@R.add("p1_shares")
def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of cases that each split reached."""
    return splits.split_shares(_assigned(spark, d))


# -- 2: items that appear together ----------------------------------------------------------------------------------

_P2 = """
with t as (select repo_id, sha, component_id, partners from touches where is_bulk = false),
m as (select repo_id, sha, component_id as c from t union select repo_id, sha, unnest(partners) from t),
k as (select distinct repo_id, component_id, module from components),
b as (select distinct m.repo_id, module, sha, c from m join k on m.repo_id = k.repo_id and m.c = k.component_id),
n as (select repo_id, module, count(distinct sha) as n from b group by 1, 2),
i as (select repo_id, module, c, count(*) as n from b group by 1, 2, 3),
p as (select x.repo_id, x.module, x.c as a, y.c as b, count(*) as n from b x join b y
  on x.repo_id = y.repo_id and x.module is not distinct from y.module and x.sha = y.sha and x.c < y.c group by 1, 2, 3, 4),
s as (select p.repo_id, p.module, p.a, p.b, p.n as n_ab, ia.n as n_a, ib.n as n_b, n.n as n from p
  join i ia on ia.repo_id = p.repo_id and ia.module is not distinct from p.module and ia.c = p.a
  join i ib on ib.repo_id = p.repo_id and ib.module is not distinct from p.module and ib.c = p.b
  join n on n.repo_id = p.repo_id and n.module is not distinct from p.module)
"""


def _pair_scores(spark: SparkSession, d: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Scores by numbers, and the dictionary. Commits are counted as their own touches tell them; what only partner lists name comes as a
    second batch, which changes the baskets that it adds to."""
    names = cooccurrence.dictionary(table(spark, d, "components"))
    cooccurrence.check_dictionary(names)
    baskets = cut(cooccurrence.commit_baskets(table(spark, d, "touches"), names), "all-baskets")
    key = cooccurrence.BASKET
    state = cooccurrence.PairCounts().apply(baskets.where(F.size("own") > 0).select(*key, F.col("own").alias("ids")))
    before = cut(state.scores(least), "scores")
    state = state.apply(baskets.where(F.size("own") < F.size("ids")).select(*key, "ids"))
    return state.rescored(before, least), names


@R.add("p2_found", _P2 + "select distinct repo_id, a as component_a, b as component_b from s where n_ab >= 5 and n_ab * n >= 4 * n_a * n_b")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of components of a module that change together often and at least four times as often as by chance."""
    scores, names = _pair_scores(spark, d, 5)
    s = cooccurrence.named(scores.where("n_ab * n >= 4 * n_a * n_b"), names)
    return s.select("repo_id", F.col("a").alias("component_a"), F.col("b").alias("component_b")).distinct()


@R.add("p2_scores", _P2 + "select repo_id, module, a, b, n_ab, n_a, n_b, n, n_ab * n / (n_a * n_b) as lift from s")
def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every pair's counts and lift."""
    return cooccurrence.named(*_pair_scores(spark, d, 1))


# -- 8: encoding of the whole corpus --------------------------------------------------------------------------------


@R.add("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


# -- 9: mixing sources ----------------------------------------------------------------------------------------------


@R.add("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@R.add("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


# -- 10: garbled text -----------------------------------------------------------------------------------------------


@R.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold text read in the wrong encoding."""
    return encoding.repair(table(spark, d, "documents")).where("garbled").select("doc_id").distinct()


@R.add("p10_repaired")
def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the original text where it could be had."""
    return encoding.repair(table(spark, d, "documents")).where("garbled").select("doc_id", F.array_join("chains", ",").alias("chains"), "original", "lost")
