"""How often two items occur in the same basket, kept up to date by signed deltas.

Items and baskets go by numbers made from their names; a dictionary translates items back. The state of a count is four
tables in the shared folder: what each basket holds, how many baskets hold each pair, how many hold each item, and how
many baskets a scope has. Baskets and pairs lie in hash buckets, as many as the first batch's size asks for. A batch
brings the new content of changed baskets. Their old content leaves with minus one, the new content enters with plus
one; the net deltas are merged into the buckets that they fall into. Then only the pairs that a batch can have moved
are scored again.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.plans.storage import cut
from loamline.sources.tables import micros

#: Pairs of the first batch, and baskets, that make another bucket.
PAIRS_PER_BUCKET = 1 << 20
BASKETS_PER_BUCKET = 1 << 18
#: Buckets up to which a batch's touched ones are listed, so that others stay as they are; beyond, all are rewritten.
LISTED_BUCKETS = 100_000
BASKET = ["scope", "b1", "b2"]


def dictionary(components: DataFrame, seed: int = 0) -> DataFrame:
    """(id, c, scope, repo_id, module, component_id): the numbers of components in each of their modules.

    c numbers the component of a repository, scope the repository and module, id all three; a null module is a module.
    Two names under one number are an error; another seed gives other numbers. Null names have none.
    """
    d = components.where("repo_id is not null and component_id is not null").select("repo_id", "module", "component_id").distinct()
    module = F.coalesce(F.concat(F.lit("="), "module"), F.lit(""))
    d = d.select(
        F.xxhash64(F.lit(seed), "repo_id", module, "component_id").alias("id"),
        F.xxhash64(F.lit(seed), "repo_id", "component_id").alias("c"),
        F.xxhash64(F.lit(seed), "repo_id", module).alias("scope"),
        "repo_id",
        "module",
        "component_id",
    )
    return cut(d, "dictionary")


def _clash(names: DataFrame, number: str, *of: str) -> DataFrame:
    """Numbers that stand for more than one name."""
    return names.groupBy(number).agg(F.min(F.struct(*of)).alias("low"), F.max(F.struct(*of)).alias("high")).where("not low <=> high")


def check_dictionary(names: DataFrame) -> None:
    """Raise if two names share a number; one yes or no comes back."""
    whole = _clash(names, "id", "repo_id", "module", "component_id").select("id")
    whole = whole.unionByName(_clash(names, "c", "repo_id", "component_id").select(F.col("c").alias("id")))
    if not whole.unionByName(_clash(names, "scope", "repo_id", "module").select(F.col("scope").alias("id"))).isEmpty():
        raise ValueError("two items have the same number: take another seed")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _signed_pairs(baskets: DataFrame, buckets: int) -> DataFrame:
    """(bucket, a, b, n): net change of each pair of item numbers, a < b. A basket is worked off item by item."""
    first = baskets.select("sign", F.array_sort("ids").alias("ids")).select("sign", "ids", F.posexplode("ids").alias("_i", "a"))
    both = first.select("sign", "a", F.explode(F.expr("slice(ids, _i + 2, size(ids))")).alias("b"))
    return both.groupBy(_bucket(["a", "b"], buckets).alias("bucket"), "a", "b").agg(F.sum("sign").alias("n")).where("n <> 0")


def _placed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """Write rows by bucket, each bucket by one task."""
    return cut(df.repartitionById(buckets, F.col("bucket")), name, by="bucket", placed=True)


def _touched(df: DataFrame, buckets: int) -> list[int] | None:
    """The buckets that rows fall into, if there are few enough to list."""
    return [r[0] for r in df.select("bucket").distinct().collect()] if buckets <= LISTED_BUCKETS else None


def _inside(state: DataFrame, touched: list[int] | None) -> tuple[DataFrame, DataFrame | None]:
    """The part of a state that lies in the touched buckets, and the rest, which stays as it is."""
    if touched is None:
        return state, None
    at = F.col("bucket").isin(touched)
    return state.where(at), state.where(~at)


@dataclass(frozen=True)
class PairCounts:
    """A version of the state; apply() gives the next one and leaves this one readable."""

    baskets: DataFrame | None = None  # bucket, scope, b1, b2, ids
    pairs: DataFrame | None = None  # bucket, a, b, n
    items: DataFrame | None = None  # id, scope, n
    totals: DataFrame | None = None  # scope, n
    moved: DataFrame | None = None  # id: items of which some score may differ from the version before
    buckets: tuple[int, int] = (1, 1)  # of baskets and pairs

    def apply(self, batch: DataFrame) -> "PairCounts":
        """batch (scope, b1, b2, ids): the whole new content of changed baskets; no ids: the basket is gone.

        Ids are distinct and a basket comes once. Baskets that come as they are already change nothing.
        """
        none = F.array().cast("array<bigint>")
        batch = batch.select(*BASKET, F.array_sort(F.coalesce("ids", none)).alias("ids"))
        keys, outside = ["bucket", *BASKET], None
        if self.baskets is None:
            size = F.size("ids").cast("bigint")
            n, p = batch.agg(F.count(F.lit(1)), F.sum(F.floor(size * (size - 1) / 2))).first()
            buckets = (max(1, -(-n // BASKETS_PER_BUCKET)), max(1, -(-(p or 0) // PAIRS_PER_BUCKET)))
            now = _placed(batch.where(F.size("ids") > 0).select(_bucket(BASKET, buckets[0]).alias("bucket"), "*"), buckets[0], "baskets")
            signed = now.withColumn("sign", F.lit(1))
        else:
            buckets = self.buckets
            new = cut(batch.select(_bucket(BASKET, buckets[0]).alias("bucket"), "*"), "batch")
            inside, outside = _inside(self.baskets, _touched(new, buckets[0]))
            both = inside.withColumnRenamed("ids", "_old").join(new.withColumnRenamed("ids", "_new"), keys, "full")
            both = cut(both.withColumns({"_new": F.coalesce("_new", "_old"), "_old": F.coalesce("_old", none)}), "both")
            sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("_old").alias("ids")), F.struct(F.lit(1).alias("sign"), F.col("_new").alias("ids")))
            signed = both.where("_old <> _new").select(*BASKET, F.explode(sides).alias("_s")).select(*BASKET, "_s.sign", "_s.ids").where(F.size("ids") > 0)
            now = _placed(both.select(*keys, F.col("_new").alias("ids")).where(F.size("ids") > 0), buckets[0], "baskets")
        return self._merged(signed, now if outside is None else outside.unionByName(now), buckets)

    def _merged(self, signed: DataFrame, baskets: DataFrame, buckets: tuple[int, int]) -> "PairCounts":
        pairs, outside = _signed_pairs(signed, buckets[1]), None
        if self.pairs is not None:
            pairs = cut(pairs, "pair-deltas")
            inside, outside = _inside(self.pairs, _touched(pairs, buckets[1]))
            pairs = inside.unionByName(pairs).repartitionById(buckets[1], F.col("bucket")).groupBy("bucket", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        pairs = _placed(pairs, buckets[1], "pairs")
        pairs = pairs if outside is None else outside.unionByName(pairs)

        items = cut(signed.select("scope", "sign", F.explode("ids").alias("id")).groupBy("id", "scope").agg(F.sum("sign").alias("n")), "item-deltas")
        totals = cut(signed.groupBy("scope").agg(F.sum("sign").alias("n")), "total-deltas")
        moved = items.select("id")  # items of changed baskets; where the number of baskets differs, all of the scope
        if self.items is not None and self.totals is not None:
            grown = totals.where("n <> 0").select("scope")
            moved = moved.unionByName(self.items.join(grown, "scope", "left_semi").select("id")).distinct()
            items = cut(self.items.unionByName(items).groupBy("id", "scope").agg(F.sum("n").alias("n")).where("n <> 0"), "items")
            totals = cut(self.totals.unionByName(totals).groupBy("scope").agg(F.sum("n").alias("n")).where("n <> 0"), "totals")
        return PairCounts(baskets, pairs, items, totals, cut(moved, "moved"), buckets)

    def scores(self, least_pairs: int = 1, only_moved: bool = False) -> DataFrame:
        """(scope, a, b, n_ab, n_a, n_b, n, lift), a and b item numbers: lift is n_ab * n / (n_a * n_b).

        only_moved: just the pairs that the last batch can have moved. Hot items make skewed joins, which Spark splits
        at run time (adaptive execution), as the items' side has one row per item.
        """
        p = self.pairs.where(F.col("n") >= least_pairs).select("a", "b", F.col("n").alias("n_ab"))
        side = self.items.join(self.totals.withColumnRenamed("n", "_all"), "scope")
        if only_moved:
            side = side.join(self.moved.withColumn("_moved", F.lit(True)), "id", "left")
        else:
            side = side.withColumn("_moved", F.lit(True))
        p = p.join(side.select(F.col("id").alias("a"), "scope", F.col("n").alias("n_a"), F.col("_all").alias("n"), F.col("_moved").alias("_ma")), "a")
        p = p.join(side.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("_moved").alias("_mb")), "b")
        p = p.where("_ma or _mb")
        return p.select("scope", "a", "b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"))

    def rescored(self, before: DataFrame, least_pairs: int = 1) -> DataFrame:
        """The scores of this version from those of the version before: moved pairs are scored again, all others kept."""
        kept = before
        for side in ("a", "b"):
            kept = kept.join(self.moved.withColumnRenamed("id", side), side, "left_anti")
        return kept.select(before.columns).unionByName(self.scores(least_pairs, only_moved=True))


def named(scores: DataFrame, names: DataFrame) -> DataFrame:
    """scores with repo_id, module, a and b as names, a < b by name, in place of numbers."""
    of = lambda side: names.select(F.col("id").alias(side), F.col("component_id").alias(f"_{side}"))
    s = scores.join(names.select(F.col("id").alias("a"), "repo_id", "module", F.col("component_id").alias("_a")), "a").join(of("b"), "b")
    first = F.col("_a") < F.col("_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return s.select("repo_id", "module", pick("_a", "_b").alias("a"), pick("_b", "_a").alias("b"), "n_ab", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n", "lift")


def commit_baskets(touches: DataFrame, names: DataFrame, seed: int = 0) -> DataFrame:
    """(scope, b1, b2, own, ids, t): per commit and module the components that its non-bulk touches name.

    own are those that have a touch themselves, ids also those that only partner lists name. Repeats and nulls don't
    count, nor do names that the dictionary lacks. A null is_bulk is not false, so such touches are left out. t is the
    latest time of the touches in microseconds, null if none has one. A commit goes by 128 bits of its repository and sha.
    """
    t = touches.where("is_bulk = false and repo_id is not null and sha is not null")
    own = F.when(F.col("component_id").isNotNull(), F.array(F.struct(F.col("component_id").alias("x"), F.lit(True).alias("own"))))
    of = F.transform(F.array_compact(F.coalesce("partners", F.array().cast("array<string>"))), lambda x: F.struct(x.alias("x"), F.lit(False).alias("own")))
    none = F.array().cast("array<struct<x: string, own: boolean>>")
    each = t.select("repo_id", F.xxhash64("repo_id", "sha").alias("b1"), F.xxhash64(F.lit("second"), "repo_id", "sha").alias("b2"), micros("ts").alias("t"), F.explode(F.concat(F.coalesce(own, none), of)).alias("_x"))
    each = each.select("b1", "b2", "t", F.xxhash64(F.lit(seed), "repo_id", "_x.x").alias("c"), "_x.own")
    members = each.groupBy("b1", "b2", "c").agg(F.max("t").alias("t"), F.max("own").alias("own"))
    d = members.join(names.select("c", "id", "scope"), "c").groupBy(*BASKET).agg(F.collect_list(F.struct("id", "own")).alias("_m"), F.max("t").alias("t"))
    return d.select(*BASKET, F.filter("_m", lambda m: m["own"])["id"].alias("own"), F.col("_m.id").alias("ids"), "t")
