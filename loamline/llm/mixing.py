"""Mixing sources to target weights: hash thresholds found from nested histograms, without a sort.

Each document has a fixed hash. A source gives whole passes of all its documents and, for the rest of its budget, the
documents below a hash threshold. The threshold is narrowed down by histograms of tokens over hash buckets: one over
all documents, then finer ones over the bucket that the budget ends in. Choosing is then a filter.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.tokens import TOKENIZERS, encode
from loamline.plans.storage import cut

#: Bits of the 63-bit hash that each histogram resolves.
LEVELS = (15, 16, 16, 16)


def sized(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, h), written once; repeated rows count once."""
    counted = encode(documents.select("doc_id", "source", "text"), "text", tokenizers, counts_only=True)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 1)
    return cut(counted.where("doc_id is not null and source is not null").withColumn("h", h).distinct(), "sized")


def budgets(docs: DataFrame, targets: DataFrame) -> dict[str, tuple[int, int, int]]:
    """source -> (tokens there, whole passes, tokens still wanted).

    The total is the largest at which no source needs more than max_repeats passes. A listed source without tokens
    makes it zero unless its share is zero. The driver sees one row per listed source.
    """
    have = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = targets.select("source", "target_share", "max_repeats").distinct().join(have, "source", "left").fillna(0, ["tokens"]).collect()
    wanted = [r for r in rows if r["target_share"] and r["target_share"] > 0]
    total = min((r["max_repeats"] * r["tokens"] / r["target_share"] for r in wanted), default=0.0)
    out = {}
    for r in wanted:
        budget = min(int(r["target_share"] * total), r["max_repeats"] * r["tokens"])
        passes = min(budget // r["tokens"], r["max_repeats"]) if r["tokens"] else 0
        out[r["source"]] = (r["tokens"], passes, budget - passes * r["tokens"])
    return out


def thresholds(docs: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """source -> the greatest t for which the documents with h < t have at most the wanted tokens (2**63: all of them).

    Each level counts only documents in the boundary bucket of the level before. Documents of equal hash go together.
    """
    spark = docs.sparkSession
    low, left, done = dict.fromkeys(wanted, 0), dict(wanted), set()
    bits = 63
    for level in LEVELS:
        bits -= level
        open_ = {s: v for s, v in low.items() if s not in done}
        if not open_:
            break
        state = spark.createDataFrame([(s, v >> (bits + level), left[s]) for s, v in open_.items()], "source string, _at bigint, _left bigint")
        hist = (
            docs.join(F.broadcast(state), "source")
            .where(F.shiftright("h", bits + level) == F.col("_at"))
            .groupBy("source", "_left", F.shiftright("h", bits).alias("b"))
            .agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        )
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b"))  # at most 2**level rows per source
        edge = (
            hist.withColumn("upto", upto)
            .where("upto > _left")
            .groupBy("source")
            .agg(F.min(F.struct("b", F.expr("upto - n").alias("before"), "docs")).alias("e"))
            .collect()
        )
        crossed = {r["source"]: r["e"] for r in edge}
        for s in open_:
            if s not in crossed:  # the budget holds everything: can be at the first level only
                low[s] = 1 << 63
                done.add(s)
                continue
            e = crossed[s]
            low[s], left[s] = e["b"] << bits, left[s] - e["before"]
            if e["docs"] == 1:
                done.add(s)
    return low


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies) of the chosen documents; docs as made by sized().

    Sources that aren't listed and documents without tokens are never chosen. The tokens that a source falls short
    of its budget are fewer than those of one document (or of documents with equal hashes).
    """
    spark = docs.sparkSession
    docs = docs.where("tokens > 0")
    b = budgets(docs, targets)
    cuts = thresholds(docs, {s: rest for s, (_, _, rest) in b.items()})
    top = (1 << 63) - 1
    rows = [(s, b[s][1], min(cuts[s], top), cuts[s] > top and b[s][2] > 0) for s in b]
    policy = spark.createDataFrame(rows, "source string, _passes int, _below bigint, _all boolean")
    extra = (F.col("_all") | (F.col("h") < F.col("_below"))).cast("int")
    return docs.join(F.broadcast(policy), "source").select("doc_id", "source", "tokens", (F.col("_passes") + extra).alias("copies")).where("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) of each listed source."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # a row per listed source
    out = targets.select("source", "target_share").distinct().join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    return out.select(
        "source", "target_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_copies"
    )
