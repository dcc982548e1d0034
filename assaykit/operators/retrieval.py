"""Retrieval and vector scorers. Per-query lists are arrays of one row, so nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import vectors
from assaykit.functions.text import let, mean, pairs

MAX_RANK = 5


def chunk_precision(ratings: Column, threshold: float = 0.7) -> Column:
    """Share of ratings (0 to 10) of at least 10 * threshold; no ratings give 0."""
    return mean(F.transform(ratings, lambda r: (r >= 10 * threshold).cast("double")))


def chunk_recall(ratings: Column, estimated_total: Column, threshold: float = 0.7) -> Column:
    """Relevant over the greater of the estimated total and what was retrieved."""
    relevant = F.size(F.filter(ratings, lambda r: r >= 10 * threshold))
    whole = F.greatest(F.coalesce(estimated_total, F.size(ratings)), F.size(ratings))
    return F.coalesce(relevant / F.nullif(whole, F.lit(0)), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def rank_score(rank: Column) -> Column:
    return F.when(rank <= MAX_RANK, (MAX_RANK + 1 - rank) / float(MAX_RANK)).otherwise(0.0)


def _zip(rankings: Column, relevance: Column) -> Column:
    n = F.least(F.size(rankings), F.size(relevance))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(rankings, i).alias("rank"), F.get(relevance, i).cast("double").alias("rel"), rank_score(F.get(rankings, i)).alias("score"))))


def reciprocal_rank(rankings: Column, relevance: Column) -> Column:
    ranks = F.transform(F.filter(_zip(rankings, relevance), lambda x: x["rel"] > 0), lambda x: x["rank"])
    return F.coalesce(1.0 / F.nullif(F.array_min(ranks), F.lit(0)), F.lit(0.0))


def _sorted_items(relevance: Column, predicted: Column) -> Column:
    """(r, s) of every item, the greatest predicted score first."""
    items = F.transform(predicted, lambda s, i: F.struct((-s.cast("double")).alias("s"), F.coalesce(F.get(relevance, i).cast("double"), F.lit(0.0)).alias("r")))
    return F.array_sort(items)


def ndcg(relevance: Column, predicted: Column) -> Column:
    """Linear gain; items of equal predicted score share their mean gain. Fewer than two items, or no gain, give 0.

    One fold over the sorted items: `done` is the gain of finished groups of ties; of the open group it keeps
    the sum of gains, the sum of discounts and the size.
    """
    d = lambda k: 1.0 / F.log2(k + 1.0)
    close = lambda a: a["done"] + F.when(a["m"] > 0, a["gain"] / a["m"] * a["disc"]).otherwise(0.0)
    state = lambda done, gain, disc, m, k, last: F.struct(done.alias("done"), gain.alias("gain"), disc.alias("disc"), m.alias("m"), k.alias("k"), last.alias("last"))
    zero = state(*[F.lit(0.0)] * 5, F.lit(float("inf")))

    def step(a: Column, x: Column) -> Column:
        same, k = x["s"] == a["last"], a["k"] + 1.0
        keep = lambda v: F.when(same, v).otherwise(0.0)
        return state(F.when(same, a["done"]).otherwise(close(a)), keep(a["gain"]) + x["r"], keep(a["disc"]) + d(k), keep(a["m"]) + 1.0, k, x["s"])

    gain = F.aggregate(_sorted_items(relevance, predicted), zero, step, close)
    ideal = F.transform(F.reverse(F.array_sort(F.transform(relevance, lambda r: r.cast("double")))), lambda r, i: r / F.log2(i + 2.0))
    best = F.aggregate(ideal, F.lit(0.0), lambda s, x: s + x)
    return let(best, lambda b: F.when((F.size(predicted) > 1) & (b > 0), gain / b).otherwise(0.0))


def average_precision(relevance: Column, predicted: Column) -> Column:
    """Sum of recall steps times precision over distinct thresholds; 0 unless labels are all 0 or 1 and one is 1."""
    binary = F.forall(relevance, lambda r: r.cast("double").isin(0.0, 1.0))
    positives = F.size(F.filter(relevance, lambda r: r.cast("double") == 1.0))
    close = lambda a: a["sum"] + F.when(a["n"] > 0, a["open"] * (a["hits"] + a["open"]) / a["n"]).otherwise(0.0)
    state = lambda total, hits, open_, n, last: F.struct(total.alias("sum"), hits.alias("hits"), open_.alias("open"), n.alias("n"), last.alias("last"))
    zero = state(*[F.lit(0.0)] * 4, F.lit(float("inf")))

    def step(a: Column, x: Column) -> Column:
        same = x["s"] == a["last"]
        return state(
            F.when(same, a["sum"]).otherwise(close(a)), F.when(same, a["hits"]).otherwise(a["hits"] + a["open"]), F.when(same, a["open"]).otherwise(0.0) + x["r"], a["n"] + 1.0, x["s"]
        )

    total = F.aggregate(_sorted_items(relevance, predicted), zero, step, close)
    return let(positives, lambda p: F.when(binary & (p > 0), total / p).otherwise(0.0))


def ranking_scores(rankings: Column, relevance: Column) -> Column:
    """STRUCT<mrr, ndcg, map, avg_ranking, combined>; missing rankings give zeros, missing relevance counts as 1."""
    rel = F.coalesce(relevance, F.transform(rankings, lambda _: F.lit(1.0)))

    def lists(x: Column) -> Column:
        z = x["z"]
        return F.struct(x["k"].alias("k"), x["l"].alias("l"), F.transform(z, lambda y: y["rel"]).alias("labels"), F.transform(z, lambda y: y["score"]).alias("scores"))

    def scores(x: Column) -> Column:
        zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
        return F.struct(
            zero(reciprocal_rank(x["k"], x["l"]), "mrr"), zero(ndcg(x["labels"], x["scores"]), "ndcg"), zero(average_precision(x["labels"], x["scores"]), "map"),
            zero(mean(F.transform(x["k"], rank_score)), "avg_ranking"),
        )

    def combined(x: Column) -> Column:
        names = ("mrr", "ndcg", "map", "avg_ranking")
        return F.struct(*[x[n].alias(n) for n in names], ((x["mrr"] + x["ndcg"] + x["map"] + x["avg_ranking"]) / 4).alias("combined"))

    given = F.struct(rankings.alias("k"), rel.alias("l"), _zip(rankings, rel).alias("z"))
    return let(let(let(given, lists), scores), combined)


def semantic_similarity(query: Column, chunks: Column) -> Column:
    """Mean of the chunks' cosine with the query, moved to 0..1; no chunks give 0."""
    return mean(F.transform(chunks, lambda c: vectors.similarity(query, c)))


def embedding_diversity(chunks: Column) -> Column:
    """Mean distance of the pairs of one query's chunks; fewer than two give 0."""
    return mean(F.transform(pairs(chunks), lambda p: 1.0 - vectors.similarity(p["a"], p["b"])))


def group_diversity(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, diversity) over groups of any size without forming pairs.

    For unit vectors the mean cosine of all pairs is (|sum|^2 - n) / (n (n - 1)), so a group needs only the
    sum of its vectors, dimension by dimension, which partial aggregation reduces before the shuffle. Zero
    and null vectors are left out.
    """
    usable = df.where(vectors.norm(F.col(vector)) > 0).select(by, F.posexplode(vectors.unit(F.col(vector))).alias("dim", "x"))
    sums = usable.groupBy(by, "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    cosine = (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    out = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    return out.select(by, "n", F.when(F.col("n") > 1, 1 - (cosine + 1) / 2).otherwise(0.0).alias("diversity"))


# Fixed value: the order in which a scorer's result is searched for the number that stands for it.
PRIORITY = ("score", "aggregate", "average", "similarity", "f1", "combined", "diversity", "precision", "recall", "accuracy")


def main_metric(result: Column) -> Column:
    """The first of PRIORITY in a MAP<STRING, DOUBLE>, else 0."""
    return F.coalesce(*[F.try_element_at(result, F.lit(k)) for k in PRIORITY], F.lit(0.0))
