"""Metrics of model requests: latency, errors, tokens and cost, overall and by provider or model.

Input: latency, ttfb, tokens_input, tokens_output, cost, success, error_type, provider, model. One pass
with grouping sets gives all levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.session import cut, small_side

#: Width and number of latency buckets; the last bucket is open.
BUCKET_MS, BUCKETS = 100, 9


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


#: Measured column -> percentiles that are given of it.
MEASURED, QUANTILES = ("latency", "ttfb"), (0.5, 0.95, 0.99)


def metric_columns() -> list[Column]:
    """Aggregates of a group of requests, percentiles aside; an empty group gives zeros."""
    n = F.count(F.lit(1))
    both = F.col("tokens_input") + F.col("tokens_output")
    tokens, cost = F.sum(both), F.sum("cost")
    ok = F.count_if("success")
    return [
        n.alias("requests"), ok.alias("successes"), F.count_if(~F.col("success")).alias("errors"),
        _zero(100.0 * ok / F.nullif(n, F.lit(0))).alias("success_rate"), _zero(100.0 * F.count_if(~F.col("success")) / F.nullif(n, F.lit(0))).alias("error_rate"),
        _zero(F.avg("latency")).alias("latency_avg"), _zero(F.avg("ttfb")).alias("ttfb_avg"),
        _zero(tokens).cast("double").alias("tokens_total"), _zero(_zero(tokens) / F.nullif(n, F.lit(0))).alias("tokens_per_request"),
        _zero(F.avg("tokens_input")).alias("tokens_input_avg"), _zero(F.avg("tokens_output")).alias("tokens_output_avg"),
        _zero(cost).alias("cost_total"), _zero(F.avg("cost")).alias("cost_avg"), F.when(tokens > 0, _zero(cost) / tokens * 1000).otherwise(0.0).alias("cost_per_1k"),
    ]


def only(requests: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    """Requests of a provider and model; None or '' does not filter."""
    for name, value in (("provider", provider), ("model", model)):
        if value:
            requests = requests.where(F.col(name) == value)
    return requests


def _with_percentiles(metrics: DataFrame, requests: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """metrics (level, key, ...) with {column}_p{percent} of every MEASURED column; keys: level -> key column, null where a row is in no group.

    Every row counts once per level and column, in two passes of counts: no group's values are gathered.
    """
    groups = [F.struct(F.concat_ws("\0", F.lit(level), key.cast("string"), F.lit(c)).alias("k"), F.when(key.isNotNull(), F.col(c).cast("double")).alias("v")) for level, key in keys.items() for c in MEASURED]
    found = exact_percentiles(requests.select(F.inline(F.array(*groups))), "k", "v", QUANTILES)
    parts = F.split("k", "\0")
    name = F.concat(F.element_at(parts, -1), F.lit("_p"), F.round(F.col("q") * 100).cast("int").cast("string"))
    names = [f"{c}_p{round(q * 100)}" for c in MEASURED for q in QUANTILES]
    wide = found.groupBy(F.get(parts, 0).alias("_level"), F.get(parts, 1).alias("_key")).agg(*[F.max(F.when(name == n, F.col("value"))).alias(n) for n in names])
    joined = metrics.join(wide, (F.col("level") == F.col("_level")) & (F.col("key").cast("string") == F.col("_key")), "left")
    return joined.select(*metrics.columns, *[_zero(F.col(n)).alias(n) for n in names])


def request_metrics(requests: DataFrame, by: str | None = None) -> DataFrame:
    """Metrics of all requests (one row, zeros if there are none) or by a column, without null and empty keys."""
    if by is None:
        one = requests.agg(*metric_columns()).withColumn("level", F.lit("overall")).withColumn("key", F.lit("all"))
        return _with_percentiles(one, requests, {"overall": F.lit("all")}).drop("level", "key")
    grouped = requests.where(F.col(by) != "").groupBy(F.col(by).alias("key")).agg(*metric_columns()).withColumn("level", F.lit("key"))
    return _with_percentiles(grouped, requests, {"key": F.nullif(F.col(by), F.lit(""))}).withColumnRenamed("key", by).drop("level")


def metric_levels(requests: DataFrame) -> DataFrame:
    """(level, key, metrics): overall, by provider and by model in one pass, and two more for the percentiles."""
    provider, model = (F.nullif(c, F.lit("")) for c in ("provider", "model"))
    grouped = requests.select("*", provider.alias("_p"), model.alias("_m")).groupingSets([[], ["_p"], ["_m"]], "_p", "_m")
    out = grouped.agg(F.grouping("_p").alias("gp"), F.grouping("_m").alias("gm"), *metric_columns())
    level = F.when(F.col("gp") == 0, "provider").when(F.col("gm") == 0, "model").otherwise("overall")
    named = out.withColumn("level", level).withColumn("key", F.when(F.col("level") == "provider", F.col("_p")).when(F.col("level") == "model", F.col("_m")).otherwise("all"))
    return _with_percentiles(named.where("key is not null").drop("gp", "gm", "_p", "_m"), requests, {"overall": F.lit("all"), "provider": provider, "model": model})


def latency_histogram(requests: DataFrame, col: str = "latency") -> DataFrame:
    """(bucket, n): BUCKETS buckets of BUCKET_MS from 0, lower edge included, and an open one; empty buckets stay. Negative values are in none."""
    x = F.col(col)
    inside = [F.count_if((x >= i * BUCKET_MS) & (x < (i + 1) * BUCKET_MS)).alias(f"b{i}") for i in range(BUCKETS)]
    row = requests.agg(*inside, F.count_if(x >= BUCKETS * BUCKET_MS).alias(f"b{BUCKETS}"))
    names = [f"{i * BUCKET_MS}-{(i + 1) * BUCKET_MS}ms" for i in range(BUCKETS)] + [f"{BUCKETS * BUCKET_MS}ms+"]
    pairs = ", ".join(f"'{name}', b{i}" for i, name in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {pairs}) as (bucket, n)")


def error_breakdown(requests: DataFrame) -> DataFrame:
    """(error_type, n) of failed requests; null and empty types are `unknown`."""
    return requests.where(~F.col("success")).groupBy(F.coalesce(F.nullif("error_type", F.lit("")), F.lit("unknown")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """requests with `cost` by a table of rates (model, from_tokens, per_million_input, per_million_output): the tier
    with the greatest from_tokens that the input reaches. Unknown models cost 0. The tiers of a model are one array,
    so the join is by model alone and makes no more rows."""
    tiers = prices.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("from_tokens", "per_million_input", "per_million_output"))).alias("_tiers"))
    tier = F.try_element_at(F.filter("_tiers", lambda t: t["from_tokens"] <= F.coalesce("tokens_input", F.lit(0))), F.lit(-1))
    cost = (F.coalesce("tokens_input", F.lit(0)) * tier["per_million_input"] + F.coalesce("tokens_output", F.lit(0)) * tier["per_million_output"]) / 1e6
    return requests.drop("cost").join(tiers, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("_tiers")


def export_summary(requests: DataFrame) -> DataFrame:
    """One row: requests and how many providers and models they name; null and empty names are none."""
    name = lambda c: F.nullif(c, F.lit(""))
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_distinct(name("provider")).alias("unique_providers"), F.count_distinct(name("model")).alias("unique_models")
    )


def running_totals(requests: DataFrame, by: str = "model") -> DataFrame:
    """(by, requests, tokens, cost, errors): what a model has used so far, from its log."""
    tokens = F.coalesce("tokens_input", F.lit(0)) + F.coalesce("tokens_output", F.lit(0))
    return requests.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count_if(~F.col("success")).alias("errors")
    )


def plain_model_name(model: Column) -> Column:
    """A model's name without the size of its context."""
    return F.regexp_replace(model, r"-(?:4|8|16|32)k$", "")


def exact_percentiles(df: DataFrame, by: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """(by, q, value): interpolated percentiles of columns with any number of distinct values, in two passes.

    F.percentile keeps every distinct value of a group in memory. Here the first pass brackets each
    percentile by approximate ones, and the second counts what is below the bracket and the distinct values
    inside it, which are about 4 / accuracy of the rows. Null values and keys are left out.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    margin = 2.0 / accuracy
    edges = [e for q in quantiles for e in (max(0.0, q - margin), min(1.0, q + margin))]
    found = rows.groupBy(by).agg(F.percentile_approx("v", edges, accuracy).alias("e"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.array(*[
        F.struct(F.lit(q).alias("q"), F.when(F.lit(edges[2 * i]) <= 0, F.col("lo")).otherwise(F.col("e")[2 * i]).alias("low"), F.when(F.lit(edges[2 * i + 1]) >= 1, F.col("hi")).otherwise(F.col("e")[2 * i + 1]).alias("high"))
        for i, q in enumerate(quantiles)
    ])
    brackets = cut(found.select(F.col(by).alias("_k"), "n", F.inline(each)))
    joined = rows.join(small_side(brackets), F.col(by) == F.col("_k"))
    # What is below and above a bracket is counted as a whole; interpolation in a small group may need its nearest value.
    zone = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    counts = (
        joined.groupBy(by, "q", "n", zone.alias("zone"), F.when(zone == 0, F.col("v")).alias("inside"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        .withColumn("v", F.when(F.col("zone") < 0, F.col("most")).otherwise(F.col("least")))
    )
    upto = F.sum("c").over(W.partitionBy(by, "q").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    place = F.col("q") * (F.col("n") - 1)
    ranked = counts.withColumn("last", upto).withColumn("first", F.col("last") - F.col("c") + 1)
    at = lambda r: F.min(F.when((F.col("first") <= r + 1) & (F.col("last") >= r + 1), F.col("v")))
    out = ranked.groupBy(by, "q", "n").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    return out.select(by, "q", (F.col("a") + (place - F.floor(place)) * (F.col("b") - F.col("a"))).alias("value"))
