"""Mixing documents of several sources to target weights.

Every document has a membership: its recorded source, or where none is recorded the posteriors of a
classifier fitted on labelled documents. Nonnegative rates, at most the permitted repeats, are fitted by
distributed projected-gradient least squares so that the expected tokens of every source meet the mix's
targets. Rates are then rounded to whole repeats, source by source, to within a document's size.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.llm.linear import LinearModel, indices
from assaykit.llm.percentiles import order_key
from assaykit.session import cut, small_side

#: Vocabulary of a public tokenizer, as ranks; the default place is that of the test machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary is used with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The classifier is fitted on at most so many labelled documents, chosen by hash.
SAMPLE_DOCS = 8_000
#: Longer documents are classified but not fitted on.
SAMPLE_CHARS = 50_000
#: Stands for all sources that no mix has as a target. They are not used, so they need no column of their own.
OTHER = "\0other"
#: The gradient stops when no residual moves by more than this share of the mix's size; what is left after ROUNDS shows in expected_tokens.
TOLERANCE, ROUNDS = 2e-4, 30
SEED = 11


def source_key(c: Column) -> Column:
    """A source's name without differences of case, blanks, hyphens and underscores; null if it is blank."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_"), F.lit(""))


@lru_cache(maxsize=4)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def with_tokens(df: DataFrame, text_col: str, tokenizer: str = TOKENIZER, name: str = "tokens") -> DataFrame:
    """df with the number of tokens of a text; null texts have none. The vocabulary (under 2 MB) is sent to the executors."""
    with open(tokenizer, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks.value)
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int64")

    return df.withColumn(name, count(F.col(text_col)))


def text_features(text: str) -> list[str]:
    """Words, pairs of words and the shapes that lines begin with."""
    words = re.findall(r"[^\W\d_]+|\d+", text.lower())
    words = ["0" if w[0].isdigit() else w for w in words]
    f = ["bias", f"size={len(words).bit_length()}", f"lines={min(4, text.count(chr(10)))}"]
    f += ["w:" + w for w in set(words)] + ["p:" + " ".join(p) for p in set(zip(words, words[1:], strict=False))]
    f += ["l:" + re.sub(r"\d+", "0", line.strip()[:8].lower()) for line in set(text.split("\n")) if line.strip()]
    return f


def classify(base: DataFrame, docs: DataFrame, sources: list[str]) -> DataFrame:
    """(doc, tokens, posterior): an array of probabilities in the order of sources, for the rows of docs without source.

    base: (doc, text, source); docs: (doc, text, source, tokens), with texts where there is no source. Fitted on a
    bounded, hash-chosen sample of the rows of base that have a source; sources that are not listed are OTHER.
    """
    labelled = base.where(F.col("source").isNotNull() & F.length("text").between(1, SAMPLE_CHARS)).select("doc", "text", "source")
    share = max(1, labelled.count() // (3 * SAMPLE_DOCS))
    chosen = labelled.where(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0).orderBy(F.xxhash64("doc", F.lit(1))).limit(SAMPLE_DOCS)
    sample = chosen.select("text", "source").collect()
    place = {s: k for k, s in enumerate(sources)}
    rows = [indices(text_features(r["text"])) for r in sample]
    y = np.zeros((len(rows), len(sources)), dtype=np.float32)
    for i, r in enumerate(sample):
        y[i, place.get(r["source"], place[OTHER])] = 1
    model = LinearModel(len(sources))
    if rows:
        model.fit(rows, y, np.ones_like(y), SEED)
    shared = docs.sparkSession.sparkContext.broadcast((model, y.mean(axis=0) if rows else np.full(len(sources), 1 / max(1, len(sources)))))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, prior = shared.value
        for batch in batches:
            p = model.scores([indices(text_features(t if isinstance(t, str) else "")) for t in batch["text"]]) + 1e-6 * prior
            yield pd.DataFrame({"doc": batch["doc"], "tokens": batch["tokens"], "posterior": list((p / p.sum(axis=1, keepdims=True)).tolist())})

    return docs.where("source is null and tokens > 0").select("doc", "text", "tokens").mapInPandas(predict, "doc bigint, tokens bigint, posterior array<double>")


def _targets(targets: DataFrame, total: int, sources: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(mixes, target tokens by mix and source, repeats by mix and source). One row per mix and source is collected."""
    rows = targets.groupBy("mix", "source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats"), F.max("size").alias("size")).collect()
    mixes = sorted({r["mix"] for r in rows})
    weights, limits, sizes = np.zeros((len(mixes), len(sources))), np.full((len(mixes), len(sources)), np.inf), np.zeros(len(mixes))
    for r in rows:
        m, s = mixes.index(r["mix"]), sources.index(r["source"])
        weights[m, s] += max(0.0, r["share"] or 0.0)
        if r["repeats"] is not None:
            limits[m, s] = max(0, r["repeats"])
        sizes[m] = max(sizes[m], r["size"] or 0.0)
    sums = weights.sum(axis=1, keepdims=True)
    return mixes, np.divide(weights, sums, out=np.zeros_like(weights), where=sums > 0) * sizes[:, None] * total, limits


def fit_rates(units: DataFrame, mixes: list[str], target: np.ndarray, sources: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Projected-gradient least squares. units: (unit, tokens, p, limits): tokens, membership and limits by mix;
    returns units with `rates`, an array by mix, and the expected tokens by mix and source, whose difference from
    the target is the residual left.

    The step of a document along the gradient is scaled by its sources' total tokens, which makes rates equal
    within a source and the step length 1 safe. Each iteration is one aggregation that returns mixes x sources sums.
    """
    k, m = len(sources), len(mixes)
    sums = lambda df: np.array(
        df.agg(*[F.coalesce(F.sum(F.col("rates")[i] * F.col("tokens") * F.col("p")[j]), F.lit(0.0)) for i in range(m) for j in range(k)]).first(), dtype=float
    ).reshape(m, k)
    state = units.withColumn("rates", F.array(*[F.lit(1.0)] * m))
    whole = np.maximum(sums(state)[0] if m else np.ones(k), 1.0)
    state = state.withColumn("rates", F.array(*[F.lit(0.0)] * m))
    size = np.maximum(target.sum(axis=1, keepdims=True), 1.0)
    last = None
    for step in range(ROUNDS):
        residual = sums(state) - target
        if last is not None and np.abs((residual - last) / size).max(initial=0.0) < TOLERANCE:
            break  # residual is that of the rates as they are
        last = residual
        g = residual / whole
        move = lambda i: F.aggregate(F.zip_with("p", F.array(*[F.lit(float(x)) for x in g[i]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        state = state.withColumn("rates", F.array(*[F.least(F.col("limits")[i], F.greatest(F.lit(0.0), F.col("rates")[i] - move(i))) for i in range(m)]))
        if step % 4 == 3:
            state = cut(state)
    return state, target + residual


def mix(
    docs: DataFrame, targets: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of every mix in targets (mix_name, source, target_share, max_repeats, size_ratio).

    documents: (mix_name, doc_col, source, tokens, repeats), repeats > 0; source is the recorded one or the
    most probable. shares: (mix_name, source, target_tokens, target_share, actual_tokens, actual_share,
    expected_tokens, available_tokens, max_repeats), for the sources that some mix has as a target; expected_tokens
    are those that the fitted rates give a source by membership, so their distance from the target is the residual.
    Sources that no mix has as a target are not used and not listed, however many there are.

    Weights are taken relative to their sum. A source that cannot reach its target even when every document
    is used max_repeats times is used so often, and its share stays below; a source without documents has
    none. Sources without target are not used. Texts that are null or empty have no tokens and are not used;
    repeated documents count as different ones. Null repeats mean no limit.
    """
    want = targets.select(
        F.col("mix_name").alias("mix"), source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"),
        F.col("max_repeats").alias("repeats"), F.col("size_ratio").alias("size"),
    ).where("mix is not null and source is not null")
    base = docs.select(F.col(f"`{doc_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), source_key(F.col(f"`{source_col}`").cast("string")).alias("source"))
    counted = with_tokens(base, "text", tokenizer)
    # Tokenised once; only texts that must be classified are kept.
    sized = cut(counted.select("doc", "source", "tokens", F.when(F.col("source").isNull(), F.col("text")).alias("text")))
    names = want.select("source").distinct().collect()  # a row per source in the targets
    sources = [*sorted(r["source"] for r in names), OTHER]
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    mixes, target, limits = _targets(want, int(total), sources)
    if not mixes:
        spark = docs.sparkSession
        return (
            spark.createDataFrame([], f"mix_name string, {doc_col} bigint, source string, tokens bigint, repeats bigint"),
            spark.createDataFrame([], "mix_name string, source string, target_tokens double, target_share double, actual_tokens bigint, actual_share double, expected_tokens double, available_tokens bigint, max_repeats int"),
        )
    listed = F.when(F.col("source").isin(sources), F.col("source")).when(F.col("source").isNotNull(), OTHER)
    one_hot = F.transform(F.array(*[F.lit(s) for s in sources]), lambda s: (s == F.col("source")).cast("double"))
    limit_of = lambda place: F.array(*[F.element_at(F.array(*[F.lit(float(x)) for x in limits[i]]), place + 1) for i in range(len(mixes))])
    best = lambda p: F.array_position(p, F.array_max(p)).cast("int") - 1
    soft = cut(classify(base, sized, sources).withColumn("best", best(F.col("posterior"))).select("doc", F.lit(False).alias("whole"), F.col("tokens").cast("double"), F.col("posterior").alias("p"), "best"))
    # Documents of one source move alike: they are one unit, so that the iterations run over few rows.
    hard = (
        sized.where("source is not null and tokens > 0").groupBy(listed.alias("source")).agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("p", one_hot)
        .select(F.lit(None).cast("bigint").alias("doc"), F.lit(True).alias("whole"), "tokens", "p", best(F.col("p")).alias("best"))
    )
    units = cut(hard.unionByName(soft).withColumn("limits", limit_of(F.col("best"))))
    fitted, expected = fit_rates(units, mixes, target, sources)
    rated = cut(fitted)
    name_of = F.element_at(F.array(*[F.lit(s) for s in sources]), F.col("best") + 1)
    long = rated.select("doc", "whole", "tokens", name_of.alias("source"), F.posexplode("rates").alias("m", "rate"))
    mix_name = F.element_at(F.array(*[F.lit(x) for x in mixes]), F.col("m") + 1)
    by_source = long.where("whole").select("m", "source", "rate")
    by_doc = long.where("not whole").select("m", "doc", "source", F.col("tokens").cast("long").alias("tokens"), "rate")
    # Rates by source: one row per mix and source of the targets.
    each = sized.where("source is not null and tokens > 0").join(small_side(by_source), "source").select("m", "doc", "source", "tokens", "rate")
    each = each.unionByName(by_doc.where(F.col("source") != OTHER))
    used = _rounded(each).withColumn("mix_name", mix_name)
    documents = used.where("repeats > 0").select("mix_name", F.col("doc").alias(doc_col), "source", "tokens", "repeats")
    actual = documents.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"))
    available = each.groupBy("source").agg((F.sum("tokens") / max(1, len(mixes))).cast("long").alias("available_tokens"))
    rows = [
        (mixes[i], s, float(target[i, j]), float(target[i, j] / max(target[i].sum(), 1e-9)), float(expected[i, j]), None if np.isinf(limits[i, j]) else int(limits[i, j]))
        for i in range(len(mixes)) for j, s in enumerate(sources) if s != OTHER
    ]
    plan = docs.sparkSession.createDataFrame(rows, "mix_name string, source string, target_tokens double, target_share double, expected_tokens double, max_repeats int")
    shares = (
        plan.join(actual, ["mix_name", "source"], "left").join(available, "source", "left").na.fill(0, ["actual_tokens", "available_tokens"])
        .withColumn("actual_share", F.col("actual_tokens") / F.greatest(F.lit(1), F.sum("actual_tokens").over(W.partitionBy("mix_name"))))
        .select("mix_name", "source", "target_tokens", "target_share", "actual_tokens", "actual_share", "expected_tokens", "available_tokens", "max_repeats")
    )
    return documents, shares


def _rounded(each: DataFrame) -> DataFrame:
    """each (m, doc, source, tokens, rate) with whole `repeats`.

    Every document is used floor(rate) times; of the rest of the rates, those documents get one more whose
    hash, divided by that rest, comes first, until the tokens that the rests stand for are spent. Where that
    is, a histogram of the leading bits tells, so no group is sorted; its buckets are 2**-12 of the value.
    """
    uniform = (F.pmod(F.xxhash64("doc", "m"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    rest = F.col("rate") - F.floor("rate")
    rest = F.when(rest < 1e-9, 0.0).when(rest > 1 - 1e-9, 1.0).otherwise(rest)
    rows = each.withColumn("rest", rest).withColumn("turn", F.when(F.col("rest") > 0, uniform / F.col("rest")))
    rows = cut(rows.withColumn("bucket", F.shiftright(order_key(F.col("turn")), 40)))
    counts = rows.where("bucket is not null").groupBy("m", "source", "bucket").agg(F.sum("tokens").alias("size"), F.sum(F.col("tokens") * F.col("rest")).alias("need"))
    w = W.partitionBy("m", "source")
    spent = F.sum("size").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    # A bucket is used if that brings the sum nearer to what is needed; buckets of a source: at most 2**24.
    fit = counts.withColumn("spent", spent).withColumn("all", F.sum("need").over(w)).where(F.col("spent") - F.col("size") / 2 <= F.col("all"))
    last = cut(fit.groupBy("m", "source").agg(F.max("bucket").alias("last")))
    return (
        rows.join(small_side(last), ["m", "source"], "left")  # a row per mix and source
        .withColumn("repeats", (F.floor(F.col("rate") + 1e-9) + F.coalesce((F.col("bucket") <= F.col("last")) & (F.col("rest") < 1), F.lit(False)).cast("long")).cast("long"))
        .select("m", "doc", "source", "tokens", "repeats")
    )
