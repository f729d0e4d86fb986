"""Retrieval metrics and statistics over long tables: runs (query_id, doc_id, rank), judgments (query_id, doc_id, grade)
and queries (query_id, grp, lang, target_lang, type). A grade of 1 or more is relevant. Undefined values are null and left out of means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN_ITEM = ("title", "about", "passage", "exact")
KNOWN_METRICS, TOPIC_METRICS = ("mrr_10", "success_1", "success_10", "success_100"), ("ndcg_10", "p_10", "recall_100", "judged_10")


def per_query(queries: DataFrame, qrels: DataFrame, run: DataFrame) -> DataFrame:
    """(query_id, all eight metrics) of every query; queries without results or judgments count with what that gives."""
    judged = run.join(qrels, ["query_id", "doc_id"], "left")
    hit = F.coalesce(F.col("grade") >= 1, F.lit(False))
    gain = F.coalesce(F.col("grade"), F.lit(0)) / F.log2(F.col("rank") + 1)
    found = judged.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, gain).otherwise(0.0)).alias("dcg"),
        F.count(F.when(hit & (F.col("rank") <= 10), 1)).alias("hits_10"),
        F.countDistinct(F.when(hit & (F.col("rank") <= 100), F.col("doc_id"))).alias("hits_100"),
        F.count(F.when((F.col("rank") <= 10) & F.col("grade").isNotNull(), 1)).alias("known_10"),
        F.count(F.when(F.col("rank") <= 10, 1)).alias("top_10"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    best = qrels.withColumn("place", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= 10, F.col("grade") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("idcg"),
        F.count(F.when(F.col("grade") >= 1, 1)).alias("relevant"),
    )
    all_ = queries.select("query_id").join(found, "query_id", "left").join(best, "query_id", "left").fillna(0, ["dcg", "hits_10", "hits_100", "known_10", "top_10", "idcg", "relevant"])
    at = lambda k: F.coalesce(F.when(F.col("first") <= k, 1.0), F.lit(0.0))
    return all_.select(
        "query_id",
        F.coalesce(F.when(F.col("first") <= 10, 1.0 / F.col("first")), F.lit(0.0)).alias("mrr_10"),
        at(1).alias("success_1"), at(10).alias("success_10"), at(100).alias("success_100"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg_10"),
        (F.col("hits_10") / 10.0).alias("p_10"),
        F.when(F.col("relevant") > 0, F.col("hits_100") / F.col("relevant")).alias("recall_100"),
        F.when(F.col("top_10") > 0, F.col("known_10") / F.col("top_10")).otherwise(0.0).alias("judged_10"),
    )


def by_type(queries: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, metric, value): of each query the metrics that its type is scored by: known items and topics have different ones."""
    kinds = queries.select("query_id", F.col("type").isin(*KNOWN_ITEM).alias("known"))
    rows = values.join(kinds, "query_id")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(m in KNOWN_METRICS).alias("of_known")) for m in (*KNOWN_METRICS, *TOPIC_METRICS)])
    return rows.select("query_id", "known", F.inline(pairs)).where("known = of_known").select("query_id", "metric", "value")


def judged_topics(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Topics with a judgment."""
    return queries.where(~F.col("type").isin(*KNOWN_ITEM)).join(qrels.select("query_id"), "query_id", "left_semi")


def comparison(queries: DataFrame, qrels: DataFrame, values: DataFrame, baseline: DataFrame, permutations: int = 10_000, level: float = 0.05) -> DataFrame:
    """(metric, subset, n, mean, baseline, p, significant): a setup against the baseline on the four subsets that a comparison marks. An undefined value counts as 0; an
    empty subset has no row. One pass flips all four series together: a query's sign in a permutation is a hash of both."""
    known = queries.where(F.col("type").isin(*KNOWN_ITEM))
    subsets = {
        ("mrr_10", "known"): known, ("success_10", "known"): known, ("success_10", "cross"): known.where(~F.col("lang").eqNullSafe(F.col("target_lang"))),
        ("ndcg_10", "topics"): judged_topics(queries, qrels),
    }
    parts = None
    for (metric, subset), ids in subsets.items():
        a = values.select("query_id", F.coalesce(F.col(metric), F.lit(0.0)).alias("a")).join(ids.select("query_id"), "query_id", "left_semi")
        b = baseline.select("query_id", F.coalesce(F.col(metric), F.lit(0.0)).alias("b"))
        part = a.join(b, "query_id").select(F.lit(metric).alias("metric"), F.lit(subset).alias("subset"), "query_id", "a", "b", (F.col("a") - F.col("b")).alias("d"))
        parts = part if parts is None else parts.unionByName(part)
    stats = parts.groupBy("metric", "subset").agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.avg("b").alias("baseline"), F.abs(F.sum("d")).alias("total"))
    sign = F.md5(F.concat_ws(":", F.lit(0), F.col("perm"), F.col("query_id").cast("string")).cast("binary"))
    flips = parts.where("d <> 0").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    sums = flips.groupBy("metric", "subset", "perm").agg(F.sum(F.when(F.substring(sign, 1, 1) < "8", F.col("d")).otherwise(-F.col("d"))).alias("s"))
    extreme = sums.join(stats, ["metric", "subset"]).groupBy("metric", "subset").agg(F.count_if(F.abs("s") >= F.col("total") - 1e-9).alias("extreme"))
    # Without any difference every flip is as extreme.
    p = (F.coalesce("extreme", F.lit(permutations)) + 1) / float(permutations + 1)
    rows = stats.join(extreme, ["metric", "subset"], "left")
    return rows.select("metric", "subset", "n", F.round("mean", 4).alias("mean"), F.round("baseline", 4).alias("baseline"), F.round(p, 6).alias("p"), (p < level).alias("significant"))


def kept_results(stored: DataFrame, new: DataFrame, key: str, *metrics: str) -> DataFrame:
    """Results of setups: a new value replaces the stored one, and a metric that was not scored now keeps what it had."""
    old = stored.select(key, *[F.col(m).alias(f"_{m}") for m in metrics])
    return new.join(old, key, "full").select(key, *[F.coalesce(m, f"_{m}").alias(m) for m in metrics])


def breakdowns(queries: DataFrame, values: DataFrame) -> DataFrame:
    """Means of the known-item metrics over all, cross-lingual, same-language, by type and by pair of languages: (part, name, queries, metrics)."""
    rows = queries.where(F.col("type").isin(*KNOWN_ITEM)).join(values, "query_id")
    cross = F.when(F.col("lang").eqNullSafe(F.col("target_lang")), "same_language").otherwise("cross_lingual")
    rows = rows.withColumn("crossing", cross).withColumn("pair", F.concat(F.col("lang"), F.lit("->"), F.col("target_lang")))
    means = [F.round(F.avg(m), 4).alias(m) for m in KNOWN_METRICS]
    sets = rows.groupingSets([[], ["crossing"], ["type"], ["pair"]], "crossing", "type", "pair")
    out = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("queries"), *means)
    part = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "crossing").when(F.col("gid") == 5, "type").otherwise("pair")
    name = F.coalesce("crossing", "type", "pair", F.lit("all"))
    return out.select(part.alias("part"), name.alias("name"), "queries", *KNOWN_METRICS)


def rbo(first: DataFrame, second: DataFrame, p: float = 0.9, depth: int = 10) -> DataFrame:
    """Extrapolated rank-biased overlap of two rankings (key, doc_id, rank), as (key, rbo); keys that one lacks are left out."""
    ends = lambda r, n: r.where(F.col("rank") <= depth).groupBy("key").agg(F.max("rank").alias(n))
    k = ends(first, "ka").join(ends(second, "kb"), "key").select("key", F.least("ka", "kb").alias("k"))
    shared = first.select("key", "doc_id", F.col("rank").alias("ra")).join(second.select("key", "doc_id", F.col("rank").alias("rb")), ["key", "doc_id"])
    shared = shared.join(k, "key").select("key", F.greatest("ra", "rb").alias("d"), "k").where("d <= k")
    # A document shared from depth d on adds to the overlap of every depth from d to k.
    tail = F.aggregate(F.sequence("d", "k"), F.lit(0.0), lambda s, i: s + F.pow(F.lit(p), i) / i)
    sums = shared.groupBy("key").agg(F.count("*").alias("n"), F.sum(tail).alias("total"))
    out = k.join(sums, "key", "left").fillna(0, ["n", "total"])
    return out.select("key", F.round(F.col("n") / F.col("k") * F.pow(F.lit(p), F.col("k")) + (1 - p) / p * F.col("total"), 6).alias("rbo"))


def consistency(queries: DataFrame, run: DataFrame) -> DataFrame:
    """Mean overlap between the two members of each query group of exactly two, over all and by type: (type, rbo, groups); type null is all."""
    g = Window.partitionBy("grp")
    pairs = queries.withColumn("n", F.count("*").over(g)).where("n = 2").withColumn("side", F.row_number().over(g.orderBy("query_id")))
    ranked = run.join(pairs.select("query_id", "grp", "side", "type"), "query_id").withColumn("key", F.col("grp"))
    values = rbo(ranked.where("side = 1"), ranked.where("side = 2"))
    kinds = pairs.where("side = 1").select(F.col("grp").alias("key"), "type")
    return values.join(kinds, "key").rollup("type").agg(F.round(F.avg("rbo"), 4).alias("rbo"), F.count("*").alias("groups"))


def randomization(pairs: DataFrame, permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """(n, observed, p) of paired values (query_id, a, b): the share of sign flips, decided by a hash, whose mean difference is as extreme.

    Differences are one row a query, so the flips of one permutation are a sum over them; both sides are split among tasks."""
    diffs = pairs.select("query_id", (F.col("a") - F.col("b")).alias("d"))
    stats = diffs.agg(F.count("*").alias("n"), F.abs(F.sum("d")).alias("total"))
    sign = F.md5(F.concat_ws(":", F.lit(seed), F.col("perm"), F.col("query_id").cast("string")).cast("binary"))
    flips = diffs.sparkSession.range(permutations).withColumnRenamed("id", "perm").crossJoin(diffs)
    sums = flips.groupBy("perm").agg(F.sum(F.when(F.substring(sign, 1, 1) < "8", F.col("d")).otherwise(-F.col("d"))).alias("s"))
    extreme = sums.crossJoin(F.broadcast(stats)).agg(F.count(F.when(F.abs("s") >= F.col("total") - 1e-9, 1)).alias("extreme"))
    p = F.when(F.col("n") == 0, 1.0).otherwise((F.col("extreme") + 1) / float(permutations + 1))
    return stats.crossJoin(extreme).select("n", F.round(F.try_divide("total", "n"), 6).alias("observed"), F.round(p, 6).alias("p"))


def sign_test(higher: int, lower: int) -> float:
    """Exact two-sided sign test; ties are left out beforehand."""
    n, least = higher + lower, min(higher, lower)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(least + 1)) / 2**n)


def sign_test_column(higher: Column, lower: Column) -> Column:
    """The same as an expression, for up to about a thousand pairs; binomials are built one from the one before."""
    n, least = (higher + lower).cast("int"), F.least(higher, lower).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("t"), F.pow(F.lit(0.5), n).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] * (n - i + 1) / i
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    steps = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add, lambda a: a["s"]))


def grade_shift(pairs: DataFrame) -> DataFrame:
    """(higher, lower): how often the model (b) grades above and below the human (a)."""
    return pairs.agg(F.count_if(F.col("b") > F.col("a")).alias("higher"), F.count_if(F.col("b") < F.col("a")).alias("lower"))


def weighted_kappa(pairs: DataFrame, categories: int = 3) -> DataFrame:
    """One row (kappa) of quadratic-weighted agreement of grades (a, b, weight); 1 if no disagreement is expected."""
    cells = pairs.groupBy("a", "b").agg(F.sum("weight").alias("w"))
    total = cells.agg(F.sum("w").alias("n"))
    far = F.pow((F.col("a") - F.col("b")) / float(categories - 1), F.lit(2))
    seen = cells.agg(F.sum(far * F.col("w")).alias("seen"))
    rows, cols = cells.groupBy("a").agg(F.sum("w").alias("wa")), cells.groupBy("b").agg(F.sum("w").alias("wb"))
    due = rows.crossJoin(cols).agg(F.sum(far * F.col("wa") * F.col("wb")).alias("due"))  # at most categories**2 rows
    out = seen.crossJoin(due).crossJoin(total)
    return out.select(F.round(F.when(F.col("due") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("n") / F.col("due")), 6).alias("kappa"))


def pool_weights(sampled: DataFrame, pool: DataFrame) -> DataFrame:
    """(grade, weight): a grade's count in the pool over its count in the sample."""
    a = pool.groupBy("grade").agg(F.count("*").alias("in_pool"))
    b = sampled.groupBy("grade").agg(F.count("*").alias("in_sample"))
    return b.join(a, "grade", "left").select("grade", (F.coalesce("in_pool", F.lit(0)) / F.col("in_sample")).alias("weight"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(human, g0, g1, g2): counts of model grades (b) for each human grade (a)."""
    return pairs.groupBy(F.col("a").alias("human")).agg(*[F.count_if(F.col("b") == g).alias(f"g{g}") for g in (0, 1, 2)])


def cell(value: Column, significant: Column) -> Column:
    """A value for a comparison table: three digits, a star if significant, n/a if undefined."""
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.format_string("%.3f", value), F.when(significant, "*").otherwise("")))
