"""Retrieval quality on labelled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """hits: query_id, rank (from 1), haystack, similarity, keyword_score; cases: query_id, relevant, junk (arrays of substrings). Junk beats relevant."""
    rows = hits.join(F.broadcast(cases), "query_id")  # the labelled queries, a stated handful

    def has(patterns: str) -> Column:
        return F.exists(patterns, lambda p: F.contains(F.lower("haystack"), F.lower(p)))

    return rows.withColumn("verdict", F.when(has("junk"), "junk").when(has("relevant"), "relevant").otherwise("other")).withColumn("weak", F.col("similarity").isNull() & (F.coalesce("keyword_score", F.lit(0.0)) < 0.85))


def precision(rows: DataFrame, k: int = 5) -> DataFrame:
    """By query: scored hits among the first k, relevant, junk, junk at the top, weak evidence, precision."""
    top = rows.filter(F.col("rank") <= k)
    relevant = F.count_if(F.col("verdict") == "relevant")
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored"), relevant.alias("n_relevant"), F.count_if(F.col("verdict") == "junk").alias("n_junk"), F.count_if((F.col("verdict") == "junk") & (F.col("rank") == 1)).alias("junk_at_1"), F.count_if("weak").alias("n_weak"), (relevant / F.count(F.lit(1))).alias("precision"))


def pooled(by_query: DataFrame) -> DataFrame:
    """Over all queries: relevant over scored, not the mean of the queries' precisions."""
    return by_query.agg(F.sum("n_scored").alias("n_scored"), F.sum("n_relevant").alias("n_relevant"), F.sum("n_junk").alias("n_junk"), F.sum("junk_at_1").alias("junk_at_1"), F.sum("n_weak").alias("n_weak"), (F.sum("n_relevant") / F.sum("n_scored")).alias("pooled_precision"))
