"""Hybrid ranking: reciprocal-rank fusion of keyword and vector ranks, recency, and demotion of bulk mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridmail.functions.text import recency_factor

# Fixed values that results depend on.
RRF_K = 60
FLOOR = 0.5
BULK_FACTOR, EXEMPT_FROM = 0.4, 0.85
POOL_TIMES, LEAST_POOL = 10, 80


def pool_size(limit: int) -> int:
    return max(limit * POOL_TIMES, LEAST_POOL)


def keyword_messages(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunk hits (message_id, chunk_rank) to messages: their best chunk's rank, and a score that falls with it over all hits."""
    by = by or []
    counted = hits.withColumn("n_hits", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    best = counted.groupBy(*by, "message_id").agg(F.min("chunk_rank").alias("keyword_rank"), F.first("n_hits").alias("n_hits"))
    return best.select(*by, "message_id", "keyword_rank", (F.lit(1.0) - F.col("keyword_rank") / F.greatest(F.col("n_hits"), F.lit(1))).alias("keyword_score"))


def _part(rank: str) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K + 1) + F.col(rank)), F.lit(0.0))


def fuse(keyword: DataFrame, vector: DataFrame, *, floor: float = FLOOR, by: list[str] | None = None) -> DataFrame:
    """Full outer join of both rankings with the sum of reciprocal ranks. The floor counts after ranking."""
    by = by or []
    near = vector.filter(F.col("similarity") >= floor)
    return keyword.join(near, [*by, "message_id"], "full_outer").select(*by, "message_id", "keyword_rank", "keyword_score", "similarity", "vector_rank", (_part("keyword_rank") + _part("vector_rank")).alias("rrf"))


def fetch(messages: DataFrame, ids: DataFrame, broadcast: bool) -> DataFrame:
    """The messages of ids (message_id). broadcast: ids are pools of bounded size; they go to where the messages lie, and no message is shuffled."""
    ids = ids.select("message_id")
    return messages.join(F.broadcast(ids) if broadcast else ids.distinct(), "message_id", "left_semi")


def weigh(fused: DataFrame, messages: DataFrame, now: Column, limit: int, *, by: list[str] | None = None) -> DataFrame:
    """Joins messages (message_id, received_at, is_bulk and more), weighs and keeps the best `limit`. An id without a message takes part in the cut and then drops out.

    Without `by`, fused is two pools at most: it is computed once and fetched (its plan would else run twice, for the ids and
    for the scores), its ids are broadcast to the messages, and those found are broadcast back. With it, as many pools as
    queries: then Spark chooses by size."""
    by = by or []
    if not by:
        fused = fused.sparkSession.createDataFrame(fused.toArrow())  # two pools at most
    found = fetch(messages, fused, not by).withColumn("_there", F.lit(True))
    rows = fused.join(found if by else F.broadcast(found), "message_id", "left")
    spared = F.coalesce(F.col("keyword_score") >= EXEMPT_FROM, F.lit(False))
    factor = F.when(F.coalesce(F.col("is_bulk"), F.lit(False)) & ~spared, F.lit(BULK_FACTOR)).otherwise(F.lit(1.0))
    weight = F.when(F.col("_there"), recency_factor(F.col("received_at"), now) * factor).otherwise(F.lit(1.0))
    rows = rows.withColumn("combined_score", F.col("rrf") * weight)
    order = [F.desc("combined_score"), F.asc("message_id")]
    if by:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")
    else:
        rows = rows.orderBy(*order).limit(limit)
    return rows.filter("_there").drop("_there")
