"""Exact vector search over clusters with bounds: what can't be among the nearest isn't read.

Unit vectors are put into clusters around centres learned from a bounded sample (SAMPLE rows by hash; about the square root
of the number of vectors, MOST_CLUSTERS at most), and written sorted by cluster, so that a reader skips the row groups of
others. A cluster keeps its centre and its radius, the greatest distance of a vector from the centre: no vector of it has a
larger product with a query than that of the centre plus |query| * radius.

A search visits clusters by falling bound: first those that hold a few pools of vectors, then, knowing the pool's worst
similarity so far, only clusters whose bound comes up to it. The messages are those of a whole scan (vectors.top_messages),
whatever the data; how many clusters are read depends on how well they cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail.operators.vectors import dot, literal

SAMPLE, ROUNDS, MOST_CLUSTERS = 8192, 8, 4096
#: Vectors of the first clusters, in pools; clusters that a filter names one by one.
FIRST_POOLS, NAMED = 4, 1000


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds on a sample."""
    centres = x[np.random.RandomState(3).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


@dataclass(frozen=True)
class Clusters:
    """vectors: cluster, message_id, unit. about: cluster, centre, radius, n (a row for each cluster)."""

    vectors: DataFrame
    about: DataFrame


def build(units: DataFrame, path: str) -> Clusters:
    """Clusters of units (message_id, unit: unit vectors of one length or several; null and zero vectors are left out), written below path. Vectors of each length have clusters of their own."""
    spark = units.sparkSession
    rows = units.filter(F.col("unit").isNotNull() & F.exists("unit", lambda x: x != 0)).select("message_id", "unit", F.size("unit").alias("d"))
    counts = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}  # a row for each length
    centres, first, at = {}, {}, 0
    for d, n in counts.items():
        share = min(1.0, SAMPLE / n)
        some = rows.filter((F.col("d") == d) & (F.pmod(F.xxhash64(F.lit(17), "message_id", "unit"), F.lit(1 << 30)) < share * (1 << 30))).select("unit").limit(2 * SAMPLE).toPandas()["unit"]
        x = np.stack(some.to_numpy()).astype(np.float64) if len(some) else np.zeros((1, d))
        centres[d] = _centres(x, max(1, min(len(x), MOST_CLUSTERS, round(math.sqrt(n)))))
        first[d], at = at, at + len(centres[d])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, d = batch.column(1).to_pandas(), batch.column(2).to_numpy()
            cluster, far = np.zeros(len(d), dtype=np.int64), np.zeros(len(d))
            for k in np.unique(d).tolist():
                mine = np.flatnonzero(d == k)
                x = np.stack(unit.iloc[mine].to_numpy()).astype(np.float64)
                own = _nearest(x, centres[k])
                cluster[mine], far[mine] = first[k] + own, np.linalg.norm(x - centres[k][own], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(far)], names=["message_id", "unit", "cluster", "far"])

    kind = units.schema["message_id"].dataType.simpleString()
    out = rows.mapInArrow(assigned, f"message_id {kind}, unit array<double>, cluster long, far double")
    out.repartition("cluster").sortWithinPartitions("cluster").write.parquet(f"{path}/vectors")
    stored = spark.read.schema(f"message_id {kind}, unit array<double>, cluster long, far double").parquet(f"{path}/vectors")
    known = spark.createDataFrame([(first[d] + i, [float(v) for v in c]) for d, x in centres.items() for i, c in enumerate(x)], "cluster long, centre array<double>")
    about = stored.groupBy("cluster").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).join(known, "cluster")
    about.write.parquet(f"{path}/about")
    return opened(spark, path, kind)


def opened(spark: SparkSession, path: str, kind: str = "string") -> Clusters:
    return Clusters(spark.read.schema(f"message_id {kind}, unit array<double>, cluster long").parquet(f"{path}/vectors"), spark.read.schema("cluster long, radius double, n long, centre array<double>").parquet(f"{path}/about"))


@dataclass(frozen=True)
class Nearest:
    """Rows (message_id, similarity) in order; how many clusters of the query's length there are, and how many were read."""

    rows: list
    clusters: int
    read: int


def nearest(index: Clusters, query: list[float], pool: int) -> Nearest:
    """The `pool` messages of the largest cosine, each by its best vector."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt((q * q).sum()))
    if not norm:
        return Nearest([], 0, 0)
    unit = literal(q / norm)
    # A row for each cluster, about the square root of the vectors. What rounding may take from a bound is added to it.
    bounds = index.about.filter(F.size("centre") == len(q)).select("cluster", "n", (dot(F.col("centre"), unit) + F.col("radius") + 1e-9).alias("most")).orderBy(F.desc("most"), "cluster").collect()

    def read(clusters: list[int]) -> list:
        if len(clusters) <= NAMED:
            some = index.vectors.filter(F.col("cluster").isin(clusters))
        else:
            some = index.vectors.join(F.broadcast(index.vectors.sparkSession.createDataFrame([(c,) for c in clusters], "cluster long")), "cluster", "left_semi")
        best = some.select("message_id", dot(F.col("unit"), unit).alias("s")).groupBy("message_id").agg(F.max("s").alias("similarity"))
        return best.orderBy(F.desc("similarity"), "message_id").limit(pool).collect()  # at most `pool` rows

    first, held = [], 0
    for r in bounds:
        if held >= FIRST_POOLS * pool:
            break
        first.append(r["cluster"])
        held += r["n"]
    found = {r["message_id"]: r["similarity"] for r in read(first)} if first else {}
    # The pool's worst similarity so far is no more than that of the whole: what lies below it can't come in.
    least = sorted(found.values(), reverse=True)[pool - 1] if len(found) >= pool else -math.inf
    more = [r["cluster"] for r in bounds[len(first) :] if r["most"] >= least]
    for r in read(more) if more else []:
        found[r["message_id"]] = max(r["similarity"], found.get(r["message_id"], -math.inf))
    rows = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:pool]
    return Nearest(rows, len(bounds), len(first) + len(more))


def ranked(spark: SparkSession, found: Nearest, kind: str = "string") -> DataFrame:
    """As vectors.top_messages gives them: message_id, similarity, vector_rank."""
    return spark.createDataFrame([(m, s, i) for i, (m, s) in enumerate(found.rows)], f"message_id {kind}, similarity double, vector_rank int")


__all__ = ["Clusters", "Nearest", "build", "nearest", "opened", "ranked"]
