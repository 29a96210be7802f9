"""Exact vector search over unit vectors, in JVM expressions.

Normalised once, cosine is a dot product. Ranking is by each message's best chunk. Scans are linear in the vectors and
keep only the pool: no shuffle but the partial maxima by message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from hybridmail.operators.fulltext import number


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length, as doubles; a zero vector stays."""
    # Vector and norm are bound as values: written out in the inner function, the norm would be summed anew for each component.
    bound = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), F.sqrt(dot(w, w)).alias("norm")))
    return F.transform(bound, lambda b: F.transform(b["v"], lambda x: F.when(b["norm"] > 0, x.cast("double") / b["norm"]).otherwise(x.cast("double"))))[0]


def literal(v) -> Column:
    return F.expr(f"array({', '.join(map(number, v))})")


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian 32-bit floats; a trailing part of one is ignored."""
    for x in batches:
        yield x.map(lambda b: np.frombuffer(b, dtype="<f4", count=len(b) // 4), na_action="ignore")


@F.pandas_udf(BinaryType())
def to_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield x.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")


def top_messages(vectors: DataFrame, query: list[float], pool: int) -> DataFrame:
    """message_id, similarity, vector_rank (from 0) of the `pool` nearest messages. vectors: message_id, unit (unit vectors)."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt((q * q).sum()))
    if not norm:
        return vectors.select("message_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("vector_rank")).limit(0)
    same = vectors.filter(F.size("unit") == len(q))
    best = same.select("message_id", dot(F.col("unit"), literal(q / norm)).alias("s")).groupBy("message_id").agg(F.max("s").alias("similarity"))
    pooled = best.orderBy(F.desc("similarity"), "message_id").limit(pool)
    return pooled.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "message_id")) - 1)


#: Queries that are multiplied with a batch of vectors at once; as many go to every task as they are, more are dealt.
QUERY_BLOCK, FEW = 512, 4096
#: Vectors that a dealt block of queries meets in one task, about.
GROUP = 1 << 16


def _best(message: np.ndarray, x: np.ndarray, q: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors x with their messages and queries q: query's place, message and similarity of the best `pool` messages of each. Of equal similarities all that reach the last place go on; the ids decide later."""
    order = np.argsort(message, kind="stable")
    message, x = message[order], x[order]
    begin = np.flatnonzero(np.concatenate(([True], message[1:] != message[:-1])))
    best = np.maximum.reduceat(x @ q.T, begin, axis=0)
    k = min(pool, len(begin))
    least = np.partition(best, len(begin) - k, axis=0)[len(begin) - k]
    at, of = np.nonzero(best >= least)
    return of, message[begin][at], best[at, of]


def _few(vectors: DataFrame, rows: list, kinds: list[str], pool: int) -> DataFrame:
    """Each task multiplies its vectors with all queries."""
    blocks: dict[int, list[list[tuple]]] = {}
    for q in rows:
        of = blocks.setdefault(len(q[1]), [[]])
        if len(of[-1]) == QUERY_BLOCK:
            of.append([])
        of[-1].append(q)
    asked = {d: [([i for i, _ in b], np.array([u for _, u in b], dtype=np.float64)) for b in of] for d, of in blocks.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, some in batch.groupby(batch["unit"].map(len)):
                message, x = some["message_id"].to_numpy(), np.stack(some["unit"].to_numpy()).astype(np.float64)
                for ids, q in asked.get(d, ()):
                    of, found, s = _best(message, x, q, pool)
                    yield pd.DataFrame({"query_id": [ids[j] for j in of], "message_id": found, "similarity": s})

    return vectors.mapInPandas(nearest, f"query_id {kinds[1]}, message_id {kinds[0]}, similarity double")


def _many(vectors: DataFrame, queries: DataFrame, kinds: list[str], pool: int) -> DataFrame:
    """Blocks of queries meet groups of vectors (a message's vectors are of one group): copies of both go with the blocks and groups, and a task holds one block of queries while a group's vectors stream by."""
    groups, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, GROUP), (queries, QUERY_BLOCK)))
    none = lambda kind: F.lit(None).cast(kind)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.size("query_unit").alias("d"), F.lit(0).alias("kind"), "query_id", none(kinds[0]).alias("message_id"), F.col("query_unit").alias("unit"), each(groups).alias("g"))
    right = vectors.select(F.pmod(F.xxhash64("message_id"), F.lit(groups)).alias("g"), F.size("unit").alias("d"), F.lit(1).alias("kind"), none(kinds[1]).alias("query_id"), "message_id", "unit", each(blocks).alias("block"))
    dealt = left.unionByName(right).repartition("g", "d", "block").sortWithinPartitions("g", "d", "block", "kind", "message_id")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, q, found = None, [], [], []

        def ended() -> Iterator[pd.DataFrame]:
            if found:
                rows = pd.concat(found).groupby(["query_id", "message_id"], sort=False, as_index=False)["similarity"].max()
                rows["r"] = rows.groupby("query_id")["similarity"].rank(method="min", ascending=False)
                yield rows[rows["r"] <= pool].drop(columns="r")

        for batch in batches:
            for place, some in batch.groupby(["g", "d", "block"], sort=False):
                if place != now:
                    yield from ended()
                    now, ids, q, found = place, [], [], []
                asked, own = some[some["kind"] == 0], some[some["kind"] == 1]
                if len(asked):
                    ids = [*ids, *asked["query_id"]]
                    q = [*q, *asked["unit"]]
                if len(own) and ids:
                    of, message, s = _best(own["message_id"].to_numpy(), np.stack(own["unit"].to_numpy()).astype(np.float64), np.stack(q).astype(np.float64), pool)
                    found.append(pd.DataFrame({"query_id": [ids[j] for j in of], "message_id": message, "similarity": s}))
        yield from ended()

    return dealt.mapInPandas(nearest, f"query_id {kinds[1]}, message_id {kinds[0]}, similarity double")


def top_messages_batch(vectors: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """query_id, message_id, similarity, vector_rank. vectors: message_id, unit; queries: query_id, query_unit, a stated set.

    A task gives out the best `pool` messages of each query that it has seen; a message that is among the best of all is
    among those of the task that holds its nearest chunk. FEW queries go along to every task; more are dealt in blocks."""
    kinds = [vectors.schema["message_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    vectors, queries = vectors.filter(F.col("unit").isNotNull()).select("message_id", "unit"), queries.select("query_id", "query_unit")
    rows = [(r[0], r[1]) for r in queries.limit(FEW + 1).collect()]
    if not rows:
        found = vectors.sparkSession.createDataFrame([], f"query_id {kinds[1]}, message_id {kinds[0]}, similarity double")
    else:
        found = _few(vectors, rows, kinds, pool) if len(rows) <= FEW else _many(vectors, queries, kinds, pool)
    best = found.groupBy("query_id", "message_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "message_id")
    return best.withColumn("vector_rank", F.row_number().over(w) - 1).filter(F.col("vector_rank") < pool)
