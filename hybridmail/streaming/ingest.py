"""Incremental ingest with Structured Streaming: exact dedup, durable watermarks, restartable.

A sync is one run over all that is available (trigger availableNow); each micro-batch is bounded by files. In a batch the
new messages are appended first, then the watermarks are merged with the greater value, so that a stop in between repeats
messages, which the dedup absorbs, and never skips any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.operators.relational import first_wins, merge_watermarks
from hybridmail.sources import feed

FEED = "account_id string, mailbox string, uid bigint, message_id string, subject string, body string, internal_date timestamp"
WATERMARKS = "account_id string, mailbox string, last_seen_uid bigint"


class Store:
    """Tables below a folder: messages are appended to, watermarks replaced by a new version that is read once it is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def messages(self, schema: str = FEED) -> DataFrame:
        path = f"{self.path}/messages"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def _versions(self) -> list[int]:
        root = f"{self.path}/watermarks"
        if not self._there(root):
            return []
        found = self._fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(root))
        return sorted(int(f.getPath().getName()[1:]) for f in found if self._there(f"{f.getPath()}/_SUCCESS"))

    def watermarks(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(WATERMARKS).parquet(f"{self.path}/watermarks/v{versions[-1]}") if versions else self.spark.createDataFrame([], WATERMARKS)

    def put_watermarks(self, df: DataFrame) -> None:
        version = max(self._versions(), default=0) + 1
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/watermarks/v{version}")


def ingest_batch(store: Store, batch: DataFrame, order: list[str] | None = None) -> None:
    """Appends the messages of a batch that aren't stored yet, then raises the watermarks. Rows that repeat a stored message raise them too."""
    fresh = first_wins(batch, store.messages().select("account_id", "message_id"), "account_id", "message_id", order or ["uid"])
    # A repeated uid without a message id is the same row read again.
    known = store.messages().select("account_id", "mailbox", "uid")
    w = Window.partitionBy("account_id", "mailbox", "uid").orderBy("message_id")
    fresh = fresh.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").join(known, ["account_id", "mailbox", "uid"], "left_anti")
    fresh.select(*batch.columns).write.mode("append").parquet(f"{store.path}/messages")
    store.put_watermarks(merge_watermarks(store.watermarks(), batch.select("account_id", "mailbox", "uid")))


def stream(spark: SparkSession, source: str | dict, files_per_batch: int = 20) -> DataFrame:
    """A feed as a stream of FEED: Parquet files below a path, or the options of a mailbox (sources.feed)."""
    if isinstance(source, str):
        return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    feed.register(spark)
    return spark.readStream.format("mailbox_feed").options(**source).load()


def run(spark: SparkSession, source: str | dict, each: Callable[[DataFrame, int], None], *, checkpoint: str, files_per_batch: int = 20):
    """Hands the feed to each(batch, number) up to its present end; the query, ended. A second call with the same checkpoint goes on where the first ended."""
    query = stream(spark, source, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sync(spark: SparkSession, feed_path: str | dict, store: Store, *, checkpoint: str, files_per_batch: int = 20, before_batch: Callable[[int], None] | None = None) -> dict:
    """Runs the feed to its present end; gives the progress of the last batch."""

    def one(batch: DataFrame, number: int) -> None:
        if before_batch:
            before_batch(number)
        ingest_batch(store, batch)

    query = run(spark, feed_path, one, checkpoint=checkpoint, files_per_batch=files_per_batch)
    last = query.lastProgress
    return {"phase": "done", "batches": len(query.recentProgress), "rows": sum(p["numInputRows"] for p in query.recentProgress), "last_batch": last["batchId"] if last else None}


def _first_of_key(key, batches, state):
    """Rows of one key (account, message): the first by uid and mailbox is fresh, unless the state has seen the key before. All go on, as they raise watermarks."""
    import pandas as pd

    rows = pd.concat(batches).sort_values(["uid", "mailbox"], kind="stable")
    fresh = [not state.exists] + [False] * (len(rows) - 1)
    if not state.exists:
        state.update((True,))
    yield rows.drop(columns="_key").assign(fresh=fresh)


def keyed_sync(spark: SparkSession, source: str | dict, store: Store, *, checkpoint: str, files_per_batch: int = 20, before_batch: Callable[[int], None] | None = None, after_write: Callable[[int], None] | None = None) -> dict:
    """sync() with the keys seen so far in the stream's own state, instead of the stored messages: a batch costs what is in it.

    A key is an account's Message-ID, or the place (mailbox, uid) of a message without one. State and source are of one
    checkpoint, so a restart finds both as they were. A batch's messages lie in a folder of its number, so that one which is
    run again after a failure replaces what it had written."""

    def one(batch: DataFrame, number: int) -> None:
        if before_batch:
            before_batch(number)
        batch.persist()
        try:
            batch.filter("fresh").select(*[c.split(" ")[0] for c in FEED.split(", ")]).write.mode("overwrite").parquet(f"{store.path}/messages/batch={number}")
            if after_write:
                after_write(number)
            store.put_watermarks(merge_watermarks(store.watermarks(), batch.select("account_id", "mailbox", "uid")))
        finally:
            batch.unpersist()

    key = F.coalesce(F.concat(F.lit("m"), "message_id"), F.concat_ws("#", F.lit("u"), "mailbox", F.col("uid").cast("string")))
    rows = stream(spark, source, files_per_batch).withColumn("_key", key).groupBy("account_id", "_key").applyInPandasWithState(_first_of_key, f"{FEED}, fresh boolean", "seen boolean", "append", "NoTimeout")
    query = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return {"phase": "done", "batches": len(query.recentProgress), "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def full_resync(spark: SparkSession, feed_path: str | dict, store: Store, *, checkpoint: str, **options) -> dict:
    """Reads the feed from its beginning, under a new checkpoint; the dedup makes it change nothing that is there."""
    return sync(spark, feed_path, store, checkpoint=checkpoint, **options)


#: Texts that an embedder gets at once.
TEXTS = 32


def embedded(batches, embed: Callable, embed_many: Callable | None = None, stop_on_error: bool = False):
    """Rows (chunk_id, embedding, embedding_dim, error) of batches of chunk_id and text. embed_many takes a list of texts; where it fails, its texts are embedded one by one, so that one of them doesn't fail the others. With stop_on_error nothing is embedded after the first failure."""
    import pandas as pd

    stopped = False
    for b in batches:
        rows = []
        for k in range(0, len(b), TEXTS):
            some = b.iloc[k : k + TEXTS]
            many = None
            if embed_many and not stopped:
                try:
                    many = [[float(x) for x in v] for v in embed_many(some["text"].tolist())]
                except Exception:  # noqa: BLE001  which text it was shows below
                    many = None
            for i, (chunk, text) in enumerate(zip(some["chunk_id"], some["text"], strict=True)):
                if stopped:
                    break
                try:
                    v = many[i] if many else [float(x) for x in embed(text)]
                    rows.append((chunk, v, len(v), None))
                except Exception as e:  # noqa: BLE001  whatever an embedder raises is the chunk's error
                    rows.append((chunk, None, None, f"{type(e).__name__}: {e}"))
                    stopped = stop_on_error
        yield pd.DataFrame(rows, columns=["chunk_id", "embedding", "embedding_dim", "error"]).astype({"embedding_dim": "Int32"})


def drain_embeddings(pending: DataFrame, embed, limit: int = 256, *, embed_many=None, stop_on_error: bool = False, tasks: int = 8) -> DataFrame:
    """The oldest `limit` pending chunks (chunk_id, text, created_at) with embedding, embedding_dim and error, dealt to several tasks.

    One that fails doesn't stop the others; with stop_on_error the chunks are embedded by one task in order, and those after the first failure are left out."""
    kind = pending.schema["chunk_id"].dataType.simpleString()
    oldest = pending.orderBy("created_at", "chunk_id").limit(limit).select("chunk_id", "text")
    dealt = oldest if stop_on_error else oldest.repartition(tasks)
    return dealt.mapInPandas(lambda batches: embedded(batches, embed, embed_many, stop_on_error), f"chunk_id {kind}, {VECTOR}")


VECTOR = "embedding array<float>, embedding_dim int, error string"


def ingest_rate(events: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Messages by tumbling window; with `late`, a watermark on event time for streams. events: ts, mailbox."""
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", window), "mailbox").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "mailbox", "n")
