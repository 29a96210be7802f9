"""The backlog of embeddings as a stream: chunks are embedded as their files appear.

A streaming query over the folders of the chunk table, with a checkpoint: each file is taken up once, so what a batch costs
follows from the new chunks in it, not from the tables. The texts go to the embedder by lists in Arrow batches, in as many
tasks as the batch has files. A chunk whose embedding fails stays pending for Engine.embed_pending.

A batch that is run again after a failure, and chunks that were written anew, may have vectors already: only then the ids
of the vector table are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hybridmail import schema
from hybridmail.streaming.ingest import VECTOR, embedded

#: Files of a batch, and the pause between batches of a query that runs on.
FILES, EVERY = 64, "500 milliseconds"


def start(engine, *, checkpoint: str | None = None, once: bool = False, files: int = FILES) -> StreamingQuery:
    """Starts the query; once: up to the present end. A second start with the same checkpoint goes on where the first ended."""
    engine.reserve("chunks")
    new = engine.spark.readStream.schema(schema.CHUNKS).option("maxFilesPerTrigger", files).option("ignoreMissingFiles", "true").parquet(f"{engine.warehouse}/chunks/*")
    pending = new.filter("embedding is null").select(F.col("id").alias("chunk_id"), "text", F.col("_metadata.file_path").contains("/chunks/v").alias("anew"))
    first: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        if not first or not batch.filter("anew").isEmpty():
            batch = batch.join(engine.stored("chunk_vectors").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
        first.append(number)
        embed, many = engine.embedder.embed, getattr(engine.embedder, "embed_many", None)
        done = batch.select("chunk_id", "text").mapInPandas(lambda rows: embedded(rows, embed, many), f"chunk_id string, {VECTOR}").filter("error is null").persist()
        try:
            if not done.isEmpty():
                engine.add_vectors(done.select(F.col("chunk_id").alias("id"), "embedding", "embedding_dim", F.lit(engine.embedder.name).alias("embedding_model")))
        finally:
            done.unpersist()

    out = pending.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint or f"{engine.warehouse}/_embedding")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=EVERY)).start()
