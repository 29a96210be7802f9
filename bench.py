"""Times the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS say on what."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS, WARM_UPS = 5, 2


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from hybridmail.functions.analyzer import plain_tokens
    from hybridmail.functions.text import clean_body_udf, split_chunks_udf
    from hybridmail.operators import fulltext, fusion, segments, vectors
    from hybridmail.plans import catalogue
    from hybridmail.plans import views as V

    def timed(run, runs: int = RUNS, warm: int = WARM_UPS) -> float:
        for _ in range(warm):
            run()
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        return round(statistics.median(took), 4)

    # The index lies on disk, its postings are kept in memory once they were read, as the engine keeps them.
    index = segments.Index(spark, f"file://{tempfile.mkdtemp(prefix='bench-')}/index", plain_tokens, stems=False, kind="bigint")
    index.rebuild(V.chunks(spark, SF_DIR), 1)
    postings = segments.by_block(index.postings()).persist()
    units = V.vectors(spark, SF_DIR).select("message_id", vectors.normalised(F.col("embedding")).alias("unit")).persist()
    n_units, query = units.count(), catalogue._query_vector(spark, SF_DIR)
    postings.count()
    rows = catalogue._rows(spark, SF_DIR)
    pool = fusion.pool_size(20)
    found = lambda words: index.search(words, pool, postings=postings)
    keyword = lambda: fusion.keyword_messages(fulltext.pooled(spark, found(catalogue.QUERY).rows, "bigint"))
    near = lambda: vectors.top_messages(units, query, pool)
    queries = {
        "h1_keyword_search": timed(lambda: keyword().collect()),
        "fts_frequent_word": timed(lambda: found("the")),
        "h1_vector_topk": timed(lambda: near().collect()),
        "h1_hybrid_rrf": timed(lambda: fusion.weigh(fusion.fuse(keyword(), near(), floor=catalogue.FLOOR), rows, V.now(), 20).collect()),
    }
    # As many vectors as a mailbox of a hundred thousand chunks has: each of the table's, turned a little.
    many = units.crossJoin(spark.range(100_000 // max(n_units, 1) + 1).withColumnRenamed("id", "copy")).select((F.col("message_id") + F.col("copy") * 100_000).alias("message_id"), vectors.normalised(F.transform("unit", lambda x, i: x + 0.05 * F.sin(F.col("copy") * (i + 1)))).alias("unit")).persist()
    n_many = many.count()
    queries["h1_vector_topk_100k"] = timed(lambda: vectors.top_messages(many, query, pool).collect())
    asked = units.limit(100).select(F.monotonically_increasing_id().alias("query_id"), F.col("unit").alias("query_unit")).persist()
    queries["h1_vector_batch_100"] = timed(lambda: vectors.top_messages_batch(units, asked, pool).write.format("noop").mode("overwrite").save(), 3, 1)
    queries["ingest_clean_chunk"] = timed(lambda: V.table(spark, SF_DIR, "documents").select(F.explode(split_chunks_udf(clean_body_udf("text")))).write.format("noop").mode("overwrite").save(), 3, 1)
    for name in ("embedded_counts", "dedup_first_wins", "bm25_corpus_stats", "ask_context", "eval_precision_at_5", "uid_watermark"):
        queries[name] = timed(lambda name=name: catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save(), 3, 1)
    print(json.dumps({"metric": "hybridmail headline queries, total of medians", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": SF_DIR.rstrip("/").rpartition("sf")[2], "vectors": n_units, "blocks": {w: [(x := index.search(w, pool, postings=postings, small=0)).scored, x.blocks] for w in (catalogue.QUERY, "the")}, "many_vectors": n_many, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
