"""The mail model over the driver's tables: the same definitions as Spark DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail.shipping import ship

AS_OF = "2025-01-01 00:00:00"

MESSAGES_SQL = """
    select doc_id as message_id, lang as account_id, source, md5(text) as rfc822_message_id, substring(text, 1, 60) as subject,
           case doc_id % 7 when 0 then 'newsletter@shop.example' when 1 then 'mailer@list.example' when 2 then 'x-notifications@app.example'
                when 3 then 'no-reply@bank.example' else 'person@home.example' end as sender_email,
           case when doc_id % 13 <> 0 then timestamp '2023-01-01 00:00:00' + (doc_id % 730) * interval '1' day end as received_at,
           text as body_plain
    from documents"""

CHUNKS_SQL = """
    select message_id, cast(i - 1 as int) as chunk_index, l[i] as text
    from (select message_id, l, unnest(range(1, len(l) + 1)) as i
          from (select doc_id as message_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(AS_OF).cast("timestamp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("doc_id") % 7 == 0, "newsletter@shop.example").when(F.col("doc_id") % 7 == 1, "mailer@list.example").when(F.col("doc_id") % 7 == 2, "x-notifications@app.example").when(F.col("doc_id") % 7 == 3, "no-reply@bank.example").otherwise("person@home.example")
    at = F.when(F.col("doc_id") % 13 != 0, F.timestamp_seconds(F.lit(1672531200) + (F.col("doc_id") % 730) * 86400))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.col("lang").alias("account_id"), "source", F.md5("text").alias("rfc822_message_id"), F.substring("text", 1, 60).alias("subject"), sender.alias("sender_email"), at.alias("received_at"), F.col("text").alias("body_plain"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line that isn't blank, numbered from 0."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.posexplode(lines).alias("chunk_index", "text"))
    return rows.select(F.concat_ws(":", F.col("message_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "message_id", "chunk_index", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 200).alias("message_id"), "embedding")


VECTORS_SQL = "select vec_id, vec_id % 200 as message_id, embedding from embeddings"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("uid"), F.col("user_id").cast("string").alias("account_id"), F.col("event_type").alias("mailbox"), "ts")


ARRIVALS_SQL = "select event_id as uid, cast(user_id as varchar) as account_id, event_type as mailbox, ts from events"
