"""Threads of messages: a forest over the ids that messages name, by pointer jumping.

Every id that occurs is a container, also one that no message has (a mail that was never received still holds its replies
together). The chain of a message is its References, in order, then its In-Reply-To where that isn't the last of them, then
the message itself; each id of a chain answers the one before it. A container keeps the parent that the earliest message gives it;
what a message says of itself counts before what others say of it. Links that would close a circle are cut at the
circle's smallest id, which becomes a root.

Roots are found by doubling: each round points a container at its pointer's pointer, so that a thread of depth d takes
log2(d) joins, whatever its number of messages. Between rounds the pointers lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridmail.shipping import drop, kept


def chains(messages: DataFrame) -> DataFrame:
    """id, parent, own (whether the message speaks of itself), seq of each link. messages: message_id, reply_to (or null), references (array, oldest first, or null), seq (their order). Null and empty ids, repeats next to each other, and links to itself are left out."""
    named = F.filter(F.coalesce("references", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    reply = F.when(F.col("reply_to").isNotNull() & (F.col("reply_to") != "") & ~F.array_contains(named, F.col("reply_to")), F.array("reply_to")).otherwise(F.array().cast("array<string>"))
    whole = F.concat(named, reply, F.array("message_id"))
    rows = messages.filter(F.col("message_id").isNotNull() & (F.col("message_id") != "")).select("message_id", "seq", whole.alias("chain"))
    steps = F.sequence(F.lit(0), F.size("chain") - 2)
    pairs = rows.filter(F.size("chain") > 1).select("message_id", "seq", "chain", F.explode(steps).alias("i")).select(F.get("chain", F.col("i") + 1).alias("id"), F.get("chain", F.col("i")).alias("parent"), "message_id", "seq")
    return pairs.filter("id <> parent").select("id", "parent", (F.col("id") == F.col("message_id")).alias("own"), "seq")


def parents(messages: DataFrame) -> DataFrame:
    """id, parent: the parent that each container keeps."""
    first = Window.partitionBy("id").orderBy(F.desc("own"), "seq", "parent")
    return chains(messages).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("id", "parent")


def roots(links: DataFrame) -> DataFrame:
    """id, root, depth of each container of a table of links (id, parent: at most one parent an id)."""
    spark = links.sparkSession
    links, links_path = kept(links, "thread-links")
    while True:
        every = links.select("id").unionAll(links.select(F.col("parent").alias("id"))).distinct()
        there = F.col("parent").isNotNull()
        now = every.join(links, "id", "left").select("id", F.coalesce("parent", "id").alias("up"), F.when(there, 1).otherwise(0).cast("long").alias("depth"), there.alias("open"), F.least("id", F.coalesce("parent", "id")).alias("least"))
        now, path = kept(now, "thread-pointers")
        rounds, left = 0, None
        while left is None or left:
            # `least` is the smallest id on the way so far: once ways are longer than circles, all ids of a circle agree on it.
            ahead = now.select(*[F.col(c).alias(f"_{c}") for c in ("id", "up", "depth", "open", "least")])
            jumped = now.join(ahead, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_open").alias("open"), F.least("least", "_least").alias("least"))
            following, following_path = kept(jumped, "thread-pointers")
            drop(spark, path)
            now, path, rounds = following, following_path, rounds + 1
            was, left = left, now.filter("open").count()
            if left and left == was and 2**rounds > left:  # no way ends any more: all that are open lead into circles, and have been all around
                break
        if not left:
            drop(spark, links_path)
            return now.select("id", F.col("up").alias("root"), "depth")
        # Open ways end within their circle, where `least` is the circle's smallest id: it becomes a root.
        ends = now.filter("open").select(F.col("up").alias("id")).distinct()
        heads = now.join(ends, "id", "left_semi").select(F.col("least").alias("id")).distinct()
        cut, cut_path = kept(links.join(heads, "id", "left_anti"), "thread-links")
        drop(spark, path, links_path)
        links, links_path = cut, cut_path


def threads(messages: DataFrame) -> DataFrame:
    """A row for each message (of an id): message_id, parent (a message or a missing one, null for a root), root, depth, n_messages (of the thread, those that are there)."""
    links = parents(messages)
    found = roots(links)
    named = messages.filter(F.col("message_id").isNotNull() & (F.col("message_id") != "")).select("message_id").distinct()
    rows = named.join(found, F.col("message_id") == F.col("id"), "left").select("message_id", F.coalesce("root", "message_id").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    up = links.withColumnRenamed("id", "message_id")
    rows = rows.join(up, "message_id", "left").withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n_messages"))
    return rows.join(sizes, "root").select("message_id", "parent", "root", "depth", "n_messages")
