"""Changes to tables as functions from an old table and a delta to a new one; counters and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """old and the rows of new whose key isn't there; of equal keys within new the first. A key with a null never equals another."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    keyed = new.filter(whole).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r").join(old.select(*key), key, "left_anti")
    return old.unionByName(keyed.select(*old.columns)).unionByName(new.filter(~whole).select(*old.columns))


def first_wins(new: DataFrame, known: DataFrame, account: str, message: str, order: list[str]) -> DataFrame:
    """The rows of new whose (account, message) isn't known, the first of each; a null message id is never a repeat."""
    named = new.filter(F.col(message).isNotNull())
    w = Window.partitionBy(account, message).orderBy(*order)
    first = named.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").join(known.select(account, message), [account, message], "left_anti")
    return first.select(*new.columns).unionByName(new.filter(F.col(message).isNull()))


def upsert(old: DataFrame, delta: DataFrame, key: list[str], keep_null: bool = True) -> DataFrame:
    """Values of delta over those of old; with keep_null a null in delta keeps the old value."""
    o, d = old.alias("o"), delta.withColumn("_new", F.lit(True)).alias("d")
    on = [F.col(f"o.{k}") == F.col(f"d.{k}") for k in key]
    joined = o.join(d, on, "full_outer")

    def value(c: str) -> Column:
        if c in key or c not in delta.columns:
            return F.coalesce(f"d.{c}", f"o.{c}").alias(c) if c in key else F.col(f"o.{c}").alias(c)
        return (F.coalesce(f"d.{c}", f"o.{c}") if keep_null else F.when(F.col("d._new"), F.col(f"d.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def update(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old with delta's values where it has the key and isn't null."""
    changed = [c for c in delta.columns if c not in key]
    d = delta.select(*key, *[F.col(c).alias(f"_{c}") for c in changed])
    return old.join(d, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in old.columns])


def delete_account(tables: dict[str, DataFrame], accounts: DataFrame) -> dict[str, DataFrame]:
    """Removes accounts (column id) with all that hangs on them; feedback keeps its rows but forgets the message."""
    gone = accounts.select(F.col("id").alias("account_id"))
    out = dict(tables)
    dead = tables["messages"].join(gone, "account_id", "left_semi").select(F.col("id").alias("message_id"))
    out["accounts"] = tables["accounts"].join(gone.withColumnRenamed("account_id", "id"), "id", "left_anti")
    for name in ("mailboxes", "messages", "sync_state"):
        if name in tables:
            out[name] = tables[name].join(gone, "account_id", "left_anti")
    if "chunks" in tables:
        out["chunks"] = tables["chunks"].join(dead, "message_id", "left_anti")
    if "search_feedback" in tables:
        f = tables["search_feedback"]
        marked = f.join(dead.withColumn("_dead", F.lit(True)), "message_id", "left")
        out["search_feedback"] = marked.withColumn("message_id", F.when(F.col("_dead").isNull(), F.col("message_id"))).select(*f.columns)
    return out


def embedded_counts(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """By account: messages, and those with an embedded chunk (a semi join, so that no pair is made and then counted off)."""
    ready = chunks.filter(F.col("embedding").isNotNull()).select("message_id")
    marked = messages.join(ready, "message_id", "left_semi").groupBy("account_id").agg(F.count(F.lit(1)).alias("embedded"))
    every = messages.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))
    return every.join(marked, "account_id", "left").select("account_id", "total", F.coalesce("embedded", F.lit(0)).alias("embedded"))


def embedded_messages(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("embedding").isNotNull()).agg(F.countDistinct("message_id").alias("n_embedded"))


def pending(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks without embedding, the oldest first."""
    rows = chunks.filter(F.col("embedding").isNull()).orderBy("created_at", "chunk_id")
    return rows.limit(limit) if limit else rows


def merge_watermarks(old: DataFrame, seen: DataFrame) -> DataFrame:
    """account_id, mailbox, last_seen_uid: never falls. seen: account_id, mailbox, uid."""
    new = seen.groupBy("account_id", "mailbox").agg(F.max("uid").alias("_uid"))
    return old.join(new, ["account_id", "mailbox"], "full_outer").select("account_id", "mailbox", F.greatest("last_seen_uid", "_uid").alias("last_seen_uid"))


def uid_batches(uids: DataFrame, size: int = 20, run: int = 1 << 16) -> DataFrame:
    """Batches of a mailbox's ascending uids. uids: account_id, mailbox, uid. Numbered within runs of uids and over the runs' counts, so that a large mailbox isn't one task's."""
    rows = uids.withColumn("_run", F.floor(F.col("uid") / run))
    counts = rows.groupBy("account_id", "mailbox", "_run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("account_id", "mailbox").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("account_id", "mailbox", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("account_id", "mailbox", "_run").orderBy("uid")
    placed = rows.withColumn("_r", F.row_number().over(own) - 1).join(before, ["account_id", "mailbox", "_run"])
    return placed.select(*uids.columns, F.floor((F.col("_before") + F.col("_r")) / size).alias("batch"))


def backfill_routes(old: DataFrame, new: DataFrame) -> DataFrame:
    """message_id, route: 'same', 'in_place' (as many chunks, other text: embeddings stay), 'rechunk', 'added', or 'kept' (nothing new). old, new: message_id, chunk_index, text."""
    n_old = old.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_old"))
    n_new = new.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_new"))
    changed = old.alias("o").join(new.alias("n"), ["message_id", "chunk_index"]).groupBy("message_id").agg(F.count(F.when(F.col("o.text") != F.col("n.text"), 1)).alias("n_changed"))
    rows = n_old.join(n_new, "message_id", "full_outer").join(changed, "message_id", "left")
    route = F.when(F.col("n_new").isNull(), "kept").when(F.col("n_old").isNull(), "added").when(F.col("n_old") != F.col("n_new"), "rechunk").when(F.coalesce("n_changed", F.lit(0)) > 0, "in_place").otherwise("same")
    return rows.select("message_id", route.alias("route"))


def backfill(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after a selective backfill: text in place with its embedding, or chunks anew without."""
    routes = backfill_routes(old, new)
    kept = old.join(routes.filter(F.col("route").isin("same", "kept", "in_place")), "message_id", "left_semi")
    texts = new.select("message_id", "chunk_index", F.col("text").alias("_text"))
    kept = kept.join(texts, ["message_id", "chunk_index"], "left").withColumn("text", F.coalesce("_text", "text")).select(*old.columns)
    fresh = new.join(routes.filter(F.col("route").isin("rechunk", "added")), "message_id", "left_semi")
    missing = [F.lit(None).cast(old.schema[c].dataType).alias(c) if c not in new.columns else F.col(c) for c in old.columns]
    return kept.unionByName(fresh.select(*missing))


def sync_status(messages: DataFrame, chunks: DataFrame, sync_state: DataFrame) -> DataFrame:
    """A row for each account with its counters and its sync state."""
    return embedded_counts(messages, chunks).join(sync_state, "account_id", "left")


def pending_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_if(F.col("embedding").isNull()).alias("n_pending"))


def global_status(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over all accounts: messages, and those with an embedded chunk; it has no sync fields."""
    ready = chunks.filter(F.col("embedding").isNotNull()).select("message_id")
    return messages.agg(F.count(F.lit(1)).alias("total")).crossJoin(messages.join(ready, "message_id", "left_semi").agg(F.count(F.lit(1)).alias("embedded")))  # one row each


def sync_started(old: DataFrame, accounts: DataFrame) -> DataFrame:
    """The sync table with these accounts (account_id) marked as running: the last time stays, the error goes."""
    delta = accounts.select("account_id", F.lit(None).cast("timestamp").alias("last_sync_at"), F.lit(None).cast("string").alias("last_error"), F.lit(True).alias("is_running"))
    kept = old.join(accounts.select("account_id"), "account_id", "left_semi").select("account_id", "last_sync_at")
    return upsert(old, delta.drop("last_sync_at").join(kept, "account_id", "left"), ["account_id"], keep_null=False)


def sync_ended(old: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The sync table after runs (account_id, error): not running; the time is stamped only where a run finished without an error."""
    times = results.join(old.select("account_id", F.col("last_sync_at").alias("_before")), "account_id", "left")
    delta = times.select("account_id", F.when(F.col("error").isNull(), now).otherwise(F.col("_before")).alias("last_sync_at"), F.col("error").alias("last_error"), F.lit(False).alias("is_running"))
    return upsert(old, delta, ["account_id"], keep_null=False)


def chunk_texts(chunks: DataFrame, message_id) -> DataFrame:
    """id and text of a message's chunks in their order."""
    return chunks.filter(F.col("message_id") == message_id).orderBy("chunk_index").select("chunk_id", "chunk_index", "text")


def can_sync(settings: DataFrame, now: Column, busy: Column) -> DataFrame:
    """Accounts with a stored cooldown (key cooldown:<account>): seconds left, and whether a sync may start. A value that isn't a number counts as none."""
    rows = settings.filter(F.col("key").startswith("cooldown:")).select(F.expr("substring(key, 10)").alias("account_id"), F.expr("try_cast(value as bigint)").alias("until"))
    left = F.greatest(F.coalesce(F.col("until"), F.lit(0)) - now, F.lit(0))
    return rows.select("account_id", left.alias("seconds_left"), ((left == 0) & ~busy).alias("may_sync"))


def migrate(stores: DataFrame, settings: DataFrame, migrations) -> tuple[DataFrame, DataFrame]:
    """Brings stores (store, version) and their settings (store, key, value) up to the last of migrations (number, description, seeds, whether seeds replace what is there), each where it hasn't run."""
    for number, _, seeds, force in migrations:
        due = stores.filter(F.col("version") < number).select("store")
        for key, value in seeds.items():
            new = due.select("store", F.lit(key).alias("key"), F.lit(value).alias("value"))
            settings = upsert(settings, new, ["store", "key"]) if force else insert_or_ignore(settings, new, ["store", "key"], ["store"])
    last = max(m[0] for m in migrations)
    return stores.withColumn("version", F.greatest("version", F.lit(last))), settings


def message_sketch(chunk_ids: DataFrame) -> DataFrame:
    """One row for a batch of embedded chunks (id: message id, colon, number): a sketch of their messages that merges with others'."""
    return chunk_ids.agg(F.hll_sketch_agg(F.regexp_replace("id", ":[0-9]+$", ""), F.lit(14)).alias("sketch"))


def merged_estimate(sketches: DataFrame) -> DataFrame:
    """About how many messages the batches of all sketches have together (standard error below 1 %)."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n_embedded"))
