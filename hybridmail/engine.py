"""The engine: a store of mail tables, ingest, search and questions over it."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail import models, schema
from hybridmail.errors import Duplicate, InvalidInput, MailError, NotFound, RateLimited
from hybridmail.functions import text as T
from hybridmail.functions.analyzer import analyze_udf
from hybridmail.operators import answers, evaluate, fulltext, fusion, relational, segments, vectors
from hybridmail.shipping import ship
from hybridmail.sources import mail

#: Fixed values, with the keys and names that results depend on. Migrations in order: version, description, settings to seed, whether they replace what is there.
MIGRATIONS = (
    (1, "tables and default models", {"embedding_model": "nomic-embed-text", "chat_model": "llama3.1:8b"}, False),
    (2, "counters", {}, False),
    (3, "default chat model", {"chat_model": "qwen2.5:7b"}, False),
    (4, "newer chat model", {"chat_model": "qwen3:8b"}, True),
    (5, "source of the chat model", {"chat_model_source": "default"}, False),
)

#: Folders of a table that are read together, before they are put together.
MOST_FOLDERS = 32
COOLDOWN_S = 600
AFTER_INGEST = 256


@dataclass(frozen=True)
class SearchOutcome:
    query: str
    results: DataFrame
    used_vector: bool
    used_keyword: bool
    took_ms: int


class Engine:
    """Tables lie below `warehouse`. A write is a folder of a higher number: v<n> holds the whole table, b<n> adds rows to what is before it; readers see a folder once it is whole. One writer at a time.

    Vectors are added to a table of their own and stand in the chunks' column when those are read; writing the chunks anew
    ends them. The full-text index (operators.segments) knows the number of the chunks that it covers, grows by segments with
    them, and is made again where they were written anew."""

    def __init__(self, spark: SparkSession, warehouse: str, *, embedder=None, generator=None, clock: Callable[[], float] = time.time):
        ship(spark)
        self.spark, self.warehouse, self.clock = spark, warehouse.rstrip("/"), clock
        self.embedder, self.generator = embedder or models.HashingEmbedder(), generator or models.ExtractiveGenerator()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.warehouse).getFileSystem(spark._jsc.hadoopConfiguration())
        self._cache: dict[str, tuple[object, object]] = {}
        self._busy: set[str] = set()
        self._lock = threading.Lock()
        self.index = segments.Index(spark, f"{self.warehouse}/index", analyze_udf)
        self.migrate()

    # -- tables ------------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.warehouse, *parts]))

    def _folders(self, name: str) -> list[tuple[int, str]]:
        """Number and name of the whole folders that make up a table, in order."""
        if not self._fs.exists(self._path(name)):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(name))]
        whole = sorted((int(f[1:]), f) for f in found if f[0] in "vb" and self._fs.exists(self._path(name, f, "_SUCCESS")))
        last = max((n for n, f in whole if f[0] == "v"), default=0)
        if name == "chunk_vectors":  # those of chunks that were written anew don't count
            last = max(last, max((n for n, f in self._folders("chunks") if f[0] == "v"), default=0))
        return [(n, f) for n, f in whole if n >= last]

    def version(self, name: str) -> int:
        """The number of the last whole folder of a table; 0 if it was never written."""
        return max((n for n, _ in self._folders(name)), default=0)

    def reserve(self, name: str) -> None:
        """Makes a table's folder, so that what waits for its files has a place to look at."""
        self._fs.mkdirs(self._path(name))

    def stored(self, name: str) -> DataFrame:
        """A table as its own folders have it: chunks without the vectors that came later."""
        return self._stored(name)

    def _stored(self, name: str) -> DataFrame:
        folders = [f"{self.warehouse}/{name}/{f}" for _, f in self._folders(name)]
        return self.spark.read.schema(schema.STORED[name]).parquet(*folders) if folders else self.spark.createDataFrame([], schema.STORED[name])

    def table(self, name: str) -> DataFrame:
        rows = self._stored(name)
        if name != "chunks" or not self._folders("chunk_vectors"):
            return rows
        late = self._stored("chunk_vectors").select("id", *[F.col(c).alias(f"_{c}") for c in ("embedding", "embedding_dim", "embedding_model")])
        return rows.join(late, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c.startswith("embedding") else c for c in rows.columns])

    def _next(self, name: str) -> int:
        return 1 + max(self.version(n) for n in (("chunks", "chunk_vectors") if name in ("chunks", "chunk_vectors") else (name,)))

    def put(self, name: str, df: DataFrame, by: str | None = None, number: int | None = None) -> None:
        """Writes a table whole."""
        before = {f for _, f in self._folders(name)}
        out = df.select(*self._stored(name).columns)
        new = f"v{number or self._next(name)}"
        (out.sortWithinPartitions(by) if by else out).write.mode("overwrite").parquet(f"{self.warehouse}/{name}/{new}")
        for f in self._fs.listStatus(self._path(name)):  # what made up the table before stays for readers that have begun
            if f.getPath().getName() not in before | {new}:
                self._fs.delete(f.getPath(), True)

    def append(self, name: str, df: DataFrame, number: int | None = None) -> None:
        """Adds rows to a table; many small additions are put together at times (chunks by `compact`)."""
        df.select(*self._stored(name).columns).write.mode("overwrite").parquet(f"{self.warehouse}/{name}/b{number or self._next(name)}")
        if len(self._folders(name)) > MOST_FOLDERS and number is None:
            self.put(name, self._stored(name))

    def compact(self) -> None:
        """Puts the chunks' folders and their vectors together into one table; the index goes on covering it."""
        covered, number = self.index.covers == self.version("chunks"), self._next("chunks")
        self.put("chunks", self.table("chunks"), "message_id", number)
        if covered:
            self.index.cover(number)

    def cached(self, key: str, version: object, make: Callable[[], object]) -> object:
        """What was made of tables, kept until their versions change."""
        if key not in self._cache or self._cache[key][0] != version:
            old = self._cache.pop(key, (None, None))[1]
            if isinstance(old, DataFrame):
                old.unpersist()
            made = make()
            self._cache[key] = (version, made.persist() if isinstance(made, DataFrame) else made)
        return self._cache[key][1]

    # -- set-up ------------------------------------------------------------------------------------------------------

    def migrate(self) -> int:
        """Runs what hasn't run yet; the version reached."""
        done = self.table("schema_versions").agg(F.max("version")).first()[0] or 0
        for number, description, seeds, force in MIGRATIONS:
            if number <= done:
                continue
            if seeds:
                old = self.table("app_settings")
                new = self.spark.createDataFrame(list(seeds.items()), "key string, value string").withColumn("updated_at", F.current_timestamp())
                self.put("app_settings", relational.upsert(old, new, ["key"]) if force else relational.insert_or_ignore(old, new, ["key"], ["key"]))
            row = self.spark.createDataFrame([(number, description)], "version int, description string").withColumn("applied_at", F.current_timestamp())
            self.put("schema_versions", self.table("schema_versions").unionByName(row))
        return max(done, MIGRATIONS[-1][0])

    def setting(self, key: str) -> str | None:
        row = self.table("app_settings").filter(F.col("key") == key).select("value").first()
        return row[0] if row else None

    def set_setting(self, key: str, value: str) -> None:
        new = self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("updated_at", F.current_timestamp())
        self.put("app_settings", relational.upsert(self.table("app_settings"), new, ["key"]))

    def set_chat_model(self, name: str) -> None:
        """The user's choice. What was loaded before is let go; the same model again changes nothing but whose choice it is."""
        if not name.strip():
            raise InvalidInput("no model named")
        old = self.setting("chat_model")
        if name != old:
            self._swap(old, name)
        self.set_setting("chat_model_source", "user")

    def _swap(self, old: str | None, name: str) -> None:
        if old and hasattr(self.generator, "unload"):
            self.generator.unload(old)
        if hasattr(self.generator, "chat_model"):
            self.generator.chat_model = name
        self.set_setting("chat_model", name)

    def _machine(self, ram_gb: float, installed: list[str]) -> DataFrame:
        return self.spark.createDataFrame([("here", float(ram_gb), installed, self.setting("chat_model"))], "machine string, ram_gb double, installed array<string>, current string")

    def auto_pick(self, installed: list[str], ram_gb: float | None = None) -> dict:
        """Takes the best chat model that fits and is there, and remembers it, unless the user has chosen one. state and pick."""
        row = answers.auto_pick(self._machine(ram_gb or machine_memory_gb(), installed)).select("state", "pick").first().asDict()
        if self.setting("chat_model_source") == "user":
            return {"state": "user", "pick": self.setting("chat_model")}
        if row["state"] == "model":
            if row["pick"] != self.setting("chat_model"):
                self._swap(self.setting("chat_model"), row["pick"])
            self.set_setting("chat_model_source", "auto")
        return row

    def list_models(self, installed: list[str], ram_gb: float | None = None) -> DataFrame:
        return answers.list_models(self._machine(ram_gb or machine_memory_gb(), installed), self.setting("embedding_model") or "")

    def model_status(self) -> dict:
        """Of a generator that is a client: whether its server answers and holds the models; offline ones always do."""
        return self.generator.health() if hasattr(self.generator, "health") else {"reachable": True, "embedder": True, "chat_model": True}

    def add_account(self, email: str, *, host: str = "", port: int = 993, display_name: str | None = None, password: str | None = None, secrets: dict | None = None) -> str:
        """secrets: where the password goes (a mapping, as of a key ring); it goes first, and is taken back if the account can't be stored."""
        email = email.strip()
        if not email or (secrets is not None and not password):
            raise InvalidInput("an e-mail address is needed, and a password where there is a place for it")
        if not self.table("accounts").filter(F.col("email") == email).isEmpty():
            raise Duplicate(email)
        account = uuid.uuid5(uuid.NAMESPACE_URL, f"mailto:{email}").hex
        row = self.spark.createDataFrame([(account, email, display_name, host.strip() or None, port, "app_password", f"account:{account}")], "id string, email string, display_name string, imap_host string, imap_port int, auth_kind string, keyring_ref string")
        row = row.withColumn("imap_host", F.coalesce("imap_host", T.imap_host(F.col("email")))).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
        if secrets is not None:
            secrets[f"account:{account}"] = password
        try:
            self.append("accounts", row)
        except Exception:
            if secrets is not None:
                secrets.pop(f"account:{account}", None)
            raise
        state = self.spark.createDataFrame([(account, None, None, False)], schema.SYNC_STATE)
        self.put("sync_state", relational.insert_or_ignore(self.table("sync_state"), state, ["account_id"], ["account_id"]))
        return account

    def accounts(self) -> DataFrame:
        return self.table("accounts").orderBy("created_at", "id")

    def remove_account(self, account: str) -> None:
        tables = {n: self.table(n) for n in ("accounts", "mailboxes", "messages", "chunks", "sync_state", "search_feedback")}
        left = relational.delete_account(tables, self.spark.createDataFrame([(account,)], "id string"))
        for name in ("search_feedback", "chunks", "messages", "mailboxes", "sync_state", "accounts"):  # what hangs on others first
            self.put(name, left[name])

    # -- ingest ------------------------------------------------------------------------------------------------------

    def scan(self, path: str, apple: bool = False) -> int:
        return mail.discover(self.spark, path, apple).count()

    def ingest_path(self, path: str, account: str, *, apple: bool = False, embed: bool = True) -> dict:
        """Imports the mail files at path: imported, skipped (unreadable or known messages) and errors (files). Then embeds some of the backlog, as a sync does."""
        read = mail.parse_path(self.spark, path, apple).persist()
        try:
            parsed = mail.numbered(read)
            counts = mail.report(parsed).first()
            rows = parsed.filter("status = 'parsed'").withColumn("account_id", F.lit(account))
            rows = rows.withColumns({"id": F.md5(F.concat_ws("\x01", "account_id", F.coalesce("message_id", F.concat("path", F.lit("#"), F.col("msg_index").cast("string"))))), "rfc822_message_id": F.col("message_id"), "mailbox_id": F.lit(None).cast("string"), "imap_uid": F.lit(None).cast("long")})
            n = self._ingest(rows, ["path", "msg_index"])
        finally:
            read.unpersist()
        if embed and n:
            self.embed_after_ingest()
        return {"imported": n, "skipped": counts["skipped"] + counts["imported"] - n, "errors": counts["errors"]}

    def _ingest(self, rows: DataFrame, order: list[str]) -> int:
        """Stores messages that aren't there yet (by account and Message-ID, whatever they came from), their chunks and postings; how many."""
        # The bodies' clean text is used for the snippet and for the chunks.
        rows = rows.withColumn("_clean", T.clean_body_udf(F.coalesce("body_plain", "body_html", F.lit(""))))
        rows = rows.withColumns({"snippet": T.compact(F.col("_clean"), T.SNIPPET), "is_deleted": F.lit(False), "created_at": F.current_timestamp()})
        known = self.table("messages")
        fresh = relational.first_wins(rows, known, "account_id", "rfc822_message_id", order).join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]).persist()
        try:
            n = fresh.count()
            if not n:
                return 0
            pieces = fresh.select("id", F.posexplode(T.split_chunks_udf(T.chunk_input(F.col("subject"), F.coalesce("sender", "sender_email"), F.col("recipients"), F.col("_clean")))).alias("chunk_index", "text"))
            was, number = self.version("chunks"), self._next("chunks")
            indexed = self.index.covers == was
            # Chunks are written first: a stop before the messages leaves chunks that the next attempt writes again under the same ids.
            new = _chunks(pieces).join(self._stored("chunks").select("id"), "id", "left_anti")
            self.append("chunks", new, number)
            if indexed:
                self.index.add(self.spark.read.schema(schema.STORED["chunks"]).parquet(f"{self.warehouse}/chunks/b{number}").withColumnRenamed("id", "chunk_id"), number)
            self.append("messages", fresh.select(*known.columns))
            if len(self._folders("chunks")) > MOST_FOLDERS:
                self.compact()
            return n
        finally:
            fresh.unpersist()

    def start(self, installed: list[str] | None = None, ram_gb: float | None = None, *, embed: bool = True):
        """What a program does when it opens the store: counts and vectors are brought into memory, the index up to date, a chat model picked if models are named, and the stream of embeddings started. The stream's query, or None."""
        self._counts()
        self._units().count()
        self._index()[1].count()
        if installed is not None:
            self.auto_pick(installed, ram_gb)
        return self.embed_stream() if embed else None

    # -- sync --------------------------------------------------------------------------------------------------------

    @contextmanager
    def _single(self, account: str) -> Iterator[None]:
        with self._lock:
            if account in self._busy:
                raise MailError(f"{account} is being synced")
            self._busy.add(account)
        try:
            yield
        finally:
            with self._lock:
                self._busy.discard(account)

    def sync_cooldown_until(self, account: str) -> int:
        """Until when (seconds of the epoch) the account mustn't be synced, as a throttled sync left it; 0 if it may."""
        value = self.setting(f"cooldown:{account}") or ""
        return int(value) if value.isdigit() and int(value) > self.clock() else 0

    def can_sync(self, account: str) -> bool:
        return account not in self._busy and not self.sync_cooldown_until(account)

    def sync(self, account: str, feed_path: str | dict, *, full: bool = False, files_per_batch: int = 20, on_progress: Callable[[str, int], None] | None = None, before_batch: Callable[[int], None] | None = None) -> dict:
        """Takes up what a feed (Parquet files of ingest.FEED, or the options of a mailbox, see sources.feed) has for the account since the last sync; full: all of it again, which the dedup lets change nothing. Then embeds some of it, as far as that goes.

        One sync of an account at a time, none while it cools down; a throttled one makes it cool down."""
        from hybridmail.streaming import ingest

        say = on_progress or (lambda phase, n: None)
        if until := self.sync_cooldown_until(account):
            raise RateLimited(f"{account} cools down until {until}")
        one = self.spark.createDataFrame([(account,)], "account_id string")
        now, total = F.timestamp_seconds(F.lit(int(self.clock()))), 0
        with self._single(account):
            say("connecting", 0)
            self.put("sync_state", relational.sync_started(self.table("sync_state"), one))

            raised: list[Exception] = []  # what a stream makes of an error hides it

            def attempt(batch: DataFrame, number: int) -> None:
                try:
                    store(batch, number)
                except Exception as e:
                    raised.append(e)
                    raise

            def store(batch: DataFrame, number: int) -> None:
                nonlocal total
                if before_batch:
                    before_batch(number)
                rows = batch.filter(F.col("account_id") == account)
                say("fetching", total)
                box = F.md5(F.concat_ws("\x01", "account_id", "mailbox"))
                named = {"id": F.md5(F.concat_ws("\x01", "account_id", F.coalesce("message_id", F.concat_ws("#", "mailbox", F.col("uid").cast("string"))))), "rfc822_message_id": F.col("message_id"), "thread_id": F.col("message_id"), "mailbox_id": box, "imap_uid": F.col("uid"), "body_plain": F.col("body"), "sent_at": F.col("internal_date"), "received_at": F.col("internal_date"), "raw_size": F.octet_length("body").cast("long"), "has_attachments": F.lit(False)}
                none = {c: F.lit(None).cast("string") for c in ("sender", "sender_email", "sender_domain", "recipients", "body_html")}
                say("storing", total)
                total += self._ingest(rows.withColumns(named | none), ["mailbox", "uid"])
                # Watermarks rise after the messages are stored, so that a stop in between repeats rows and skips none.
                seen = rows.groupBy("account_id", "mailbox").agg(F.max("uid").alias("seen")).withColumn("id", box)
                old = self.table("mailboxes")
                boxes = old.join(seen.select("id", "seen"), "id", "left").withColumns({"last_seen_uid": F.greatest("last_seen_uid", "seen"), "last_synced_at": F.when(F.col("seen").isNotNull(), now).otherwise(F.col("last_synced_at"))}).select(*old.columns)
                add = seen.join(old.select("id"), "id", "left_anti").select("id", "account_id", F.col("mailbox").alias("name"), F.lit("/").alias("delimiter"), F.lit(None).cast("long").alias("uid_validity"), (F.col("seen") + 1).alias("uid_next"), F.col("seen").alias("last_seen_uid"), now.alias("last_synced_at"))
                self.put("mailboxes", boxes.unionByName(add))

            error = None
            try:
                say("searching", 0)
                ingest.run(self.spark, feed_path, attempt, checkpoint=f"{self.warehouse}/_sync/{account}{'-' + uuid.uuid4().hex if full else ''}", files_per_batch=files_per_batch)
            except Exception as e:
                cause = raised[0] if raised else e
                error = str(cause).split("\n")[0][:500]
                say("failed", total)
                if isinstance(cause, RateLimited) or mail.throttled(error):
                    self.set_setting(f"cooldown:{account}", str(int(self.clock()) + COOLDOWN_S))
                    raise RateLimited(error) from e
                raise cause from e
            finally:
                ended = self.spark.createDataFrame([(account, error)], "account_id string, error string")
                self.put("sync_state", relational.sync_ended(self.table("sync_state"), ended, now))
            say("done", total)
        embedded = self.embed_after_ingest()
        return {"stored": total, "embedded": embedded}

    # -- embedding ---------------------------------------------------------------------------------------------------

    def embed_after_ingest(self) -> int:
        """Some of the backlog, best effort: an embedder that isn't there is no error."""
        try:
            return self.embed_pending(AFTER_INGEST, stop_on_error=True)["embedded"]
        except Exception:  # noqa: BLE001  whatever goes wrong here, the messages are stored
            return 0

    def _pending(self) -> DataFrame:
        """Chunks without a vector: those stored without one whose id the vectors don't have either."""
        return self._stored("chunks").filter("embedding is null").join(self._stored("chunk_vectors").select("id"), "id", "left_anti")

    def add_vectors(self, ready: DataFrame) -> None:
        """Adds vectors, and a sketch of the messages that they are of."""
        self.append("chunk_vectors", ready)
        self.append("vector_sketches", relational.message_sketch(ready))

    def embedded_about(self) -> int:
        """About how many messages have a vector, from the sketches of the batches alone: no table of chunks is read. Vectors that ended since (chunks written anew) are still counted until `resketch`."""
        return relational.merged_estimate(self._stored("vector_sketches")).first()[0]

    def resketch(self) -> None:
        """The sketches anew, as one of all vectors."""
        self.put("vector_sketches", relational.message_sketch(self.table("chunks").filter("embedding is not null").select("id")))

    def embed_stream(self, **options):
        """Embeds chunks as they are added, by a streaming query (streaming.embedding)."""
        from hybridmail.streaming import embedding

        return embedding.start(self, **options)

    def embed_pending(self, limit: int = 256, *, stop_on_error: bool = False) -> dict:
        """Embeds the oldest chunks without a vector. One that fails is counted and the others go on; with stop_on_error nothing after the first failure is kept, as a backlog run of the mail client does."""
        from hybridmail.streaming.ingest import drain_embeddings

        done = drain_embeddings(self._pending().withColumnRenamed("id", "chunk_id"), self.embedder.embed, limit, embed_many=getattr(self.embedder, "embed_many", None), stop_on_error=stop_on_error).persist()
        try:
            counts = done.agg(F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
            if counts["embedded"]:
                ready = done.filter("error is null").select(F.col("chunk_id").alias("id"), "embedding", "embedding_dim", F.lit(self.embedder.name).alias("embedding_model"))
                self.add_vectors(ready)
        finally:
            done.unpersist()
        return counts

    def rechunk(self) -> None:
        """All chunks anew from the stored bodies, without vectors; a message without text keeps its chunks."""
        old = self.table("chunks")
        fresh = self._fresh_chunks()
        kept = old.join(fresh.select("message_id").distinct(), "message_id", "left_anti")
        self.put("chunks", kept.unionByName(fresh.select(*old.columns)), "message_id")

    def backfill(self) -> dict:
        """Text changed in place where the number of chunks is the same (vectors stay), else that message's chunks anew."""
        old, fresh = self.table("chunks"), self._fresh_chunks()
        routes = {r["route"]: r["count"] for r in relational.backfill_routes(old.select("message_id", "chunk_index", "text"), fresh.select("message_id", "chunk_index", "text")).groupBy("route").count().collect()}
        self.put("chunks", relational.backfill(old, fresh), "message_id")
        return routes

    def _fresh_chunks(self) -> DataFrame:
        clean = T.clean_body_udf(F.coalesce("body_plain", "body_html", F.lit("")))
        given = T.chunk_input(F.col("subject"), F.coalesce("sender", "sender_email"), F.col("recipients"), F.col("_clean"))
        return _chunks(self.table("messages").withColumn("_clean", clean).select("id", F.posexplode(T.split_chunks_udf(given)).alias("chunk_index", "text")))

    # -- search ------------------------------------------------------------------------------------------------------

    def _index(self) -> tuple[segments.Index, DataFrame]:
        """The index of the chunks as they are, made anew where it doesn't cover them, and its postings."""
        number = self.version("chunks")
        if number != self.index.covers:
            self.index.rebuild(self._stored("chunks").withColumnRenamed("id", "chunk_id"), number)
        return self.index, self.cached("postings", number, lambda: segments.by_block(self.index.postings()))

    def _units(self) -> DataFrame:
        version = (self.version("chunks"), self.version("chunk_vectors"))
        return self.cached("units", version, lambda: self.table("chunks").filter("embedding is not null").select("message_id", vectors.normalised(F.col("embedding")).alias("unit")))

    def _messages(self) -> DataFrame:
        m = self.table("messages").withColumnRenamed("id", "message_id")
        return m.withColumns({"is_bulk": T.is_bulk(F.col("body_plain"), F.col("sender_email")), "body_preview": T.preview(F.coalesce("body_plain", F.lit("")))} | {c: F.coalesce(c, F.lit("")) for c in ("subject", "sender", "snippet")})

    def search(self, words: str, limit: int = 20, *, now=None, semantic: bool = True, account: str | None = None) -> SearchOutcome:
        """Hybrid search; keyword alone if nothing can be embedded. A blank query finds nothing."""
        began, now = time.monotonic(), F.current_timestamp() if now is None else now
        pool = fusion.pool_size(limit)
        rows = self._messages()
        within = None
        if account:  # before the pools are cut, so that other accounts take no places in them
            rows = rows.filter(F.col("account_id") == account)
            within = rows.select("message_id")
        found: list = []
        if words.strip() and fulltext.phrases(words):
            index, postings = self._index()
            found = index.search(words, pool, within=within, postings=postings).rows
        keyword = fusion.keyword_messages(fulltext.pooled(self.spark, found, "string"))
        vector = query = None
        if semantic and words.strip():
            query = self._embedded(words)
        units = self._units() if query is not None and any(query) else None
        used_vector = units is not None and not units.isEmpty()
        if used_vector:
            vector = vectors.top_messages(units if within is None else units.join(within, "message_id", "left_semi"), query, pool)
        else:
            vector = self.spark.createDataFrame([], "message_id string, similarity double, vector_rank int")
        results = fusion.weigh(fusion.fuse(keyword, vector), rows, now, limit).select(*RESULT)
        return SearchOutcome(words, results.orderBy(F.desc("combined_score"), "message_id"), used_vector, bool(found), int(1000 * (time.monotonic() - began)))

    def _embedded(self, words: str) -> list[float] | None:
        try:
            return self.embedder.embed(words)
        except Exception:  # noqa: BLE001  whatever an embedder raises, keywords still work
            return None

    def search_batch(self, queries: list[str], limit: int = 20, *, now=None, semantic: bool = True) -> DataFrame:
        """search() of many queries (a stated list) in one plan: query_id (the place in the list), query, and the columns of a search's results."""
        now, pool = F.current_timestamp() if now is None else now, fusion.pool_size(limit)
        asked = [(i, q) for i, q in enumerate(queries) if q.strip()]
        keyword = fusion.keyword_messages(self._index()[0].search_batch(asked, pool), ["query_id"])
        near = [(i, [float(x) for x in v]) for i, q in asked if semantic and (v := self._embedded(q)) is not None and any(v)]
        given = self.spark.createDataFrame(near, "query_id long, v array<double>").select("query_id", vectors.normalised(F.col("v")).alias("query_unit"))
        vector = vectors.top_messages_batch(self._units(), given, pool)
        results = fusion.weigh(fusion.fuse(keyword, vector, by=["query_id"]), self._messages(), now, limit, by=["query_id"])
        names = self.spark.createDataFrame(asked, "query_id long, query string")
        return results.join(names, "query_id").select("query_id", "query", *RESULT)

    def ask(self, question: str, limit: int = 8, *, now=None, on_token: Callable[[str], None] | None = None) -> answers.Answer:
        if not question.strip():
            raise InvalidInput("no question")
        now = F.current_timestamp() if now is None else now
        found = self.search(question, limit, now=now).results
        hits = found.withColumn("relevance_rank", F.row_number().over(Window.orderBy(F.desc("combined_score"), "message_id")) - 1)
        rows = answers.ordered(hits, question).withColumn("block", answers.context_block(now)).orderBy("n").collect()  # at most `limit` rows
        if not rows:
            return answers.Answer(question, answers.NOT_FOUND, None, [])
        prompt = question + "\n\n" + "\n".join(r["block"] for r in rows)
        answer = models.folded(self.generator.tokens(answers.INSTRUCTIONS, prompt, answers.Options()), on_token)
        given = self.spark.createDataFrame([("a", answer)], "answer_id string, answer string")
        sources = self.spark.createDataFrame([("a", r["n"], r["message_id"], r["subject"], r["sender"]) for r in rows], "answer_id string, n int, message_id string, subject string, sender string")
        cited = answers.citations(given, sources).orderBy("n").collect()
        return answers.Answer(question, answer, self.generator.name, [r.asDict() for r in cited])

    def status(self) -> DataFrame:
        """A row for each account."""
        chunks = self.table("chunks")
        return relational.sync_status(self.table("messages").withColumnRenamed("id", "message_id"), chunks, self.table("sync_state"))

    def account_status(self, account: str) -> dict:
        row = self.status().filter(F.col("account_id") == account).first()
        if row is None and self.table("accounts").filter(F.col("id") == account).isEmpty():
            raise NotFound(account)
        return row.asDict() if row else {"account_id": account, "total": 0, "embedded": 0} | self.table("sync_state").filter(F.col("account_id") == account).drop("account_id").first().asDict()

    def _counts(self) -> dict:
        """Counts over all accounts, kept until a table they come from has a new version."""
        version = tuple(self.version(n) for n in ("messages", "chunks", "chunk_vectors"))

        def count() -> dict:
            chunks = self.table("chunks")
            row = relational.global_status(self.table("messages").withColumnRenamed("id", "message_id"), chunks).crossJoin(relational.pending_count(chunks)).first()  # one row each
            return row.asDict()

        return self.cached("counts", version, count)

    def global_status(self) -> dict:
        return {k: self._counts()[k] for k in ("total", "embedded")}

    def total_messages(self) -> int:
        return self._counts()["total"]

    def pending_chunks(self) -> int:
        return self._counts()["n_pending"]

    def chunk_texts(self, message: str) -> list[tuple[str, str]]:
        """Ids and texts of a message's chunks, in order."""
        return [(r["chunk_id"], r["text"]) for r in relational.chunk_texts(self._stored("chunks").withColumnRenamed("id", "chunk_id"), message).collect()]

    def evaluate(self, cases: list[tuple[str, list[str], list[str]]], k: int = 5, **options) -> DataFrame:
        """cases: query, substrings of relevant hits, substrings of junk; the measures by query."""
        rows = None
        for words, _, _ in cases:
            hits = self.search(words, k, **options).results
            one = hits.select(F.lit(words).alias("query_id"), F.row_number().over(Window.orderBy(F.desc("combined_score"), "message_id")).alias("rank"), F.concat_ws(" ", "subject", "sender_email").alias("haystack"), "similarity", "keyword_score")
            rows = one if rows is None else rows.unionByName(one)
        return evaluate.precision(evaluate.judged(rows, self.spark.createDataFrame(cases, "query_id string, relevant array<string>, junk array<string>")), k)


RESULT = ("message_id", "account_id", "rfc822_message_id", "subject", "sender", "sender_email", "received_at", "snippet", "body_preview", "similarity", "keyword_score", "combined_score", "is_bulk")


def _chunks(pieces: DataFrame) -> DataFrame:
    """Rows of the chunk table from id (of the message), chunk_index, text."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return pieces.select(F.concat_ws(":", "id", F.col("chunk_index").cast("string")).alias("id"), F.col("id").alias("message_id"), "chunk_index", "text", none("embedding", "array<float>"), none("embedding_dim", "int"), none("embedding_model", "string"), F.current_timestamp().alias("created_at"))


def machine_memory_gb() -> float:
    with open("/proc/meminfo") as f:
        return int(next(line for line in f if line.startswith("MemTotal")).split()[1]) / 2**20


__all__ = ["MIGRATIONS", "Engine", "SearchOutcome", "machine_memory_gb"]
