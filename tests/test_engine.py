"""The engine end to end, and streaming with a restart."""

import threading

import pytest
from pyspark.sql import functions as F

from hybridmail import models
from hybridmail.engine import MIGRATIONS, Engine
from hybridmail.errors import Duplicate, InvalidInput, MailError, ModelUnavailable, RateLimited
from hybridmail.sources import mail
from hybridmail.streaming import background, ingest

MAILS = {
    "a.eml": b"From: Ann <ann@x.example>\nTo: me@y.example\nSubject: Contract review\nDate: Mon, 01 Apr 2024 08:00:00 +0000\nMessage-ID: <1@x>\n\nThe contract needs a review before Friday.\n",
    "b.eml": b"From: Shop <deals@shop.example>\nTo: me@y.example\nSubject: Contract deals\nDate: Mon, 01 Apr 2024 08:00:00 +0000\nMessage-ID: <2@x>\n\nBuy a contract phone. To unsubscribe click here.\n",
    "c.eml": b"From: Bob <bob@x.example>\nTo: me@y.example\nSubject: Lunch\nDate: Tue, 02 Apr 2024 08:00:00 +0000\nMessage-ID: <3@x>\n\nNoon at the corner.\n",
    "d.eml": b"From: Bob <bob@x.example>\nTo: me@y.example\nSubject: Lunch\nDate: Tue, 02 Apr 2024 08:00:00 +0000\nMessage-ID: <3@x>\n\nNoon at the corner.\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mail")
    for name, data in MAILS.items():
        (folder / name).write_bytes(data)
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('warehouse')}")
    account = e.add_account(" me@icloud.com ")
    assert e.scan(str(folder)) == 4
    assert e.ingest_path(str(folder), account, embed=False) == {"imported": 3, "skipped": 1, "errors": 0}
    assert e.ingest_path(str(folder), account, embed=False) == {"imported": 0, "skipped": 4, "errors": 0}
    e.account, e.folder = account, folder
    return e


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def test_migrations(engine):
    assert engine.migrate() == MIGRATIONS[-1][0]
    assert engine.setting("chat_model") == "qwen3:8b" and engine.setting("embedding_model") == "nomic-embed-text"
    assert engine.table("schema_versions").count() == len(MIGRATIONS)


def test_accounts(engine):
    assert engine.accounts().select("email", "imap_host").first()[:] == ("me@icloud.com", "imap.mail.me.com")
    with pytest.raises(Duplicate):
        engine.add_account("me@icloud.com")
    with pytest.raises(InvalidInput):
        engine.add_account("  ")


def test_keyword_then_hybrid(engine):
    out = engine.search("contract", now=now())
    assert out.used_keyword and not out.used_vector
    assert [r["subject"] for r in out.results.collect()] == ["Contract review", "Contract deals"]
    assert engine.embed_pending(1) == {"embedded": 1, "failed": 0}
    assert engine.embed_pending() == {"embedded": 2, "failed": 0}
    out = engine.search("contract review", now=now())
    assert out.used_vector and out.results.first()["similarity"] > 0.3 or out.results.first()["similarity"] is None
    blank = engine.search("  ", now=now())
    assert blank.results.count() == 0 and not blank.used_keyword
    assert engine.status().first()["embedded"] == 3


def test_keyword_is_used_only_with_hits(engine):
    out = engine.search("zebra", now=now(), semantic=False)
    assert not out.used_keyword and not out.used_vector and out.results.count() == 0


def test_batch_search_is_search(engine):
    queries = ["contract", "  ", "lunch corner", "contract-review", "zebra"]
    got = {}
    for r in engine.search_batch(queries, 5, now=now()).collect():
        got.setdefault(r["query_id"], []).append((r["message_id"], round(r["combined_score"], 9)))
    for i, q in enumerate(queries):
        alone = [(r["message_id"], round(r["combined_score"], 9)) for r in engine.search(q, 5, now=now()).results.collect()]
        assert sorted(got.get(i, [])) == sorted(alone), q


def test_counts_and_texts(engine):
    assert engine.total_messages() == 3 and engine.global_status() == {"total": 3, "embedded": 3} and engine.pending_chunks() == 0
    message = engine.search("lunch", now=now()).results.first()["message_id"]
    assert [t.split("\n")[0] for _, t in engine.chunk_texts(message)] == ["Subject: Lunch"]
    assert engine.account_status(engine.account)["total"] == 3


def test_models(engine):
    assert engine.auto_pick(["granite4.1:3b"], 48)["state"] == "needs_pull" and engine.setting("chat_model") == "qwen3:8b"
    assert engine.auto_pick(["gpt-oss:20b"], 32) == {"state": "model", "pick": "gpt-oss:20b"} and engine.setting("chat_model") == "gpt-oss:20b"
    engine.set_chat_model("qwen3:8b")
    assert engine.auto_pick(["gpt-oss:20b"], 32) == {"state": "user", "pick": "qwen3:8b"} and engine.setting("chat_model") == "qwen3:8b"
    assert engine.model_status()["reachable"] and engine.list_models(["qwen3:8b"], 16).filter("installed").count() == 1


def test_ask(engine):
    parts = []
    a = engine.ask("when is the contract review?", now=now(), on_token=parts.append)
    assert "[1]" in a.answer and "".join(parts) == a.answer and a.citations[0]["cited"]
    assert engine.ask("zebra quantum", now=now()).citations == []
    with pytest.raises(InvalidInput):
        engine.ask(" ")


def test_backfill_keeps_vectors(engine):
    assert engine.backfill() == {"same": 3}
    assert engine.table("chunks").filter("embedding is not null").count() == 3
    engine.rechunk()
    assert engine.table("chunks").filter("embedding is not null").count() == 0


def test_one_failing_chunk_does_not_block(engine):
    class Picky:
        name = "picky"

        def embed(self, text):
            if "Lunch" in text:
                raise ValueError("no lunch")
            return [1.0, 0.0]

    keep, engine.embedder = engine.embedder, Picky()
    assert engine.embed_pending() == {"embedded": 2, "failed": 1}
    engine.embedder = keep


def test_evaluate(engine):
    r = engine.evaluate([("contract", ["review"], ["deals"])], now=now()).first()
    assert (r["n_scored"], r["n_relevant"], r["n_junk"]) == (2, 1, 1)


def test_remove(engine):
    engine.remove_account(engine.account)
    assert [engine.table(t).count() for t in ("accounts", "messages", "chunks", "sync_state")] == [0, 0, 0, 0]


@pytest.fixture()
def two(spark, tmp_path):
    """Two accounts; the words of one mail of the second stand in four stronger ones of the first."""
    e = Engine(spark, f"file://{tmp_path}/w", clock=lambda: 1_000_000)
    a, b = e.add_account("a@x.example"), e.add_account("b@x.example")
    rows = [(a, "in", i, f"a{i}", "budget budget", "budget " * 5, None) for i in range(4)] + [(b, "in", 9, "b9", "note", "the budget of next year and other things", None)]
    spark.createDataFrame(rows, ingest.FEED).write.parquet(f"file://{tmp_path}/feed")
    return e, a, b, f"file://{tmp_path}/feed"


def test_an_account_of_its_own(two):
    e, a, b, path = two
    for account in (a, b):
        e.sync(account, path)
    assert [r["account_id"] for r in e.search("budget", 2, account=b, now=now()).results.collect()] == [b]
    assert e.search("budget", 2, account=b, now=now(), semantic=False).results.count() == 1
    assert {r["account_id"] for r in e.search("budget", 2, now=now(), semantic=False).results.collect()} == {a}


def test_sync_ends_in_search_hits(two, spark):
    e, a, _, path = two
    phases = []

    def fail(number):
        raise ValueError("line lost")

    with pytest.raises(Exception, match="line lost"):
        e.sync(a, path, before_batch=fail)
    state = e.table("sync_state").filter(F.col("account_id") == a).first()
    assert "line lost" in state["last_error"] and not state["is_running"] and state["last_sync_at"] is None
    again = Engine(spark, e.warehouse, clock=e.clock)  # as after a restart
    assert again.sync(a, path, on_progress=lambda phase, n: phases.append(phase)) == {"stored": 4, "embedded": 4}
    assert phases[0] == "connecting" and phases[1] == "searching" and phases[-1] == "done" and {"fetching", "storing"} <= set(phases)
    assert again.search("budget", now=now()).results.count() == 4
    state = again.table("sync_state").filter(F.col("account_id") == a).first()
    assert state["last_error"] is None and state["last_sync_at"] is not None
    assert again.sync(a, path)["stored"] == 0 and again.sync(a, path, full=True)["stored"] == 0
    assert again.table("mailboxes").select("name", "last_seen_uid").first()[:] == ("in", 3)
    # The next messages, and their postings, are added to what is there; a mail that came by file isn't stored again.
    spark.createDataFrame([(a, "in", 20, "a20", "fresh", "quite fresh words", None), (a, "in", 21, "a1", "budget budget", "known by its id", None)], ingest.FEED).write.mode("append").parquet(path)
    assert again.sync(a, path)["stored"] == 1
    assert len(again.index.segments()) == 2 and again.index.covers == again.version("chunks") and again.search("fresh", now=now()).results.count() == 1


def test_throttled_sync_cools_down(two):
    e, a, b, path = two

    def throttled(number):
        raise RuntimeError("UNAVAILABLE: too many requests")

    with pytest.raises(RateLimited):
        e.sync(a, path, before_batch=throttled)
    assert e.sync_cooldown_until(a) == 1_000_600 and not e.can_sync(a) and e.can_sync(b)
    with pytest.raises(RateLimited, match="cools down"):
        e.sync(a, path)
    e.clock = lambda: 1_000_601
    assert e.can_sync(a) and e.sync(a, path)["stored"] == 4
    with e._single(a), pytest.raises(MailError, match="being synced"):
        e.sync(a, path)


def test_background_loops(two):
    e, a, _, path = two
    e.embedder, kept = type("Down", (), {"name": "down", "embed": lambda self, text: 1 / 0})(), e.embedder
    assert e.sync(a, path) == {"stored": 4, "embedded": 0}
    e.embedder, stop, waits = kept, threading.Event(), []

    def wait(s):
        waits.append(s)
        if s == background.IDLE_S:
            stop.set()

    assert background.embed_backlog(e, stop, wait=wait) == 4 and waits == [background.PAUSE_S, background.IDLE_S]
    stop = threading.Event()
    assert background.auto_sync(e, a, path, stop, wait=lambda s: stop.set()) == 1


def test_stop_on_error(two):
    e, a, _, path = two

    class Third:
        name, n = "third", 0

        def embed(self, text):
            self.n += 1
            if self.n == 3:
                raise ValueError("third")
            return [1.0]

    e.embedder = type("Down", (), {"name": "down", "embed": lambda self, text: 1 / 0})()
    e.sync(a, path)
    e.embedder = Third()
    assert e.embed_pending(10, stop_on_error=True) == {"embedded": 2, "failed": 1} and e.pending_chunks() == 2


def test_secrets(two):
    e, *_ = two
    secrets = {}
    account = e.add_account("c@x.example", password="p", secrets=secrets)
    assert secrets == {f"account:{account}": "p"}
    with pytest.raises(InvalidInput):
        e.add_account("d@x.example", secrets=secrets)


def test_fetching_by_batches():
    waits, got, calls = [], [], []

    def fetch(uids):
        calls.append(len(uids))
        if len(calls) in (2, 4, 5):
            raise OSError("UNAVAILABLE")
        return uids

    assert mail.fetch_batched(fetch, range(30), got.append, sleep=waits.append) == 30
    assert calls == [20, 10, 10] and waits == [0.25, 30] and [len(x) for x in got] == [20, 10]
    with pytest.raises(RateLimited):
        mail.fetch_batched(fetch, range(5), got.append, sleep=waits.append)


def test_model_server():
    def call(path, body):
        if path == "tags":
            return [{"models": [{"name": "qwen3:8b"}, {"name": "nomic-embed-text:latest"}]}]
        if path == "embed":
            return [{"embeddings": [[1, 2]]}]
        if path == "pull":
            return [{"completed": 1, "total": 2}, {"completed": 2, "total": 2}]
        assert body.get("options", {"temperature": 0.2})["temperature"] == 0.2
        return [{"message": {"content": "a"}}, {"message": {"content": "b"}, "done": True}, {"message": {"content": "late"}}]

    server, seen = models.ModelServer(call, chat_model="qwen3:8b", embedding_model="nomic-embed-text"), []
    assert server.health() == {"reachable": True, "embedder": True, "chat_model": True} and server.embed("x") == [1.0, 2.0]
    assert models.folded(server.tokens("s", "p"), seen.append) == "ab" and seen == ["a", "b"]
    assert server.pull("x", lambda *p: seen.append(p)) and seen[2:] == [(1, 2), (2, 2)] and not server.pull("x", cancelled=lambda: True)

    def down(path, body):
        raise OSError("refused")

    gone = models.ModelServer(down, chat_model="a", embedding_model="b")
    assert not gone.health()["reachable"]
    with pytest.raises(ModelUnavailable):
        gone.embed("x")


def feed(spark, path, uids):
    rows = [("a", "in", u, None if u % 10 == 0 else f"m{u % 7}", "s", "b", None) for u in uids]
    spark.createDataFrame(rows, ingest.FEED).coalesce(1).write.mode("append").parquet(path)


def test_sync_goes_on_after_a_failure(spark, tmp_path):
    path, store, check = f"file://{tmp_path}/feed", ingest.Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/check"
    feed(spark, path, range(1, 12))
    ingest.sync(spark, path, store, checkpoint=check)
    first = store.messages().count()
    assert first == 8 and store.watermarks().first()["last_seen_uid"] == 11
    feed(spark, path, range(12, 31))

    def fail(number):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.sync(spark, path, store, checkpoint=check, before_batch=fail)
    assert store.messages().count() == first
    ingest.sync(spark, path, store, checkpoint=check)
    assert store.messages().count() == 10 and store.watermarks().first()["last_seen_uid"] == 30
    ingest.full_resync(spark, path, store, checkpoint=f"{check}-again")
    assert store.messages().count() == 10 and store.watermarks().first()["last_seen_uid"] == 30
