"""A mailbox server, its feed as a streaming source, keyed dedup, the stream of embeddings, and a model server over HTTP."""

import http.server
import json
import re
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from hybridmail import models
from hybridmail.engine import Engine
from hybridmail.errors import ModelUnavailable
from hybridmail.sources import feed
from hybridmail.streaming import embedding, ingest


class Imap(socketserver.StreamRequestHandler):
    """As much of a mail server as a reader needs. boxes: mailbox to {uid: raw message}; log: what was asked."""

    boxes: dict = {}
    log: list = []
    refuse: set = set()

    def say(self, line):
        self.wfile.write(line if isinstance(line, bytes) else line.encode())
        self.wfile.write(b"\r\n")

    def handle(self):
        self.say("* OK ready")
        box = {}
        for raw in self.rfile:
            tag, _, rest = raw.decode().strip().partition(" ")
            self.log.append(rest)
            word = rest.upper().split(" ")[0]
            if word == "CAPABILITY":
                self.say("* CAPABILITY IMAP4rev1")
            elif word == "LOGIN" and "secret" not in rest:
                self.say(f"{tag} NO wrong")
                continue
            elif word == "LIST":
                self.say('* LIST (\\HasNoChildren) "/" "INBOX"')
                self.say('* LIST (\\Noselect) "/" "All"')
                self.say('* LIST () "/" "Old mail"')
            elif word in ("EXAMINE", "SELECT"):
                box = self.boxes.get(rest.split(" ", 1)[1].strip('"'), {})
                self.say(f"* {len(box)} EXISTS")
                self.say(f"{tag} OK [READ-ONLY] done")
                continue
            elif rest.upper().startswith("UID SEARCH"):
                low, high = re.search(r"UID (\d+):(\d+|\*)", rest).groups()
                found = [u for u in box if u >= int(low) and (high == "*" or u <= int(high))] or list(box)[-1:]
                self.say("* SEARCH " + " ".join(map(str, found)))
            elif rest.upper().startswith("UID FETCH"):
                uids = list(map(int, rest.split(" ")[2].split(",")))
                if self.refuse & set(uids):
                    self.refuse.clear()
                    self.say(f"{tag} NO [UNAVAILABLE] too many requests")
                    continue
                for u in uids:
                    if u in box:
                        self.wfile.write(f'* 1 FETCH (UID {u} INTERNALDATE "02-Apr-2024 08:00:00 +0000" BODY[] {{{len(box[u])}}}\r\n'.encode() + box[u] + b")\r\n")
            elif word == "LOGOUT":
                self.say("* BYE")
                self.say(f"{tag} OK bye")
                return
            self.say(f"{tag} OK done")


@pytest.fixture()
def imap(tmp_path):
    raw = lambda u, box: f"Message-ID: <{box}{u}@x>\r\nSubject: n{u}\r\n\r\nbody {u} of words\r\n".encode()
    Imap.boxes, Imap.log, Imap.refuse = {"INBOX": {u: raw(u, "i") for u in range(1, 48)}, "Old mail": {5: raw(5, "o"), 9: raw(9, "o")}}, [], set()
    (tmp_path / "password").write_text("secret\n")

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address = daemon_threads = True

    with Server(("127.0.0.1", 0), Imap) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        yield {"client": "hybridmail.sources.feed:ImapClient", "host": "127.0.0.1", "port": str(server.server_address[1]), "user": "me", "password_file": f"{tmp_path}/password", "tls": "false", "account": "a", "pause_ms": "0"}
        server.shutdown()


def test_client(imap):
    client = feed.client_of(imap)
    assert client.mailboxes() == ["INBOX", "Old mail"]
    assert client.uids("INBOX", 45) == [46, 47] and client.uids("INBOX", 47) == [] and client.uids("Old mail", 0, 7) == [5]
    got = client.fetch("INBOX", [2, 3])
    assert [(r["uid"], r["message_id"], r["subject"], r["body"].strip(), r["internal_date"].isoformat()) for r in got][0] == (2, "i2@x", "n2", "body 2 of words", "2024-04-02T08:00:00+00:00")
    client.close()
    assert any(x.startswith("EXAMINE") for x in Imap.log) and not any(x.startswith("SELECT") for x in Imap.log)
    with pytest.raises(Exception, match="wrong"):
        feed.client_of(imap | {"password_file": "", "password_env": "NONE"})


def test_feed_goes_on_after_a_restart(spark, imap, tmp_path):
    store, check = ingest.Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/check"
    assert ingest.keyed_sync(spark, imap, store, checkpoint=check)["rows"] == 49
    assert store.messages().count() == 49 and {r["mailbox"]: r["last_seen_uid"] for r in store.watermarks().collect()} == {"INBOX": 47, "Old mail": 9}
    assert sum("UID FETCH" in x for x in Imap.log) == 4  # 47 by batches of 20, and 2
    Imap.boxes["INBOX"] |= {60: b"Message-ID: <new@x>\r\n\r\nx", 61: b"Message-ID: <o5@x>\r\n\r\na copy of an old one", 62: b"Subject: no id\r\n\r\ny"}
    Imap.log.clear()

    def lost(number):
        raise RuntimeError("lost after the messages were written")

    with pytest.raises(Exception, match="lost"):
        ingest.keyed_sync(spark, imap, store, checkpoint=check, after_write=lost)
    assert ingest.keyed_sync(spark, imap, store, checkpoint=check)["rows"] == 3
    assert sorted(r["uid"] for r in store.messages().filter("uid > 47").collect()) == [60, 62] and store.messages().count() == 51
    assert {r["mailbox"]: r["last_seen_uid"] for r in store.watermarks().collect()} == {"INBOX": 62, "Old mail": 9}
    assert all(x.split(" ")[2] == "60,61,62" for x in Imap.log if "UID FETCH" in x)
    assert not [p for p in (tmp_path / "store").iterdir() if p.name not in ("messages", "watermarks")]


def test_engine_syncs_a_mailbox(spark, imap, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w")
    account = e.add_account("me@x.example")
    assert e.sync(account, imap | {"account": account})["stored"] == 49
    assert e.search("words", 3).results.count() == 3 and e.sync(account, imap | {"account": account})["stored"] == 0


def test_runs_and_batches(spark, tmp_path):
    assert feed.runs({"a": 10}, {"a": 15, "b": 4, "c": 0}, 3) == [feed.Run("a", 10, 13), feed.Run("a", 13, 15), feed.Run("b", 0, 3), feed.Run("b", 3, 4)]
    rows = [("a", "in", u, f"m{u}", None, "b", None) for u in range(1, 31)] + [("b", "in", 99, "x", None, None, None), ("a", None, 7, "y", None, None, None)]
    spark.createDataFrame(rows, ingest.FEED).write.parquet(f"file://{tmp_path}/f")
    feed.register(spark)
    options = {"client": "hybridmail.sources.feed:FolderClient", "account": "a", "path": f"file://{tmp_path}/f"}
    assert sorted(r["uid"] for r in spark.read.format("mailbox_feed").options(**options).load().collect()) == list(range(1, 31))
    assert spark.read.format("mailbox_feed").options(**options, above=json.dumps({"in": 28})).load().count() == 2
    assert spark.read.format("mailbox_feed").options(**options | {"path": f"file://{tmp_path}/none"}).load().count() == 0


def test_runs_are_cut_by_messages_that_are_there(spark, tmp_path, monkeypatch):
    """A mailbox with 30 messages among a million numbers is two partitions and two reads, not 500 of each."""
    assert feed.runs_of("a", [3, 9, 11, 40, 41], 2, 50, 2) == [feed.Run("a", 2, 9), feed.Run("a", 9, 40), feed.Run("a", 40, 50)]
    assert feed.runs_of("a", [3, 9], 0, 9, 2) == [feed.Run("a", 0, 9)] and feed.runs_of("a", [], 0, 9) == []
    rows = [("a", box, u * 30_000, f"m{u}", None, "b", None) for box in ("in", "out") for u in range(1, 31)]
    spark.createDataFrame(rows, ingest.FEED).write.parquet(f"file://{tmp_path}/f")
    reader = feed._Stream({"client": "hybridmail.sources.feed:FolderClient", "account": "a", "path": f"file://{tmp_path}/f"})
    fetched = []
    monkeypatch.setattr(feed.FolderClient, "fetch", lambda self, box, uids, f=feed.FolderClient.fetch: fetched.append(len(uids)) or f(self, box, uids))
    parts = reader.partitions({"out": 600_000}, reader.latestOffset())
    assert parts == [feed.Run("in", 0, 900_000), feed.Run("out", 600_000, 900_000)]
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["mailbox"], r["uid"]) for r in got] == [("in", u * 30_000) for u in range(1, 31)] + [("out", u * 30_000) for u in range(21, 31)] and fetched == [30, 10]
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_embedding_stream(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w")
    add = lambda first, n: e.append("chunks", spark.createDataFrame([(f"c{i}", f"m{i}", 0, "bad" if i == 3 else f"text {i}") for i in range(first, first + n)], "id string, message_id string, chunk_index int, text string").withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_dim": F.lit(None).cast("int"), "embedding_model": F.lit(None).cast("string"), "created_at": F.current_timestamp()}))

    class Counted(models.HashingEmbedder):
        def embed(self, text):
            if text == "bad":
                raise ValueError("bad")
            return super().embed(text)

        def embed_many(self, texts):
            return [self.embed(t) for t in texts]

    e.embedder = Counted()
    run = lambda: embedding.start(e, once=True).awaitTermination()
    run()
    add(0, 10)
    run()
    assert e.table("chunks").count() == 10 and e.pending_chunks() == 1 and e.stored("chunk_vectors").count() == 9
    add(10, 5)
    run()  # a new query of the same checkpoint takes up the new file alone
    assert e.stored("chunk_vectors").count() == 14 and len(e._folders("chunk_vectors")) == 2
    e.compact()
    assert e.table("chunks").count() == 15 and e.table("chunks").filter("embedding is null").count() == 1
    run()  # the chunks lie in a new file, most with their vectors
    assert e.table("chunks").count() == 15 and e.pending_chunks() == 1 and e.stored("chunk_vectors").count() == 0
    assert e.embed_pending() == {"embedded": 0, "failed": 1}
    query = e.start()
    try:
        add(20, 3)
        query.processAllAvailable()
        assert e.pending_chunks() == 1 and e.total_messages() == 0
    finally:
        query.stop()


def test_http_transport():
    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, lines, code=200):
            self.send_response(code)
            self.end_headers()
            for x in lines:
                self.wfile.write(json.dumps(x).encode() + b"\n")

        def do_GET(self):  # noqa: N802
            self.answer([{"models": [{"name": "qwen3:8b"}, {"name": "nomic-embed-text:latest"}]}])

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/embed":
                texts = body["input"] if isinstance(body["input"], list) else [body["input"]]
                self.answer([{"embeddings": [[float(len(t)), 1.0] for t in texts]}])
            elif self.path == "/api/chat":
                self.answer([{"message": {"content": "a"}}, {"message": {"content": "b"}, "done": True}])
            elif body["model"] == "none":
                self.answer([{"error": "no such model"}], 404)
            else:
                self.answer([{"status": "x"}, {"completed": 1, "total": 2}, {"completed": 2, "total": 2}])

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        client, seen = models.ModelServer(models.HttpTransport(base), chat_model="qwen3:8b", embedding_model="nomic-embed-text"), []
        assert client.health() == {"reachable": True, "embedder": True, "chat_model": True}
        assert client.embed("four") == [4.0, 1.0] and client.embed_many(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]]
        assert models.folded(client.tokens("s", "p")) == "ab"
        assert client.pull("x", lambda *p: seen.append(p)) and seen == [(1, 2), (2, 2)]
        with pytest.raises(ModelUnavailable, match="no such model"):
            client.pull("none")
        server.shutdown()
    gone = models.ModelServer(models.HttpTransport(base, 2), chat_model="a", embedding_model="b")
    assert not gone.health()["reachable"]
