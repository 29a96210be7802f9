"""Tables that change, counters, questions and models."""

from pyspark.sql import functions as F

from hybridmail.models import ExtractiveGenerator, HashingEmbedder, folded
from hybridmail.operators import answers, evaluate, relational


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_insert_or_ignore_lets_nulls_through(spark):
    s = "id string, a string, b int"
    old = spark.createDataFrame([("x", "a", 1)], s)
    new = spark.createDataFrame([("y", "a", 1), ("z", "a", 2), ("w", "a", 2), ("n", "a", None), ("m", "a", None)], s)
    assert [r[0] for r in rows(relational.insert_or_ignore(old, new, ["a", "b"], ["id"]), "id")] == ["m", "n", "w", "x"]


def test_first_wins(spark):
    s = "acc string, mid string, at int"
    new = spark.createDataFrame([("a", "1", 2), ("a", "1", 1), ("b", "1", 3), ("a", None, 4), ("a", None, 5), ("a", "9", 6)], s)
    known = spark.createDataFrame([("a", "9", 0), ("a", None, 0)], s)
    assert rows(relational.first_wins(new, known, "acc", "mid", ["at"]), "at") == [("a", "1", 1), ("b", "1", 3), ("a", None, 4), ("a", None, 5)]


def test_upsert_and_update(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    delta = spark.createDataFrame([("b", None), ("c", 3)], "k string, n int")
    assert rows(relational.upsert(old, delta, ["k"]), "k") == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]
    assert rows(relational.upsert(old, delta, ["k"], keep_null=False), "k")[1] == ("b", None, "y")
    assert rows(relational.update(old, delta, ["k"]), "k") == [("a", 1, "x"), ("b", 2, "y")]


def test_cascade(spark):
    t = {
        "accounts": spark.createDataFrame([("a",), ("b",)], "id string"), "mailboxes": spark.createDataFrame([("m", "a")], "id string, account_id string"),
        "messages": spark.createDataFrame([("1", "a"), ("2", "b")], "id string, account_id string"), "chunks": spark.createDataFrame([("c", "1"), ("d", "2")], "id string, message_id string"),
        "sync_state": spark.createDataFrame([("a",)], "account_id string"), "search_feedback": spark.createDataFrame([("f", "1"), ("g", "2"), ("h", None)], "id string, message_id string"),
    }
    left = relational.delete_account(t, spark.createDataFrame([("a",)], "id string"))
    assert [left[k].count() for k in ("accounts", "mailboxes", "messages", "chunks", "sync_state")] == [1, 0, 1, 1, 0]
    assert rows(left["search_feedback"], "id") == [("f", None), ("g", "2"), ("h", None)]


def test_watermarks_never_fall(spark):
    s = "account_id string, mailbox string"
    old = spark.createDataFrame([("a", "in", 10), ("b", "in", None)], s + ", last_seen_uid long")
    seen = spark.createDataFrame([("a", "in", 7), ("b", "in", 3), ("c", "in", 1), ("c", "in", 5)], s + ", uid long")
    assert rows(relational.merge_watermarks(old, seen), "account_id") == [("a", "in", 10), ("b", "in", 3), ("c", "in", 5)]


def test_backfill(spark):
    s = "id string, message_id string, chunk_index int, text string, embedding array<float>"
    old = spark.createDataFrame([("1", "same", 0, "x", [1.0]), ("2", "edit", 0, "x", [2.0]), ("3", "more", 0, "x", [3.0]), ("4", "gone", 0, "x", [4.0])], s)
    new = spark.createDataFrame([("1", "same", 0, "x"), ("2", "edit", 0, "y"), ("3", "more", 0, "x"), ("5", "more", 1, "z"), ("6", "new", 0, "n")], "id string, message_id string, chunk_index int, text string")
    assert dict(rows(relational.backfill_routes(old, new), "message_id")) == {"same": "same", "edit": "in_place", "more": "rechunk", "gone": "kept", "new": "added"}
    got = [(r["message_id"], r["text"], r["embedding"]) for r in relational.backfill(old, new).orderBy("message_id", "chunk_index").collect()]
    assert got == [("edit", "y", [2.0]), ("gone", "x", [4.0]), ("more", "x", None), ("more", "z", None), ("new", "n", None), ("same", "x", [1.0])]


def test_cooldowns(spark):
    s = spark.createDataFrame([("cooldown:a", "100"), ("cooldown:b", "x"), ("cooldown:c", "300"), ("other", "1")], "key string, value string")
    assert rows(relational.can_sync(s, F.lit(200), F.lit(False)), "account_id") == [("a", 0, True), ("b", 0, True), ("c", 100, False)]


def test_ladder(spark):
    cases = [(4.0, [], "search_only", None), (16.0, ["qwen3:8b-q4"], "model", "qwen3:8b"), (16.0, ["qwen3:14b"], "needs_pull", "qwen3:8b"), (48.0, ["qwen3:8b"], "model", "qwen3:8b"), (48.0, [], "needs_pull", "qwen3.6:35b-mlx"), (32.0, ["gpt-oss:20b", "qwen3:8b"], "model", "gpt-oss:20b"), (8.0, ["granite4.1:3b"], "search_only", None)]
    df = spark.createDataFrame([(i, gb, tags) for i, (gb, tags, _, _) in enumerate(cases)], "machine int, ram_gb double, installed array<string>")
    assert [(r["state"], r["pick"]) for r in answers.auto_pick(df).orderBy("machine").collect()] == [(s, p) for _, _, s, p in cases]
    assert spark.range(1).select(answers.present_as(F.array(F.lit("qwen3:8b")), F.lit("qwen3:14b")), answers.installed_as(F.array(F.lit("qwen3:8b")), F.lit("qwen3:14b"))).first()[:] == (True, False)


def test_citations(spark):
    given = spark.createDataFrame([("a", "yes [1] and [3][3] [99999999999]"), ("b", "none")], "answer_id string, answer string")
    sources = spark.createDataFrame([(k, n) for k in "ab" for n in (1, 2, 3)], "answer_id string, n int")
    got = {(r["answer_id"], r["n"]): (r["cited"], r["shown"]) for r in answers.citations(given, sources).collect()}
    assert got == {("a", 1): (True, True), ("a", 2): (False, False), ("a", 3): (True, True), ("b", 1): (False, True), ("b", 2): (False, True), ("b", 3): (False, True)}


def test_answer_blocks():
    assert answers.blocks("# Head\nOne\ntwo\n\n- a\n- b\n1. x\n2) y\nend") == [("heading", ["Head"]), ("paragraph", ["One", "two"]), ("bullets", ["a", "b"]), ("numbers", ["x", "y"]), ("paragraph", ["end"])]


def test_evaluation_pools(spark):
    hits = spark.createDataFrame([("q", 1, "spam offer", None, 0.1), ("q", 2, "good stuff", 0.7, None), ("r", 1, "good spam", None, 0.9)], "query_id string, rank int, haystack string, similarity double, keyword_score double")
    cases = spark.createDataFrame([("q", ["good"], ["spam"]), ("r", ["good"], [])], "query_id string, relevant array<string>, junk array<string>")
    by = evaluate.precision(evaluate.judged(hits, cases))
    assert rows(by, "query_id") == [("q", 2, 1, 1, 1, 1, 0.5), ("r", 1, 1, 0, 0, 0, 1.0)]
    assert evaluate.pooled(by).first()["pooled_precision"] == 2 / 3


def test_offline_models():
    e = HashingEmbedder(32)
    assert e.embed("the running dogs") == e.embed("The RUN dog") or e.embed("running") == e.embed("runs")
    assert e.embed("") == [0.0] * 32
    text = folded(ExtractiveGenerator().tokens("", "where is the contract\n\n[1] From: a\n    Subject: Lunch\n    Date: x\n    Excerpt: Noon.\n\n[2] From: b\n    Subject: Papers\n    Date: y\n    Excerpt: The contract is in the drawer. Bye.\n"))
    assert "[2]" in text and "contract" in text and "[1]" not in text
