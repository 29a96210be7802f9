"""The stored index: additions and merges against a rebuilt one, bounds against scoring everything, plans of fetches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridmail.functions.analyzer import plain_tokens
from hybridmail.functions.text import is_bulk
from hybridmail.operators import fulltext, fusion, segments

CHUNKS = "chunk_id string, message_id string, chunk_index int, text string"


def texts(n, seed=1):
    r = np.random.RandomState(seed)
    words = np.array([f"{a}{b}" for a in ("con", "re", "ti", "mo", "la") for b in ("tract", "view", "me", "ney", "ter", "n", "")])
    return [(f"c{seed}-{i:05d}", f"m{seed}-{i // 3:05d}", i % 3, " ".join(words[(r.rand(r.randint(0, 30)) ** 3 * len(words)).astype(int)])) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [texts(700, 1), texts(3, 2), texts(40, 3), texts(300, 4), texts(1, 5), texts(260, 6), texts(30, 7)]


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory, rows):
    index = segments.Index(spark, f"file://{tmp_path_factory.mktemp('index')}", plain_tokens, stems=False)
    for k, part in enumerate(rows):
        index.add(spark.createDataFrame(part, CHUNKS).repartition(3), k + 1)
    return index


@pytest.fixture(scope="module")
def plain(spark, rows):
    return tuple(x.persist() for x in fulltext.index(spark.createDataFrame([r for part in rows for r in part], CHUNKS), plain_tokens))


def test_additions_are_a_rebuilt_index(spark, tmp_path, grown, plain, rows):
    assert grown.covers == len(rows) and len(grown.segments()) < len(rows)
    columns = ["term", "chunk_id", "message_id", "chunk_index", "len", "tf", "positions"]
    flat = lambda df: {tuple(map(str, r)) for r in df.select(*columns).collect()}
    assert flat(segments.entries(grown.postings())) == flat(plain[0])
    n, mean = grown.statistics()
    known = fulltext.corpus(plain[1]).first()
    assert n == known["n_docs"] and mean == pytest.approx(known["avg_len"])
    df = {r["term"]: r["df"] for r in plain[0].groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {r["term"]: r["df"] for r in grown.vocabulary().collect()} == df
    # Blocks are filled, no place is taken twice, and what is said of entries is so.
    places = grown.postings().select("block", F.explode("entries").alias("e")).select("block", "e.place", "e.chunk_id").distinct()
    assert places.count() == places.select("block", "place").distinct().count() == places.select("chunk_id").distinct().count()
    for r in grown.postings().collect():
        own = [e["place"] for e in r["entries"]]
        bits = [sum((1 << (p % 64)) for p in own if p // 64 == k) for k in range(4)]
        assert own == sorted(own) and r["n"] == len(own) and r["max_tf"] == max(e["tf"] for e in r["entries"]) and r["min_len"] == min(e["len"] for e in r["entries"])
        assert [b % 2**64 for b in (r["b0"], r["b1"], r["b2"], r["b3"])] == bits
    again = segments.Index(spark, f"file://{tmp_path}/i", plain_tokens, stems=False)
    again.rebuild(spark.createDataFrame([r for part in rows for r in part], CHUNKS), 9)
    assert again.covers == 9 and len(again.segments()) == 1 and flat(segments.entries(again.postings())) == flat(plain[0])


@pytest.mark.parametrize("pool", [1, 40, 5000])
@pytest.mark.parametrize("query", ["con", "contract", "re con ti", "mo zzz", "zzz", "", "contract-re la", "contract contract"])
def test_bounds_lose_no_hit(grown, plain, query, pool):
    wanted = [tuple(r) for r in fulltext.search(*plain, query, pool, stems=False).collect()]
    got = grown.search(query, pool, small=0)
    assert [tuple(r) for r in grown.search(query, pool).rows] == [tuple(r) for r in got.rows]
    assert [r[:3] for r in wanted] == [tuple(r)[:3] for r in got.rows]
    assert [r[3] for r in wanted] == pytest.approx([r[3] for r in got.rows])
    assert got.scored <= max(got.blocks, len(got.rows))


def test_within_some_messages(spark, grown, plain):
    within = spark.createDataFrame([(f"m1-{i:05d}",) for i in range(0, 300, 7)], "message_id string")
    wanted = [tuple(r)[:3] for r in fulltext.search(*plain, "con la", 20, stems=False, within=within).collect()]
    assert [[tuple(r)[:3] for r in grown.search("con la", 20, within=within, small=n).rows] for n in (0, 99)] == [wanted] * 2


def test_frequent_words_leave_blocks_unread(spark, tmp_path):
    r = np.random.RandomState(3)
    rows = [(f"c{i:05d}", f"m{i:05d}", 0, "common " * int(r.zipf(2.0) % 9 + 1) + "x " * int(r.randint(1, 60))) for i in range(20_000)]
    index = segments.Index(spark, f"file://{tmp_path}/i", plain_tokens, stems=False)
    index.rebuild(spark.createDataFrame(rows, CHUNKS), 1)
    # Texts that are longer than the others and say it once lie by themselves, as a folder of long mails does.
    long = [(f"d{i:05d}", f"n{i:05d}", 0, "common " + "y " * 300) for i in range(20_000)]
    index.add(spark.createDataFrame(long, CHUNKS), 2)
    got = index.search("common", 20, small=0)
    assert got.blocks >= 156 and got.scored < 0.6 * got.blocks
    flat = segments.entries(index.postings())
    assert [tuple(x)[:3] for x in got.rows] == [tuple(x)[:3] for x in fulltext.search(flat, None, "common", 20, stems=False, stats=index.corpus()).collect()]


def test_rows_written_grow_as_a_logarithm(spark, tmp_path):
    """12 additions of 64 chunks: each posting is written again at most once a tier, not once an addition."""
    index = segments.Index(spark, f"file://{tmp_path}/i", plain_tokens, stems=False)
    chunk = "a b"
    n = 12
    for k in range(n):
        index.add(spark.createDataFrame([(f"c{k}-{i}", f"m{k}", i, chunk) for i in range(64)], CHUNKS).coalesce(1), k + 1)
    # A posting row is a word in a block: 2 words, a block for each addition.
    tiers = segments.tier(64 * n) + 1
    assert index.written <= 2 * n * (1 + tiers) and len(index.segments()) <= segments.FAN * tiers
    assert index.statistics()[0] == 64 * n and index.search("a", 5).rows


def test_a_restart_reads_the_last_whole_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    index = segments.Index(spark, path, plain_tokens, stems=False)
    index.add(spark.createDataFrame(texts(20, 8), CHUNKS), 1)
    (tmp_path / "i/manifest/m9").mkdir()  # a write that was cut off
    again = segments.Index(spark, path, plain_tokens, stems=False)
    assert again.covers == 1 and again.statistics()[0] == 20
    again.add(spark.createDataFrame([], CHUNKS), 2)
    assert again.covers == 2 and again.statistics()[0] == 20


def test_messages_are_not_shuffled_for_a_search(spark, tmp_path):
    """Messages beyond any broadcast: the pool's ids go to them, and no exchange holds them."""
    path = f"file://{tmp_path}/messages"
    spark.range(5000).select(F.format_string("m%05d", "id").alias("message_id"), F.current_timestamp().alias("received_at"), F.lit("unsubscribe").alias("body_plain"), F.lit("a@x").alias("sender_email")).write.parquet(path)
    messages = spark.read.parquet(path).withColumn("is_bulk", is_bulk(F.col("body_plain"), F.col("sender_email")))
    keyword = spark.createDataFrame([("m00001", 0, 1.0), ("m00002", 1, 0.5), ("gone", 2, 0.1)], "message_id string, keyword_rank int, keyword_score double")
    vector = spark.createDataFrame([("m00002", 0.9, 0)], "message_id string, similarity double, vector_rank int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fusion.weigh(fusion.fuse(keyword, vector), messages, F.current_timestamp(), 10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [r["message_id"] for r in found.collect()] == ["m00001", "m00002"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Between the scan of messages and the join with the pool there is no exchange but the broadcast of what was found.
    lines = plan.split("Initial Plan")[0].splitlines() if "Initial Plan" in plan else plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-|*()0123456789"))
    above, d = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < d:
            above.append(x)
            d = depth(x)
    kinds = [x.strip(" :+-|*()0123456789").split(" ")[0] for x in above]
    assert "Exchange" not in kinds[: kinds.index("BroadcastExchange")] and "BroadcastHashJoin" in kinds[: kinds.index("BroadcastExchange")], kinds


def test_posting_rows_are_made_without_a_shuffle(spark, tmp_path):
    """Words are neither shuffled nor sorted by Spark; runs of some blocks give the rows of one run, whatever the batches."""
    spark.createDataFrame(texts(1500, 9), CHUNKS).repartition(2).select("chunk_id", "message_id", "chunk_index", plain_tokens(F.col("text")).alias("words")).write.parquet(f"file://{tmp_path}/words")
    words = segments.numbered(spark.read.parquet(f"file://{tmp_path}/words"))
    rows = segments.blocked(words)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hash" in x or "Exchange range" in x or "Sort" in x], plan
    batches = words.select("block", "place", "chunk_id", "message_id", "chunk_index", "words").orderBy("block", "place").toArrow().to_batches(max_chunksize=100)
    whole = [r for b in segments._by_runs(iter(batches)) for r in b.to_pylist()]
    old, segments.RUN = segments.RUN, 3000
    try:
        parts = [r for b in segments._by_runs(iter(batches)) for r in b.to_pylist()]
    finally:
        segments.RUN = old
    key = lambda r: (r["block"], r["term"])
    assert [(r["term"], r["block"]) for r in whole] == sorted((r["term"], r["block"]) for r in whole) != [(r["term"], r["block"]) for r in parts]
    assert sorted(whole, key=key) == sorted(parts, key=key) == sorted((r.asDict(recursive=True) for r in rows.collect()), key=key)
