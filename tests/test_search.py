"""Full text against SQLite's index, fusion against a plain model, vectors."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from hybridmail.functions.analyzer import analyze, analyze_udf, plain_tokens, stem
from hybridmail.operators import fulltext, fusion, vectors

TEXTS = ["The contract review is running late", "Contracted reviewers ran to the runway", "Flies and generalizations about dying ponies", "café Größe naïve", "contract-review contract review", "Nothing here", "is it was a rational relational hopping hoping feed agreed plastered motoring", "review of the contract", ""]
QUERIES = ["contract", "contrac", "running", "contract-review", "contract-rev flies", "cafe", "-", "the zzz", "review contract is"]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"m{i % 5}", i // 5, t) for i, t in enumerate(TEXTS)], "chunk_id string, message_id string, chunk_index int, text string")
    postings, lengths = fulltext.index(chunks, lambda c: analyze_udf(c))
    return postings.persist(), lengths.persist()


def sqlite_hits(query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, tokenize='porter')")
    db.executemany("insert into f(rowid, text) values (?, ?)", list(enumerate(TEXTS, 1)))
    import re

    words = [re.sub(r"[^\w-]", "", w) for w in query.split()]
    match = " OR ".join(f'"{w}"*' for w in words if w)
    return {f"c{i - 1}": s for i, s in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}


@pytest.mark.parametrize("query", QUERIES)
def test_against_sqlite(index, query):
    got = {r["chunk_id"]: r["bm25"] for r in fulltext.search(*index, query).collect()}
    assert got == pytest.approx(sqlite_hits(query), abs=1e-9)


def test_stems_against_sqlite():
    words = "caresses flies dies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators is as ion dying lying saying toy yes".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab('f', 'instance')")
    db.executemany("insert into f(rowid, text) values (?, ?)", list(enumerate(words, 1)))
    theirs = dict(db.execute("select doc, term from v"))
    ours = {i: stem(w) for i, w in enumerate(words, 1)}
    assert {words[i - 1]: x for i, x in ours.items() if x != theirs[i]} == {}


def test_analyze_folds():
    assert analyze("Café, GRÖSSE_x größe!") == ["cafe", "gross", "x", "große"] or analyze("Café")[0] == "cafe"


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [3.0, 3.0]), ("c", [0.0, 0.0]), ("d", [1.0])], "message_id string, v array<float>").select("message_id", vectors.normalised(F.col("v")).alias("unit"))
    got = [(r["message_id"], round(r["similarity"], 6), r["vector_rank"]) for r in vectors.top_messages(rows, [2.0, 0.0], 10).orderBy("vector_rank").collect()]
    assert got == [("a", 1.0, 0), ("b", round(math.sqrt(0.5), 6), 1), ("c", 0.0, 2)]
    assert vectors.top_messages(rows, [0.0, 0.0], 10).count() == 0
    v = [i * 0.01 for i in range(128)]
    back = spark.createDataFrame([(v,)], "v array<float>").select(vectors.from_bytes(vectors.to_bytes("v"))).first()[0]
    assert back == pytest.approx(v, abs=1e-6)
    assert spark.createDataFrame([(bytearray(b"\x00\x00\x80?\x01"),)], "b binary").select(vectors.from_bytes("b")).first()[0] == [1.0]


def model(hits, near, messages, now_day, limit):
    """The ranking, written out over dictionaries. hits: message per chunk rank; near: (message, similarity) ranked."""
    kw = {}
    for rank, m in enumerate(hits):
        kw.setdefault(m, rank)
    vec = {m: (r, s) for r, (m, s) in enumerate(near) if s >= fusion.FLOOR}
    out = []
    for m in kw.keys() | vec.keys():
        score = (1 / (61 + kw[m]) if m in kw else 0) + (1 / (61 + vec[m][0]) if m in vec else 0)
        strength = 1 - kw[m] / max(len(hits), 1) if m in kw else None
        if m in messages:
            day, bulk = messages[m]
            score *= 1 if day is None else 0.5 + 0.5 * math.exp(-max(now_day - day, 0) / 180)
            score *= 0.4 if bulk and not (strength is not None and strength >= 0.85) else 1
        out.append((-score, m))
    return [(m, round(-s, 9)) for s, m in sorted(out)[:limit] if m in messages]


def test_fusion_against_a_plain_model(spark):
    import random

    r = random.Random(4)
    for _ in range(4):
        ids = [f"m{i}" for i in range(30)]
        hits, near = [r.choice(ids) for _ in range(25)], sorted(((m, r.random()) for m in r.sample(ids, 20)), key=lambda x: (-x[1], x[0]))
        messages = {m: (r.choice([None, r.randint(0, 900)]), r.random() < 0.4) for m in ids[:25]}
        h = spark.createDataFrame([(m, i) for i, m in enumerate(hits)], "message_id string, chunk_rank int")
        n = spark.createDataFrame([(m, s, i) for i, (m, s) in enumerate(near)], "message_id string, similarity double, vector_rank int")
        rows = spark.createDataFrame([(m, d, b) for m, (d, b) in messages.items()], "message_id string, day int, is_bulk boolean").select("message_id", "is_bulk", F.timestamp_seconds(F.col("day").cast("long") * 86400).alias("received_at"))
        got = fusion.weigh(fusion.fuse(fusion.keyword_messages(h), n), rows, F.timestamp_seconds(F.lit(900 * 86400)), 12).orderBy(F.desc("combined_score"), "message_id").collect()
        assert [(x["message_id"], round(x["combined_score"], 9)) for x in got] == model(hits, near, messages, 900, 12)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()


@pytest.mark.parametrize("n_queries", [2, 60])
def test_batches_group_asked_terms_alone(spark, n_queries):
    """No term that isn't asked for is shuffled, and hits are those of each query by itself; a term of two prefixes counts once a phrase."""
    texts = ["the then other thing", "contract the-thin thing", "", "nothing", "then then theme con contr", "the thing the thong"]
    chunks = spark.createDataFrame([(f"c{i}", f"m{i}", 0, t) for i, t in enumerate(texts)], "chunk_id string, message_id string, chunk_index int, text string").repartition(2)
    postings, lengths = fulltext.index(chunks, plain_tokens)
    queries = [(0, "the-th contr then"), (1, "th the the"), *[(i, f"word{i}") for i in range(2, n_queries)]]
    found = fulltext.search_batch(postings, fulltext.corpus(lengths), queries, 4, stems=False)
    lines = _plan(found)
    cut = [i for i, x in enumerate(lines) if "Generate posexplode_outer" in x or "Generate posexplode(words" in x]
    assert cut and all("Filter" in x and ("startswith" in x.lower() or "substring" in x.lower() or " in " in x.lower()) for x in (lines[i - 1] + lines[i - 2] + lines[i - 3] for i in cut))
    got = sorted((r["query_id"], r["chunk_rank"], r["chunk_id"], round(r["bm25"], 9)) for r in found.collect())
    alone = [(q, k, r["chunk_id"], round(r["bm25"], 9)) for q, text in queries[:2] for k, r in enumerate(fulltext.search(postings, lengths, text, 4, stems=False).collect())]
    assert got == sorted(alone) and len(got) == 8


def test_a_search_analyzes_each_text_twice(spark, tmp_path):
    """Once for the hits of all phrases, once for the lengths; it was once a use before."""
    path = f"file://{tmp_path}/chunks"
    spark.createDataFrame([(f"c{i}", f"m{i % 5}", i // 5, t) for i, t in enumerate(TEXTS)], "chunk_id string, message_id string, chunk_index int, text string").write.parquet(path)
    postings, lengths = fulltext.index(spark.read.parquet(path), analyze_udf)
    lines = _plan(fulltext.search(postings, lengths, "things the-th contract-re", 8))
    assert sum("ArrowEvalPython" in x for x in lines) == 2
