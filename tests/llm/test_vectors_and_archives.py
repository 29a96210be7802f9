"""Nearest neighbours, archives and the pipeline."""

import dataclasses
import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hybridmail.llm import ann, tokens, warc

VECTORS = "vec_id long, embedding array<float>"


def test_recall_and_ties(spark):
    r = np.random.RandomState(1)
    x = r.randn(2500, 16).astype("f4")
    x[400:700] = x[3]
    x[700:720] *= 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).withColumns({k: F.lit(1) for k in ("v", "cid", "cell", "group", "rank", "score", "id", "query")})
    got = {}
    for row in ann.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    exact, hits = x.astype("f8"), 0
    for q in range(0, 2500, 20):
        s = exact @ exact[q]
        wanted = [j for j in np.lexsort((np.arange(2500), -s)) if j != q][:20]
        mine = [got[q][k] for k in range(1, 21)]
        assert all(abs(score - s[j]) < 1e-9 for j, score in mine)
        assert mine == sorted(mine, key=lambda y: (-y[1], y[0]))
        hits += len({j for j, _ in mine} & set(wanted))
    assert hits / (125 * 20) >= 0.95
    # Of equal vectors the smaller ids come first.
    assert [got[400][k][0] for k in range(1, 4)] == [x for x in (3, 401, 402)] or got[400][1][1] > exact[3] @ exact[3] + 1e-9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (20, [0.0, 0.0]), (40, [1.0, float("nan")]), (60, [0.5, 1.0]), (80, [float("inf"), 1.0]), (3, [2.0, 1.0]), (4, [1.0]), (0, [1.0, 0.0]), (None, [1.0, 1.0]), (100, []), (120, [1.0, None])]
    got = [tuple(r) for r in ann.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 1, 1.0), (0, 3, 60, 0.5), (60, 1, 3, 2.0), (60, 2, 0, 0.5), (60, 3, 1, 0.5)]
    assert ann.neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(spark.createDataFrame([(0, [1.0])], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_groups_split_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 64)
    monkeypatch.setattr(ann, "QUERIES", 16)
    x = np.random.RandomState(2).randn(600, 8)
    got = ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), F.col("vec_id") % 20 == 0)
    counts = Counter(r["query_id"] for r in got.collect())
    assert set(counts.values()) == {20} and len(counts) == 30


def test_outliers_of_dense_clusters_get_all_rows(spark, monkeypatch):
    """With one probe, as the calibration gives where most vectors are clustered."""
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, n: dataclasses.replace(fit(x, n), probes=1))
    r = np.random.RandomState(3)
    middles = r.randn(4, 16) * 10
    x = np.concatenate([middles[np.arange(2000) % 4] + r.randn(2000, 16) * 0.01, r.randn(100, 16) * 200]).astype("f4")
    x = x[r.permutation(len(x))]
    got = Counter(q["query_id"] for q in ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), F.lit(True)).collect())
    assert got == dict.fromkeys(range(len(x)), 20)


def test_every_candidate_is_kept(spark):
    """Repeated rows don't hide other ids, ids may have several vectors, and vectors of each length are searched."""
    v, w = [1.0, 2.0], [2.0, 1.0]
    rows = [(1, v)] * 100 + [(2, v), (20, v), (3, w), (20, w), (40, [1.0, 0.0, 2.0]), (41, [0.0, 1.0, 1.0]), (60, [5.0]), (5, [1.0, 1.0, 0.0])]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    twice = sorted(got.pop(20))
    assert twice == sorted([(1, 1, 5.0), (2, 2, 5.0), (3, 3, 4.0), (4, 20, 4.0), (1, 3, 5.0), (2, 1, 4.0), (3, 2, 4.0), (4, 20, 4.0)])
    assert {q: sorted(x) for q, x in got.items()} == {40: [(1, 41, 2.0), (2, 5, 1.0)]}


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_on_repeated_and_mixed_rows(spark, clustered):
    r = np.random.RandomState(7)
    rows = []
    for d, n in ((8, 900), (24, 1500)):
        x = r.randn(n, d) + (r.randn(12, d) * 6)[r.randint(0, 12, n)] * clustered
        x[: n // 3] = x[0]
        rows += [(len(rows) + i, y.tolist()) for i, y in enumerate(x.astype("f4"))]
    rows += rows[:50] * 3
    got = {}
    for g in ann.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    known, hits, wanted = dict(rows), 0, 0
    for q in (i for i in known if i % 20 == 0):
        others = [(-float(np.dot(np.float64(known[j]), np.float64(known[q]))), j) for j in known if j != q and len(known[j]) == len(known[q])]
        true = {j for _, j in sorted(others)[:20]}
        wanted += len(true)
        hits += len(true & got[q])
    assert hits >= 0.95 * wanted


def unit_rows(r, n, d):
    x = r.randn(n, d)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("name,make", [
    ("unit, many dimensions", lambda r: unit_rows(r, 8000, 384)),
    ("normal", lambda r: r.randn(20_000, 128)),
    ("heavy-tailed lengths", lambda r: r.randn(6000, 64) * r.standard_t(2, (6000, 1))),
    ("one length far above", lambda r: np.concatenate((r.randn(3000, 48), r.randn(5, 48) * 1e6))),
])
def test_recall_by_shape(spark, tmp_path, name, make):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = make(np.random.RandomState(11)).astype("f4").astype("f8")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.astype("f4").tolist(), pa.list_(pa.float32()))}), tmp_path / "x.parquet")
    got = ann.neighbours(spark.read.parquet(f"file://{tmp_path}/x.parquet").repartition(4), F.col("vec_id") % 20 == 0).toPandas()
    queries = np.arange(0, len(x), 20)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    true = np.argpartition(-s, 19, axis=1)[:, :20]
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert len(got) == 20 * len(queries)
    assert np.mean([len(set(true[i].tolist()) & found[q]) / 20 for i, q in enumerate(queries)]) >= 0.95, name


def test_products_beyond_doubles(spark):
    """All candidates are kept: infinite products tie as the nearest, those that aren't numbers are the farthest, small ones are told apart."""
    rows = [(20, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [-1e200, 0.0]), (4, [1e200, -1e200]), (40, [1e-200, 0.0])]
    got = {}
    for x in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    inf = float("inf")
    assert got[20][:2] == [(1, inf), (2, 2e200)] and [i for i, _ in got[20]][2:] == [40, 3, 4] and np.isnan(got[20][4][1])
    assert len(got[40]) == 5 and {got[40][0][0], got[40][1][0], got[40][2][0]} == {1, 4, 20}


def test_integers_are_exact(spark):
    rows = [(20, [16_777_217, 1]), (1, [16_777_217, 1]), (2, [16_777_216, 1])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<long>"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(1, float(16_777_217**2 + 1)), (2, float(16_777_217 * 16_777_216 + 1))]


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    big = "é<p>" * 500
    rows = [(1, "http://a/", big), (2, "http://b c/\r\nX: y", big), (9, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (None, "v", "only null" * 200), (7, "u", "\r\n\r\nWARC/1.0\r\n\r\n" * 100), (8, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, PAGES).withColumns({k: F.lit("z") for k in ("digest", "keeper", "p", "d", "refers_to", "payload_bytes")})
    whole = warc.write_monolithic(warc.decided(df), f"{spark.conf.get('spark.checkpoint.dir')}/w")
    got = Counter(map(tuple, warc.read(warc.normalise(whole, f"{spark.conf.get('spark.checkpoint.dir')}/m")).collect()))
    wanted = Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == b and j is not None]
        refers = max(same) if len(b) >= 1000 and same and i != max(same) else None
        wanted[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    assert got == wanted
    assert warc.read(warc.normalise(warc.write_monolithic(warc.decided(df.limit(0)), f"{spark.conf.get('spark.checkpoint.dir')}/e"), f"{spark.conf.get('spark.checkpoint.dir')}/f")).count() == 0


def test_archives_are_cut_and_revisits_checked(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 400) for i in range(40)] + [(100 + i, "u", "same " * 300) for i in range(5)]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/cut"
    decided = warc.decided(spark.createDataFrame(rows, PAGES))
    whole = warc.write_monolithic(decided, folder, most=5000)
    assert whole.count() > 8 and sum(r["records"] for r in whole.collect()) == 45
    members = warc.normalise(whole, f"{folder}-m")
    got = {r["page_id"]: r for r in warc.read(members).collect()}
    assert len(got) == 45 and [got[100 + i]["refers_to"] for i in range(5)] == [104] * 4 + [None]
    lost = warc.write_monolithic(decided.filter("page_id <> 104"), f"{folder}-lost")
    with pytest.raises(ValueError, match="no response"):
        warc.read(warc.normalise(lost, f"{folder}-lost-m"))


def record(i, payload):
    return warc.record_head(i, "http://x/", "response", len(payload), hashlib.sha1(payload).hexdigest(), None) + payload + b"\r\n\r\n"


def test_normaliser_members(tmp_path):
    records = [record(i, b"%d " % i * i * 1000) for i in range(5)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for name in ("one", "cut"):
        archive, index, n = warc.normalise_file(f"file://{tmp_path}/{name}.warc.gz", f"file://{tmp_path}/out", name)
        data = (tmp_path / f"out/{name}.warc.gz").read_bytes()
        assert n == 5 and gzip.decompress(data) == b"".join(records)
        for line, wanted in zip((tmp_path / f"out/{name}.idx").read_text().splitlines(), records, strict=True):
            offset, length, kind, urn = line.split(" ")
            one = zlib.decompressobj(31)
            assert one.decompress(data[int(offset) : int(offset) + int(length)]) == wanted and one.eof and not one.unused_data
            assert kind == "response"


@pytest.mark.parametrize("cut", [40, 400])
def test_normaliser_refuses_broken_archives(tmp_path, cut):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record(1, b"y" * 500))[:-9] if cut == 40 else gzip.compress(record(1, b"y" * 500)[:cut]))
    with pytest.raises(ValueError, match="archive|ends within"):
        warc.normalise_file(f"file://{tmp_path}/x.warc.gz", f"file://{tmp_path}/out", "x")


def test_pipeline(spark):
    """Each stage on the rows of the one before, against plain versions of what it promises."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "source mixing", "token output"]
    from hybridmail.llm.common import stored

    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), "stage")
        kept[name] = docs.toPandas()
        counts.append(len(kept[name]))
        if name != "token output":
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[3] > 0

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    left = [(i, shingles(t)) for i, t in zip(kept["MinHash near-dedup"]["doc_id"], kept["MinHash near-dedup"]["text"], strict=True)]
    for k, (_, a) in enumerate(left):
        assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for _, b in left[:k])
    mixed, before = Counter(kept["source mixing"]["doc_id"]), set(kept["benchmark decontamination"]["doc_id"])
    assert set(mixed) <= before and max(mixed.values()) <= 2
    assert Counter(kept["token output"]["doc_id"]) == mixed
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    text = dict(zip(kept["source mixing"]["doc_id"], kept["source mixing"]["text"], strict=True))
    at = 0
    for r in kept["token output"].sort_values("start").itertuples():
        ids = np.array([*t.encode(text[r.doc_id], add_special_tokens=False).ids, tokens.END], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_ann": "query_id rank vec_id score", "op3_mixing": "doc_id size source_size target taken", "op4_tokens": "doc_id start n_tokens ids_crc32",
    "op5_substrings": "doc_id n_words n_removed kept_sha256", "op6_neardups": "doc_id n_shingles component_id kept", "op7_quality": "doc_id expected_grade kept", "op8_decontaminate": "doc_id item_id n_shared n_item containment",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to", "op10_ngrams": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_queries(spark, name):
    """Each query on the smallest tables: its columns, a row for each row of its table where that is promised, and its SQL."""
    import duckdb

    from hybridmail.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    rows = got.collect()
    if name not in ("op2_ann", "op8_decontaminate"):
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{'pages' if name == 'op9_warc' else 'documents'}.parquet").count()
    if name in queries.ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        wanted = db.sql(queries.ORACLE_SQL[name])
        columns = sorted(wanted.columns)
        assert columns == sorted(got.columns)
        theirs = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
        assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(tuple(r[c] for c in columns) for r in theirs)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing columns and empty tables go through every stage."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clash = ["_row", "_id", "_copies", "_row_hash", "_copy", "_key", "row", "key", "copies", "h", "id", "version", "label", "grade", "_hit", "_gone", "kept"]
    item = "one two three four five six seven eight nine ten"
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without id " * 9, "en", "web", 1), (9001, "", "en", None, 0), (9002, None, "en", "web", None), (9003, "long word " * 20_000, "en", "web", 1), (9004, "same " * 30, "en", "web", 1), (9004, "same " * 30, "en", "web", 1), (9005, f"before {item} after", "en", "web", 1)], real.schema)
    docs = real.unionByName(odd).withColumns({c: F.lit(c) for c in clash})
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from hybridmail.llm.common import stored

    for name, stage in corpus_pipeline.STAGES:
        before, (docs, _) = docs, stored(stage(spark, docs, str(tmp_path)), "odd")
        if name != "token output":
            assert docs.columns == before.columns and docs.filter("_row = '_row' and kept = 'kept'").count() == docs.count() > 0, name
        if name == "benchmark decontamination":
            assert docs.filter("doc_id = 9005").count() == 0
        if name == "source mixing":
            assert docs.filter("text is null or text = ''").count() == 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), f"{tmp_path}/empty").count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:3:2]:
        assert stage(spark, odd, f"{tmp_path}/empty").count() == odd.count(), name
