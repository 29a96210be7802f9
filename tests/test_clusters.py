"""Bounded vector search and dealt batches of queries against whole scans; table functions; sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridmail.functions import text as T
from hybridmail.operators import clusters, relational, vectors
from hybridmail.sources import mail

UNITS = "message_id string, v array<double>"


def units(spark, n=3000, d=16, clustered=True, seed=1):
    r = np.random.RandomState(seed)
    x = r.randn(n, d) * 0.15 + (r.randn(30, d)[r.randint(0, 30, n)] if clustered else 0) + (0 if clustered else r.randn(n, d))
    rows = [(f"m{i % (n // 2):05d}", v.tolist()) for i, v in enumerate(x)] + [("odd", [0.0] * d), ("other", [1.0, 2.0]), ("none", None)]
    return spark.createDataFrame(rows, UNITS).select("message_id", vectors.normalised(F.col("v")).alias("unit")).persist(), x


@pytest.mark.parametrize("clustered", [True, False])
def test_bounded_is_a_whole_scan(spark, tmp_path, clustered):
    rows, x = units(spark, clustered=clustered)
    index = clusters.build(rows, f"file://{tmp_path}/c")
    assert index.vectors.count() == 3001
    for q in (x[0].tolist(), (x[1] * 5).tolist(), x[2:9].sum(axis=0).tolist(), [1.0, 1.0], [0.0] * 16):
        for pool in (1, 20, 5000):
            wanted = [(r["message_id"], r["similarity"]) for r in vectors.top_messages(rows.filter("message_id <> 'odd'"), q, pool).orderBy("vector_rank").collect()]
            got = clusters.nearest(index, q, pool)
            assert [m for m, _ in got.rows] == [m for m, _ in wanted] and [s for _, s in got.rows] == pytest.approx([s for _, s in wanted])
            if clustered and len(q) == 16 and pool == 1 and any(q):
                assert got.read < 0.7 * got.clusters
    again = clusters.opened(spark, f"file://{tmp_path}/c")
    assert clusters.ranked(spark, clusters.nearest(again, x[0].tolist(), 3)).count() == 3


def test_more_queries_than_a_driver_should_hold(spark, monkeypatch):
    rows, x = units(spark, n=600)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:130])] + [(900, [3.0, 4.0]), (901, [0.0, 0.0, 1.0])], "query_id long, v array<double>").select("query_id", vectors.normalised(F.col("v")).alias("query_unit"))
    plain = {tuple(r)[:2]: r["similarity"] for r in vectors.top_messages_batch(rows, asked, 7).collect()}
    for name, value in (("FEW", 50), ("QUERY_BLOCK", 40), ("GROUP", 100)):
        monkeypatch.setattr(vectors, name, value)
    dealt = {tuple(r)[:2]: r["similarity"] for r in vectors.top_messages_batch(rows, asked, 7).collect()}
    assert dealt.keys() == plain.keys() and len(dealt) == 130 * 7 + 1 and dealt == pytest.approx(plain)


def test_table_functions(spark, tmp_path):
    T.register(spark)
    mail.register(spark)
    texts = ["a short one", None, "", "word. " * 600, ("x" * 1500) + "\n\n" + "y" * 800]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [tuple(r) for r in spark.sql("select d.id, c.chunk_index, c.chunk from {d} d, lateral split_chunks(text) c order by 1, 2", d=df).collect()]
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(T.split_chunks(t or ""))]
    data = b"From a@x\nSubject: 1\n\none\n>From here\n\nFrom b@x\nSubject: 2\n\ntwo\n"
    boxes = spark.createDataFrame([("p", bytearray(data)), ("q", None)], "path string, content binary")
    got = [tuple(r) for r in spark.sql("select path, m.msg_index, m.message from {b} b, lateral split_mbox(content) m order by 2", b=boxes).collect()]
    assert [(p, i, bytes(m)) for p, i, m in got] == [("p", i, m) for i, m in enumerate(mail.split_mbox(data))] and len(got) == 2


def test_sketches_merge(spark):
    ids = spark.range(30_000).select(F.concat_ws(":", F.concat(F.lit("m:"), (F.col("id") % 10_000).cast("string")), F.lit("7")).alias("id"))
    one = relational.message_sketch(ids.filter("id < 'm:5'")).unionByName(relational.message_sketch(ids.filter("id >= 'm:3'")))
    assert abs(relational.merged_estimate(one).first()[0] - 10_000) < 300
    assert relational.merged_estimate(one.limit(0)).first()[0] == 0
