"""Mail files, mailboxes and messages."""

import pytest
from pyspark.sql import functions as F

from hybridmail.errors import InvalidInput, MailParse, NotFound
from hybridmail.sources import mail

PLAIN = b"From: Ann Lee <Ann@Mail.Example>\r\nTo: Bob <bob@x.example>, c@x.example\r\nCc: D <d@x.example>\r\nSubject: Lunch plans\r\nDate: Tue, 05 Mar 2024 10:00:00 +0200\r\nMessage-ID: <one@mail.example>\r\nIn-Reply-To: <zero@mail.example>\r\nReferences: <root@mail.example> <zero@mail.example>\r\n\r\nSee you at noon.\r\n"


def test_plain_message():
    m = mail.parse(PLAIN)
    assert (m["subject"], m["sender"], m["sender_email"], m["sender_domain"]) == ("Lunch plans", "Ann Lee", "Ann@Mail.Example", "mail.example")
    assert m["recipients"] == "Bob <bob@x.example>, c@x.example, D <d@x.example>"
    assert m["message_id"] == "one@mail.example" and m["in_reply_to"] == ["zero@mail.example"] and m["refs"][0] == "root@mail.example"
    assert str(m["sent_at"]) == "2024-03-05 08:00:00" and m["body_plain"].startswith("See you") and not m["has_attachments"]


def test_no_name_gives_no_sender():
    m = mail.parse(b"From: ann@mail.example\nSubject: x\n\nhi")
    assert m["sender"] is None and m["sender_email"] == "ann@mail.example" and m["recipients"] is None and m["sent_at"] is None


def test_markup_body_falls_to_html():
    raw = b'From: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\n\n[{"@context": "x"}]\n--B\nContent-Type: text/html\n\n<p>Real <b>prose</b></p>\n--B--\n'
    m = mail.parse(raw)
    assert m["body_plain"] == "Real prose" and "<b>" in m["body_html"]


def test_attachments():
    raw = b"From: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nhi\n--B\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=x.pdf\n\nx\n--B--\n"
    assert mail.parse(raw)["has_attachments"]


@pytest.mark.parametrize(
    ("data", "wanted"),
    [(b"5\nhello<?xml", b"hello"), (b"99\nhello", b"hello"), (b"12 bytes\nhello\n<?xml x", b"12 bytes\nhello"), (b"0\nhello\n<?xml x", b"0\nhello"), (b"abc\nhello", b"abc\nhello")],
)
def test_emlx(data, wanted):
    assert mail.parse_emlx(data) == wanted


def test_emlx_without_line():
    with pytest.raises(MailParse):
        mail.parse_emlx(b"hello")


def test_mbox():
    data = b"junk\nFrom a Mon\nSubject: one\n\n>From here\n>>From there\nFrom b Tue\nSubject: two\n\nbody\n"
    assert mail.split_mbox(data) == [b"Subject: one\n\nFrom here\n>From there\n", b"Subject: two\n\nbody\n"]
    assert mail.split_mbox(b"Subject: x\n\nbody") == [b"Subject: x\n\nbody"]
    assert mail.split_mbox(b"From a\nS: 1\n\nx\nFrom b\n \n") == [b"S: 1\n\nx\n"]


def test_mbox_by_splits(spark, tmp_path):
    """Boxes cut into many splits hold the messages that the whole ones do, under the same numbers."""
    import random

    deal = random.Random(5)
    (tmp_path / "a.eml").write_bytes(PLAIN)
    for box in range(6):
        parts = [b"From someone\nSubject: %d-%d\n\n%s\n" % (box, i, deal.choice([b"x", b">From y", b"From", b"z\n" * 90]) * deal.randint(1, 9)) for i in range(120)]
        parts[50:50] = [b"From blank\n\n"] * 2
        (tmp_path / f"{box}.{'mbox' if box % 2 else 'MBox'}").write_bytes((b"", b"before\n", b"")[box % 3] + b"".join(parts).rstrip(b"\n" if box < 3 else b""))
    (tmp_path / "one.mbox").write_bytes(b"Subject: alone\n\nno separator\n")
    (tmp_path / "long.mbox").write_bytes(b"before" * 400 + b"\nFrom a\nSubject: late\n\nx\n")
    (tmp_path / "empty.mbox").write_bytes(b"")
    named = ["name", "msg_index", "status", "subject", "trimmed"]
    rows = lambda df: sorted(df.withColumns({"name": F.element_at(F.split("path", "/"), -1), "trimmed": F.rtrim(F.regexp_replace("body_plain", r"\s+$", ""))}).select(named).collect(), key=str)
    wanted = rows(mail.parse_files(mail.discover(spark, str(tmp_path))))
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "3000", old):
        spark.conf.set(key, size)
        try:
            read = mail.parse_path(spark, str(tmp_path)).persist()
            assert rows(mail.numbered(read)) == wanted, size
            if size != old:
                assert read.select("path", "block").distinct().count() > 20
        finally:
            spark.conf.set(key, old)
            read.unpersist()
    alone = mail.parse_path(spark, str(tmp_path / "1.mbox"))
    assert mail.report(mail.numbered(alone)).first()["imported"] == 120


def test_discovery_and_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.EML").write_bytes(PLAIN)
    (tmp_path / "in/b.mbox").write_bytes(b"From x\n" + PLAIN + b"From y\nno headers at all")
    (tmp_path / "in/c.emlx").write_bytes(b"nothing")
    (tmp_path / "in/d.pdf").write_bytes(b"skip me")
    files = mail.discover(spark, str(tmp_path))
    assert files.count() == 3
    parsed = mail.parse_files(files)
    assert mail.report(parsed).first()[:] == (2, 1, 1)
    assert parsed.filter("status = 'parsed'").select("thread_id").distinct().collect()[0][0] == "zero@mail.example"
    assert mail.discover(spark, str(tmp_path / "in/d.pdf")).count() == 1
    assert mail.discover(spark, str(tmp_path), apple=True).count() == 1
    with pytest.raises(NotFound):
        mail.discover(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(InvalidInput):
        mail.discover(spark, str(tmp_path / "empty"))


def test_a_batch_is_handed_on_by_pieces(monkeypatch):
    """Rows of many messages don't wait for the batch's or the file's end, and headers are parsed once each."""
    import pyarrow as pa

    monkeypatch.setattr(mail, "HANDED", 1000)
    one = b"From: a@x\r\nSubject: s\r\n\r\n" + b"b" * 300
    box = b"junk\n" + b"".join(b"From a\n" + one + b"\n\n" for _ in range(20)) + b"From a\n" + b"From b\n>From: c@y\n\n>From it\n"
    files = pa.RecordBatch.from_pydict({"path": ["a.mbox", "b.eml", "c.emlx"], "content": [box, one, b"bad"]})
    got = list(mail._expand(iter([files])))
    assert max(len(b) for b in got) <= 4 and len(got) >= 6
    rows = [(r["path"], r["msg_index"], r["status"]) for b in got for r in b.to_pylist()]
    assert rows == [("a.mbox", i, "parsed") for i in range(21)] + [("b.eml", 0, "parsed"), ("c.emlx", 0, "error")]
    calls = []
    fetch = mail.email.policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(mail.email.policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: calls.append(name) or fetch(self, name, value))
    mail.parse(b"From: a@x\nTo: b@y\nMessage-ID: <1@x>\nReferences: r\nDate: Mon, 02 Jan 2023 10:00:00 +0100\n\nx")
    assert len(calls) == len(set(calls))


@pytest.mark.parametrize("data", [b"", b"\n", b"x", b"From a", b"From a\n", b"From a\nFrom b\nx", b"y\nFrom a\r\n\r\n", b"From a\nx\n>From y\n>>From z\nFrom b\n\n", b"a\rFrom x\nFrom y\nb", b" From a\nFrom b\nq\nFrom c"])
def test_mbox_against_lines(data):
    lines = __import__("re").findall(rb"[^\n]*\n|[^\n]+", data)
    heads = [i for i, line in enumerate(lines) if line.startswith(b"From ")]
    bounds = [*zip([h + 1 for h in heads], [*heads[1:], len(lines)], strict=True)] if heads else [(0, len(lines))]
    parts = [b"".join(lines[a:b]) for a, b in bounds]
    assert mail.split_mbox(data) == [mail._QUOTED_FROM.sub(rb"\1", p) for p in [*[p for p in parts[:-1] if p], *[p for p in parts[-1:] if p.strip()]]]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [(b"From: a@b.c\n\n", ""), (b"From: a@b.c\r\n\r\n", ""), (b"From: a@b.c\n\n \r\n", " \r\n"), (b"From: a@b.c\n", None), (b"From: a@b.c\r\n", None), (b"From: a@b.c", None), (b'From: a@b.c\n\n{"@type": 1}', None)],
)
def test_blank_body(raw, plain):
    """A blank body is a text; a message that ends with its headers has none."""
    assert mail.parse(raw)["body_plain"] == plain


def test_page_instead_of_blank_text():
    part = b"From: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\n\n \n%s--B--\n"
    assert mail.parse(part % b"--B\nContent-Type: text/html\n\n<p>Hi</p>\n")["body_plain"] == "Hi"
    assert mail.parse(part % b"")["body_plain"] == " "


TEXTS = [None, "", " ", "\r\n", " \n\n", "\xa0", '{"@type": "x"} y', ' [{"@context": 1}]\n ', "\x1c\u2028{@type", "[ {@type", "{ brace", "\rFrom x", "x\x00\x0b\x85\u2028\ufeff y ", "From a\n>From b", "<p>@type &amp; {</p>", "z" * 9000 + "\r"]


@pytest.mark.parametrize("name", ["parse_emlx", "parse_rfc822", "split_mbox", "import_counters"])
def test_queries_on_odd_texts(spark, tmp_path, name):
    """Each text comes back as it was, whatever it holds."""
    import duckdb

    from hybridmail.plans.catalogue import ORACLE_SQL, QUERIES

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS * 8)], "doc_id long, text string").write.parquet(path)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{path}/*.parquet'")
    wanted = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(wanted.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted.fetchall(), key=str)
