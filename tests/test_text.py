"""The text kernel: cleaning, compaction, chunking."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hybridmail.functions import text as T


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("a &amp; b &lt;c&gt; &quot;d&quot;", 'a & b <c> "d"'),
        ("&#233; &#xE9; &#XE9;", "é é é"),
        ("AT&T and A & B", "AT&T and A & B"),
        ("&amp;amp;", "&amp;"),
        ("&unknown; &#xD800; &#99999999;", "&unknown; &#xD800; &#99999999;"),
        ("&zwnj;x&nbsp;y", "‌x y"),
        ("<https://a.example/?x=1&amp;y=2>", "<https://a.example/?x=1&y=2>"),
        ("&#00000233; &#000000233; &#xe9; &abcdefghij;", "é &#000000233; é &abcdefghij;"),
        ("", ""),
    ],
)
def test_entities(given, wanted):
    assert T.decode_entities(given) == wanted


def test_css_goes_and_prose_stays():
    s = "Hello there friend.\n@media screen{.x{color:red;}} Tail prose.\n.a .b{margin:0 !important;}\nLast line."
    out = T.strip_css(s)
    assert "Hello there friend." in out and "Tail prose." in out and "Last line." in out
    assert "{" not in out and "margin" not in out


def test_css_stops_at_a_sentence_end():
    assert T.strip_css("Good news. .x{a:b;}end") == "Good news.end"


@pytest.mark.parametrize("s", ['Here { "k": "v" } stays', "open { brace only : ;", "{ never closed; a:b"])
def test_css_keeps_other_braces(s):
    assert T.strip_css(s) == s


def test_clean_body_order():
    assert T.clean_body("prose &zwnj;&zwnj;&#8203;end") == "prose end"


def test_native_functions(spark):
    rows = [("  a  \n b  ",), ("x" * 300,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.compact(F.col("t"), 5)).collect()]
    assert got == ["a b", "xxxxx", "", None]
    # The leading space counts, so one character less is kept.
    assert spark.createDataFrame([(" abcdef",)], "t string").select(T.compact(F.col("t"), 3)).first()[0] == "ab"
    marks = spark.createDataFrame([(' [{"@context": 1}]',), ('{"@type": 1}',), ("prose with {braces}",), ("",), (None,)], "t string").select(T.looks_like_markup(F.col("t"))).collect()
    assert [r[0] for r in marks] == [True, True, False, False, False]
    assert spark.range(1).select(T.strip_invisible(F.lit("a‌b﻿͏c­‎d"))).first()[0] == "abcd"
    assert spark.range(1).select(T.clip(F.lit("abcdef"), 3), T.clip(F.lit("abc"), 3)).first()[:] == ("abc…", "abc")


def test_recency_and_age(spark):
    now = F.lit("2025-01-01 12:00:00").cast("timestamp")
    ages = {"2024-12-31 13:00:00": (0, " (today)"), "2024-12-25 12:00:00": (7, " (7 days ago)"), "2024-11-20 00:00:00": (42, " (1 month ago)"), "2023-01-01 00:00:00": (731, " (2 years ago)"), "2025-01-01 20:00:00": (0, " (today)"), "2025-02-01 00:00:00": (0, "")}
    rows = spark.createDataFrame([(k,) for k in ages], "d string").select("d", T.recency_factor(F.col("d").cast("timestamp"), now).alias("r"), T.relative_age(F.col("d").cast("timestamp"), now).alias("a")).collect()
    import math

    for r in rows:
        days, text = ages[r["d"]]
        assert r["a"] == text
        assert r["r"] == pytest.approx(0.5 + 0.5 * math.exp(-days / 180))
    assert spark.range(1).select(T.recency_factor(F.lit(None).cast("timestamp"), now)).first()[0] == 1.0
    parsed = spark.createDataFrame([("2026-05-02",), ("2026-05-02T10:00:00Z",), ("2026-05-02T10:00:00+02:00",), ("x",), (None,)], "d string").select(T.timestamp_of(F.col("d")).isNotNull()).collect()
    assert [r[0] for r in parsed] == [False, True, True, False, False]


def test_bulk(spark):
    rows = [("please Unsubscribe here", "a@b"), ("hi", "Newsletter@x"), ("hi", "mailer@x"), ("hi", "app-notifications@x"), ("hi", "no-reply@x"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, s string").select(T.is_bulk(F.col("b"), F.col("s"))).collect()]
    assert got == [True, True, True, True, False, False]


def test_small_helpers(spark):
    one = spark.range(1)
    assert one.select(*[T.initials(F.lit(x)) for x in ("ann lee", "Ann Maria  Lee", "bob", " ")]).first()[:] == ("AL", "AL", "B", "?")
    assert one.select(T.message_link(F.lit("<a b@c.example>"))).first()[0] == "message:%3Ca%20b%40c.example%3E"
    assert one.select(T.imap_host(F.lit("x@GMAIL.com")), T.imap_host(F.lit("x@work.example"))).first()[:] == ("imap.gmail.com", "imap.mail.me.com")
    assert one.select(T.is_rate_limit(F.lit("Throttled")), T.is_rate_limit(F.lit(None).cast("string"))).first()[:] == (True, False)
    assert one.select(T.minutes_left(F.lit(130), F.lit(10)), T.minutes_left(F.lit(5), F.lit(10)), T.minutes_left(F.lit(71), F.lit(10))).first()[:] == (2, 0, 2)
    assert one.select(T.is_recency_question(F.lit("renew my plan")), T.is_recency_question(F.lit("renew my plan"), True)).first()[:] == (True, False)


def test_chunks():
    assert T.split_chunks("hello world") == ["hello world"]
    assert T.split_chunks("  ") == []
    assert [len(x) for x in T.split_chunks("x" * 800 + "\n\n" + "y" * 800)] == [800, 800]
    assert T.split_chunks("z" * 2500) == ["z" * 1000, "z" * 1000, "z" * 500]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=4000))
def test_chunks_hold_every_word(s):
    chunks = T.split_chunks(s)
    assert all(0 < len(c) <= T.CHUNK for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(s.split())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a.{};:\n &amp", max_size=200))
def test_css_never_adds(s):
    out = T.strip_css(s)
    assert len(out) <= len(s) and T.strip_css(out) is not None


# -- second versions, a character at a time ---------------------------------------------------------------------------


def css_by_stack(s):
    closes, open_ = {}, []
    for i, c in enumerate(s):
        if c == "{":
            open_.append(i)
        elif c == "}" and open_:
            closes[open_.pop()] = i
    keep, i, first = [True] * len(s), 0, 0
    while i < len(s):
        if s[i] == "{" and i in closes:
            j = closes[i]
            if ":" in s[i : j + 1] and ";" in s[i : j + 1]:
                k = i
                while k > first and not (s[k - 1] == "\n" or (s[k - 1] in ".!?" and k < i and s[k].isspace() and k - 1 > first and s[k - 2].isalpha())):
                    k -= 1
                keep[k : j + 1] = [False] * (j + 1 - k)
                first = j + 1
            i = j
        i += 1
    return "".join(c for c, kept in zip(s, keep, strict=True) if kept)


def sentences_by_character(s):
    out, now = [], ""
    for c in s:
        now += c
        if c in ".!?\n" and len(now.strip()) > T.LEAST_SENTENCE:
            out.append(now.strip())
            now = ""
    return [*out, now.strip()] if now.strip() else out


def chunks_by_character(s, most, least):
    s = s.strip()
    if len(s) <= most:
        return [s] if s else []
    done, line = [], []  # line: words and sentences of the chunk being made
    size = lambda: sum(map(len, line)) + max(0, len(line) - 1)
    for paragraph in s.split("\n\n"):
        for sentence in sentences_by_character(paragraph):
            if line and size() + 1 + len(sentence) > most:
                done.append(" ".join(line))
                line = []
            whole, rest = divmod(len(sentence), most)
            if len(sentence) > most:
                cuts = whole if rest else whole - 1  # the last piece, whole or not, goes on
                done += [sentence[k * most : (k + 1) * most] for k in range(cuts)]
                sentence = sentence[cuts * most :]
            line.append(sentence)
        if size() >= least:
            done.append(" ".join(line))
            line = []
    return [x.strip() for x in [*done, " ".join(line)] if x.strip()]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 {}:;.!?\n\té_", max_size=60))
def test_strip_css_second_version(s):
    assert T.strip_css(s) == css_by_stack(s)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", ". ", "\n", "\n\n", "!", "é" * 30, "x" * 47, "a. b. c", "  "]), max_size=60).map("".join), st.integers(20, 60), st.integers(1, 20))
def test_split_chunks_second_version(s, most, least):
    assert T.split_sentences(s) == sentences_by_character(s)
    assert T.split_chunks(s, most, least) == chunks_by_character(s, most, least)


def test_texts_are_taken_by_pieces(spark):
    import pyarrow as pa

    from hybridmail.functions import text

    x = pa.array(["a" * 10, None, "b" * 100, "", "c", "d" * 30])
    assert list(text.pieces(x, 20)) == [(0, 2), (2, 1), (3, 2), (5, 1)] and list(text.pieces(x, 1000)) == [(0, 6)] and list(text.pieces(x[:0], 5)) == []
    texts = [None if i % 7 == 0 else "&amp;" * (i % 5) + "x" * 3000 * (i % 11) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = dict(df.select("i", text.decode_entities_udf("t")).collect())
    assert got == {i: None if t is None else text.decode_entities(t) for i, t in enumerate(texts)}
