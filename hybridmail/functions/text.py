"""Text and date functions: native expressions wherever Spark has them, Arrow UDFs for the stateful scans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType

# Fixed values that results depend on.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "zwnj": "\u200c", "zwj": "\u200d", "zwsp": "\u200b", "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "hellip": "\u2026", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122"}
INVISIBLE = r"[\u200B-\u200F\uFEFF\u034F\u00AD]"
RECENCY_TERMS = ("new", "recent", "latest", "newest", "upcoming", "lately", "so far", "this week", "these days", "current", "any updates")
IMAP_HOSTS = {"@icloud.com": "imap.mail.me.com", "@me.com": "imap.mail.me.com", "@mac.com": "imap.mail.me.com", "@gmail.com": "imap.gmail.com"}
DEFAULT_IMAP_HOST = "imap.mail.me.com"
HALF_LIFE_DAYS = 180
#: Bytes of text of an Arrow batch that are Python objects at once.
PIECE = 1 << 20
SNIPPET, BODY, PREVIEW = 200, 8000, 360
CHUNK, LEAST_CHUNK, LEAST_SENTENCE = 1000, 60, 8


# -- native ----------------------------------------------------------------------------------------------------------


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def compact(c: Column, n: int) -> Column:
    """Runs of white space to one space, cut at n characters (a leading space counts), trimmed."""
    return F.trim(F.left(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(n)))


def looks_like_markup(c: Column) -> Column:
    t = F.ltrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+", ""))
    return (t.startswith("{") | t.startswith("[{")) & (t.contains("@context") | t.contains("@type"))


def preview(c: Column, n: int = PREVIEW) -> Column:
    return F.left(c, F.lit(n))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("\u2026"))).otherwise(c)


def chunk_input(subject: Column, sender: Column, recipients: Column, cleaned: Column) -> Column:
    """Header lines, a blank line, then the compacted body."""
    return F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("")), F.lit("\nFrom: "), F.coalesce(sender, F.lit("")), F.lit("\nTo: "), F.coalesce(recipients, F.lit("")), F.lit("\n\n"), compact(F.coalesce(cleaned, F.lit("")), BODY))


def elapsed_days(at: Column, now: Column) -> Column:
    """Whole periods of 24 hours, toward minus infinity."""
    return F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / F.lit(86400).cast("double"))


def recency_factor(at: Column, now: Column) -> Column:
    """0.5 + 0.5 * exp(-days / 180); 1 without a date."""
    days = F.greatest(elapsed_days(at, now), F.lit(0))
    return F.when(at.isNull(), F.lit(1.0)).otherwise(F.lit(0.5) + F.lit(0.5) * F.exp(-days / F.lit(float(HALF_LIFE_DAYS))))


def timestamp_of(c: Column) -> Column:
    """Timestamp of RFC 3339 text with time and offset, else null."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(c))


def relative_age(at: Column, now: Column) -> Column:
    """' (3 days ago)' and the like; empty for no or a future date."""
    s = F.unix_seconds(now) - F.unix_seconds(at)
    d = F.floor(s / F.lit(86400).cast("double"))
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    # Of a day less than one in the future the whole days are none, too.
    text = F.when(d <= 1, F.lit("today")).when(d < 30, F.concat(d.cast("string"), F.lit(" days ago"))).when(d < 365, ago(F.floor(d / 30), "month")).otherwise(ago(F.floor(d / 365), "year"))
    return F.when(at.isNull() | (s <= -86400), F.lit("")).otherwise(F.concat(F.lit(" ("), text, F.lit(")")))


def relative_time(at: Column, now: Column) -> Column:
    """Short form for lists: just now, 5m, 3h, 2d, 1w, 4mo, 2y."""
    s = F.greatest(F.unix_seconds(now) - F.unix_seconds(at), F.lit(0))
    part = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(unit))
    day = 86400
    return F.when(s < 45, "just now").when(s < 3600, part(60, "m")).when(s < day, part(3600, "h")).when(s < 7 * day, part(day, "d")).when(s < 30 * day, part(7 * day, "w")).when(s < 365 * day, part(30 * day, "mo")).otherwise(part(365 * day, "y"))


def is_bulk(body: Column, sender: Column) -> Column:
    """Mentions unsubscribing, or comes from a newsletter, mailer or notifications address; 'no-reply' alone isn't bulk."""
    b, s = (F.lower(F.coalesce(c, F.lit(""))) for c in (body, sender))
    return b.like("%unsubscribe%") | s.like("newsletter%") | s.like("mailer%") | s.like("%notifications@%")


def is_recency_question(c: Column, word_boundary: bool = False) -> Column:
    terms = "|".join(map(re.escape, RECENCY_TERMS))
    return F.lower(c).rlike(rf"\b(?:{terms})\b" if word_boundary else f"(?:{terms})")


def confidence(score: Column, top: Column) -> tuple[Column, Column]:
    share = F.when(top > 0, F.least(F.lit(1.0), score / top)).otherwise(F.lit(0.0))
    return share, F.when(share >= 0.75, "high").when(share >= 0.5, "medium").otherwise("low")


def imap_host(email: Column) -> Column:
    e = F.lower(F.coalesce(email, F.lit("")))
    return F.coalesce(*[F.when(e.endswith(k), F.lit(v)) for k, v in IMAP_HOSTS.items()], F.lit(DEFAULT_IMAP_HOST))


def message_link(message_id: Column) -> Column:
    return F.concat(F.lit("message:%3C"), F.replace(F.url_encode(F.regexp_replace(message_id, r"^<|>$", "")), F.lit("+"), F.lit("%20")), F.lit("%3E"))


def is_rate_limit(error: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    return e.contains("rate") | e.contains("throttl") | e.contains("unavailable")


def minutes_left(until: Column, now: Column) -> Column:
    """Whole minutes of a cooldown that are left, both in epoch seconds."""
    return F.when(until > now, F.ceil((until - now) / F.lit(60.0))).otherwise(F.lit(0)).cast("long")


def avatar_hue(name: Column) -> Column:
    """A colour out of eight, of a 32-bit rolling hash of the characters."""
    h = F.aggregate(F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(2**32)))
    signed = F.when(h >= 2**31, F.lit(2**32) - h).otherwise(h)
    return (signed % 8).cast("int")


def initials(name: Column) -> Column:
    """Up to two capitals: of the first and the last word, or of the first one alone; a question mark without words."""
    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    first = lambda w: F.upper(F.substring(w, 1, 1))
    return F.when(F.size(words) == 0, F.lit("?")).when(F.size(words) == 1, first(words[0])).otherwise(F.concat(first(words[0]), first(F.element_at(words, -1))))


# -- scans with state -----------------------------------------------------------------------------------------------

_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);")


def decode_entities(s: str) -> str:
    """Named (of ENTITIES) and numeric references, once; others stay, as do those whose semicolon is more than ten characters behind the ampersand."""
    if "&" not in s:
        return s

    def one(m: re.Match) -> str:
        name = m[1]
        if len(name) > 9:
            return m[0]
        if name[0] != "#":
            return ENTITIES.get(name, m[0])
        n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _REFERENCE.sub(one, s)


_SENTENCE_END = re.compile(r"(?<=[^\W\d_])[.!?](?=\s)")
_INVISIBLE = re.compile(INVISIBLE)


def _closing(s: str, at: int) -> int:
    """Place after the brace that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(s, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def strip_css(s: str) -> str:
    """Without the balanced blocks that hold a colon and a semicolon, each with its selector: back to a line's or sentence's end."""
    if "{" not in s:
        return s
    out: list[str] = []
    kept_from = at = 0
    unclosed = False
    while (brace := s.find("{", at)) >= 0:
        end = -1 if unclosed and s.find("}", brace) < 0 else _closing(s, brace)
        if end < 0:
            unclosed = True
            at = brace + 1
            continue
        block = s[brace:end]
        if ":" in block and ";" in block:
            before = s[kept_from:brace]
            cut = before.rfind("\n") + 1
            for m in _SENTENCE_END.finditer(before, cut):
                cut = m.end()
            out.append(before[:cut])
            kept_from = end
        at = end
    return "".join([*out, s[kept_from:]])


def clean_body(s: str) -> str:
    return strip_css(_INVISIBLE.sub("", decode_entities(s)))


def split_sentences(s: str) -> list[str]:
    out, first = [], 0
    for m in re.finditer(r"[.!?\n]", s):
        part = s[first : m.end()].strip()
        if len(part) > LEAST_SENTENCE:
            out.append(part)
            first = m.end()
    if rest := s[first:].strip():
        out.append(rest)
    return out


def split_chunks(s: str, most: int = CHUNK, least: int = LEAST_CHUNK) -> list[str]:
    """Chunks of at most `most` characters: paragraphs, then sentences packed greedily, then hard cuts. A paragraph's short rest joins the next."""
    s = s.strip()
    if not s:
        return []
    if len(s) <= most:
        return [s]
    out: list[str] = []
    held = ""
    for paragraph in s.split("\n\n"):
        for sentence in split_sentences(paragraph):
            if held and len(held) + 1 + len(sentence) > most:
                out.append(held)
                held = ""
            while len(sentence) > most:
                out.append(sentence[:most])
                sentence = sentence[most:]
            held = f"{held} {sentence}" if held else sentence
        if len(held) >= least:
            out.append(held)
            held = ""
    return [x for x in (y.strip() for y in [*out, held]) if x]


def pieces(x: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, number) of slices of rows of at most `most` (PIECE) bytes of a text or binary column, or of one row."""
    size = pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else pc.fill_null(pc.binary_length(x), 0).to_numpy()
    ends, most, first = size.astype("int64").cumsum(), most or PIECE, 0
    while first < len(size):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(ends.searchsorted(before + most, "right")))
        yield first, end - first
        first = end


def _text_udf(f: Callable[[str], object], kind: DataType):
    """f over texts, null for null; a batch is taken and handed back by pieces, so that it isn't held in Python as a whole."""
    to = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            for first, n in pieces(x):
                yield pa.array([None if s is None else f(s) for s in x.slice(first, n).to_pylist()], to)

    return apply


decode_entities_udf = _text_udf(decode_entities, StringType())
strip_css_udf = _text_udf(strip_css, StringType())
clean_body_udf = _text_udf(clean_body, StringType())
split_chunks_udf = _text_udf(split_chunks, ArrayType(StringType()))


class SplitChunks:
    """split_chunks as a table function: a row for each chunk of a text; none for a null one."""

    def eval(self, text: str):
        yield from enumerate(split_chunks(text or ""))


split_chunks_table = F.udtf(SplitChunks, returnType="chunk_index int, chunk string", useArrow=True)


def register(spark) -> None:
    """Makes the table functions known to SQL: select ..., c.* from messages, lateral split_chunks(body) c."""
    spark.udtf.register("split_chunks", split_chunks_table)
