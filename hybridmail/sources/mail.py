"""Mail sources: files of RFC 822 messages, emlx, mbox; parsing; a feed read by UID above a watermark."""

from __future__ import annotations

import email
import email.parser
import email.policy
import html
import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC
from email.utils import getaddresses, parsedate_to_datetime
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.errors import InvalidInput, MailParse, NotFound, RateLimited

# Fixed values that results depend on.
EXTENSIONS = ("eml", "emlx", "mbox", "msg", "txt")
WINDOW_DAYS = {"day": 1, "week": 7, "two_weeks": 14, "month": 30, "three_months": 90}
DEFAULT_WINDOW = "month"
BATCH, PAUSE_MS, BACK_OFF_S = 20, 250, 30

#: Splits of mbox files whose numbers are broadcast; beyond, they are joined by key.
BROADCAST_BLOCKS = 100_000


# -- files -----------------------------------------------------------------------------------------------------------


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isDirectory()


def discover(spark: SparkSession, path: str, apple: bool = False) -> DataFrame:
    """path, content of mail files: one file whatever its name, or all below a folder by extension (emlx alone for an Apple Mail folder)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise NotFound(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    if _is_folder(spark, path):
        wanted = "emlx" if apple else "|".join(EXTENSIONS)
        files = files.filter(F.col("path").rlike(rf"(?i)\.(?:{wanted})$"))
        if not apple and files.isEmpty():
            raise InvalidInput(f"no mail files below {path}")
    return files.select("path", "content")


def _glob(extensions: Iterable[str]) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


def parse_emlx(data: bytes) -> bytes:
    """The message of an emlx file: as many bytes as its first line says, else all before the property list."""
    first, newline, rest = data.partition(b"\n")
    if not newline:
        raise MailParse("emlx without a first line")
    count = first.strip()
    if re.fullmatch(rb"\+?[0-9]+", count) and int(count) and rest:
        return rest[: int(count)]
    at = data.find(b"\n<?xml")
    return data[:at] if at >= 0 else data


_FROM = re.compile(rb"^From ", re.M)
_QUOTED_FROM = re.compile(rb"^>(>*From )", re.M)


def in_mbox(data: bytes) -> Iterator[bytes]:
    """Messages between From lines, with quoted ones unquoted, one by one. What stands before the first separator is dropped; without one the whole is a message."""
    heads = [m.start() for m in _FROM.finditer(data)]
    ends = [*heads[1:], len(data)]
    for k, end in enumerate(ends):
        start = (data.find(b"\n", heads[k], end) + 1 or end) if heads else 0
        part = data[start:end]
        if part if end < len(data) else part.strip():
            yield _QUOTED_FROM.sub(rb"\1", part)


def split_mbox(data: bytes) -> list[bytes]:
    """in_mbox as a list."""
    return list(in_mbox(data))


class SplitMbox:
    """split_mbox as a table function: a row for each message of an mbox file's bytes."""

    def eval(self, content: bytes):
        yield from enumerate(in_mbox(bytes(content)) if content else ())


split_mbox_table = F.udtf(SplitMbox, returnType="msg_index int, message binary", useArrow=True)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL: select path, m.* from binaryFile.`...`, lateral split_mbox(content) m."""
    spark.udtf.register("split_mbox", split_mbox_table)


def messages_of(path: str, data: bytes) -> Iterator[bytes]:
    """By extension, else by the first bytes; messages of white space alone are left out."""
    kind = path.rpartition(".")[2].lower()
    if kind == "emlx":
        found = [parse_emlx(data)]
    elif kind == "mbox" or data.startswith(b"From "):
        found = in_mbox(data)
    else:
        found = [data]
    return (x for x in found if x.strip())


# -- messages --------------------------------------------------------------------------------------------------------

PARSED = "message_id string, in_reply_to array<string>, refs array<string>, subject string, sender string, sender_email string, sender_domain string, recipients string, sent_at timestamp, body_plain string, body_html string, has_attachments boolean, raw_size long"
_ID = re.compile(r"<([^<>\s]+)>")
_MARKUP = re.compile(r"\s*(?:\{|\[\{)")
#: The blank line at the end of a message that has a body, but an empty one.
_EMPTY_BODY = re.compile(rb"(?:\r\n|\n|\r(?!\n))(?:\r\n|\n|\r)\Z")


def is_markup(text: str) -> bool:
    return bool(_MARKUP.match(text)) and ("@context" in text or "@type" in text)


_BLOCK = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>")
_TAG = re.compile(r"<[^>]+>")


def html_to_text(s: str) -> str:
    s = _TAG.sub("", _BREAK.sub("\n", _BLOCK.sub("", s)))
    return re.sub(r"[ \t]*\n[ \t]*", "\n", html.unescape(s)).strip()


def _address(name: str, mail: str) -> str:
    return f"{name} <{mail}>" if name and mail else name or mail


def parse(raw: bytes) -> dict:
    """The fields of PARSED. Raises MailParse for what has no headers."""
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    if not message.keys():
        raise MailParse("no headers")
    modern = email.parser.BytesHeaderParser(policy=email.policy.default).parsebytes(raw)

    @cache  # a header is parsed each time it is asked for
    def header(name: str) -> str | None:
        try:
            value = modern[name]
        except Exception:  # noqa: BLE001  the parser of a malformed header may raise anything
            value = message[name]
        return None if value is None else str(value).replace("\r", "").replace("\n", " ").strip()

    ids = lambda name: _ID.findall(header(name) or "") or ((header(name) or "").split() if header(name) else [])
    senders = [x for x in getaddresses([header("From") or ""]) if x[0] or x[1]]
    name, mail = senders[0] if senders else ("", "")
    to = [_address(*x) for h in ("To", "Cc") for x in getaddresses([header(h) or ""]) if x[0] or x[1]]
    try:
        at = parsedate_to_datetime(header("Date")) if header("Date") else None
        at = at and (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None, microsecond=0)
    except (TypeError, ValueError):
        at = None
    texts, pages, attached = [], [], False
    for part in message.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type()
        if part.get_content_disposition() == "attachment" or part.get_filename() or part.get_content_maintype() != "text":
            attached |= kind != "message/rfc822"
            continue
        body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
        (pages if kind == "text/html" else texts).append(body)
    plain = next((x for x in texts if x.strip() and not is_markup(x)), None)
    if plain is None and pages:
        plain = html_to_text(pages[0])
    if plain is None and (message.get_payload() or _EMPTY_BODY.search(raw)):  # a blank body is a text; one that ends with its headers has none
        plain = next((x for x in texts if not x.strip()), None)
    domain = mail.split("@")[1].lower() if "@" in mail else None
    return {
        "message_id": next(iter(ids("Message-ID")), None), "in_reply_to": ids("In-Reply-To"), "refs": ids("References"), "subject": header("Subject"), "sender": name or None, "sender_email": mail or None,
        "sender_domain": domain, "recipients": ", ".join(to) or None, "sent_at": at, "body_plain": plain, "body_html": pages[0] if pages else None, "has_attachments": attached, "raw_size": len(raw),
    }


def thread_id(df: DataFrame) -> Column:
    return F.coalesce(F.get("in_reply_to", F.lit(0)), F.get("refs", F.lit(0)), F.col("message_id"))


_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def _parsed(path: str, i: int, raw: bytes) -> dict:
    try:
        return {"path": path, "msg_index": i, "status": "parsed", "error": None} | parse(raw)
    except MailParse as e:
        return {"path": path, "msg_index": i, "status": "skipped", "error": str(e)} | dict.fromkeys(_NAMES)


#: Dates are handed on without a zone, as pandas' are, and read in the session's.
_EXPANDED = f"path string, msg_index int, status string, error string, {PARSED.replace('sent_at timestamp', 'sent_at timestamp_ntz')}"
_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "timestamp_ntz": pa.timestamp("us"), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in _EXPANDED.split(", "))])
#: Rows of messages are handed on by so many bytes of messages.
HANDED = 4 << 20


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's files become Python objects one by one, and its messages' rows are handed on by HANDED bytes: neither a batch nor a large file's messages are held as rows."""
    none = dict.fromkeys(_NAMES)
    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            path, i = path.as_py(), 0
            try:
                for i, raw in enumerate(messages_of(path, bytes(content.as_py()))):
                    rows.append(_parsed(path, i, raw))
                    size += len(raw)
                    if size >= HANDED:
                        yield _batch_of(rows)
                        rows, size = [], 0
            except MailParse as e:
                rows.append({"path": path, "msg_index": 0, "status": "error", "error": str(e)} | none)
        if rows:
            yield _batch_of(rows)


def _batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def parse_files(files: DataFrame) -> DataFrame:
    """A row for each message of the files (path, content): status parsed, skipped (a message that can't be read) or error (a file that can't), and the fields."""
    df = _expanded(files)
    return df.withColumns({"thread_id": thread_id(df), "received_at": F.col("sent_at")})


def _expanded(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_expand, _EXPANDED).withColumn("sent_at", F.col("sent_at").cast("timestamp"))


def _expand_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages of mbox pieces, numbered within their split. A piece waits for the next: one before a separator gets back the line break that the separator took."""

    def message(path: str, block: int, value: bytes, first: bool, more: bool, k: int) -> dict | None:
        untitled = first and block == 0 and not value.startswith(b"From ")
        if untitled and more:  # what stands before the first separator
            return None
        body = value if untitled else value.partition(b"\n")[2]
        return _parsed(path, k, _QUOTED_FROM.sub(rb"\1", body)) | {"block": block, "untitled": untitled} if body.strip() else None

    held, first, k = None, True, 0  # held: path, block, whether the split ends the file, bytes
    for batch in batches:
        rows, size = [], 0
        for piece in zip(batch["path"], batch["block"], batch["ends"], batch["value"], strict=True):
            if held:
                same = piece[:2] == held[:2]
                row = message(held[0], int(held[1]), bytes(held[3]) + (b"\n" if same or not held[2] else b""), first, same, k)
                if row:
                    rows.append(row)
                    size += len(held[3])
                first, k = not same, (k + bool(row) if same else 0)
                if size >= HANDED:
                    yield pd.DataFrame(rows, columns=["path", "msg_index", "status", "error", *_NAMES, "block", "untitled"], dtype=object)
                    rows, size = [], 0
            held = piece
        yield pd.DataFrame(rows, columns=["path", "msg_index", "status", "error", *_NAMES, "block", "untitled"], dtype=object)
    if held:
        row = message(held[0], int(held[1]), bytes(held[3]) + (b"" if held[2] else b"\n"), first, False, k)
        if row:
            yield pd.DataFrame([row], columns=["path", "msg_index", "status", "error", *_NAMES, "block", "untitled"], dtype=object)


def parse_path(spark: SparkSession, path: str, apple: bool = False) -> DataFrame:
    """parse_files of what discover finds, with mbox files read by splits, cut at their separators, so that a large one is the work of many tasks.

    Messages of an mbox are numbered within their split (block; null for other files) until `numbered` has seen all rows: keep
    the result (persist or write it) and pass that on. The last message of a file that reaches over the file's last split ends
    with a line break more than the file has."""
    files = discover(spark, path, apple)
    schema = f"path string, msg_index int, status string, error string, {PARSED}"
    alone = not _is_folder(spark, path)
    boxes = None
    if apple or (alone and not path.lower().endswith(".mbox")):
        whole = files
    else:
        read = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        whole = None if alone else read.format("binaryFile").option("pathGlobFilter", _glob(x for x in EXTENSIONS if x != "mbox")).load(path).select("path", "content")
        text = read.option("lineSep", "\nFrom ").option("pathGlobFilter", _glob(["mbox"])).text(path)
        at = F.col("_metadata")
        pieces = text.select(
            F.regexp_replace(at["file_path"], "^file:/+", "file:/").alias("path"),
            at["file_block_start"].alias("block"),
            (at["file_block_start"] + at["file_block_length"] >= at["file_size"]).alias("ends"),
            F.col("value").cast("binary").alias("value"),
        )
        boxes = pieces.mapInPandas(_expand_pieces, f"{schema}, block long, untitled boolean")
    parts = [x for x in (boxes, None if whole is None else _expanded(whole).withColumns({"block": F.lit(None).cast("long"), "untitled": F.lit(False)})) if x is not None]
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return df.withColumns({"thread_id": thread_id(df), "received_at": F.col("sent_at")})


def numbered(parsed: DataFrame) -> DataFrame:
    """Rows of parse_path with the messages of an mbox numbered through all its splits, and without what stands before its first separator."""
    if parsed.filter("block > 0").isEmpty():
        return parsed.drop("block", "untitled")
    file = Window.partitionBy("path")
    blocks = parsed.filter("block is not null").groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.bool_or("untitled").alias("odd"))
    blocks = blocks.withColumns({"before": F.sum("n").over(file.orderBy("block")) - F.col("n"), "junk": F.bool_or("odd").over(file) & (F.count(F.lit(1)).over(file) > 1)})
    blocks = blocks.select("path", "block", "junk", (F.col("before") - F.when(F.col("junk") & (F.col("block") > 0), 1).otherwise(0)).alias("before")).persist()
    try:
        side = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
        df = parsed.join(side, ["path", "block"], "left").filter(~(F.col("untitled") & F.coalesce("junk", F.lit(False))))
        return df.withColumn("msg_index", (F.col("msg_index") + F.coalesce("before", F.lit(0))).cast("int")).drop("block", "untitled", "junk", "before")
    finally:
        blocks.unpersist()


def report(parsed: DataFrame) -> DataFrame:
    return parsed.agg(*[F.count_if(F.col("status") == k).alias(v) for k, v in (("parsed", "imported"), ("skipped", "skipped"), ("error", "errors"))])


# -- a mailbox feed ---------------------------------------------------------------------------------------------------


def since_text(window: str, as_of: Column) -> Column:
    """The date from which a window fetches, as the protocol writes it."""
    return F.date_format(F.date_sub(as_of.cast("date"), WINDOW_DAYS[window]), "dd-MMM-yyyy")


def uids_to_fetch(feed: DataFrame, watermarks: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows of the feed (account_id, mailbox, uid, internal_date) above the stored watermark, and not before `since`."""
    rows = feed.join(watermarks.select("account_id", "mailbox", "last_seen_uid"), ["account_id", "mailbox"], "left").filter(F.col("uid") > F.coalesce("last_seen_uid", F.lit(0))).drop("last_seen_uid")
    return rows if since is None else rows.filter(F.col("internal_date") >= since)


def mailboxes(feed: DataFrame) -> DataFrame:
    """Each mailbox of a feed with the uid that comes next and its number of messages; with a column uid_validity also that, the latest one. Rows without a mailbox or uid, as of one that couldn't be opened, are left out."""
    validity = [F.max("uid_validity").alias("uid_validity")] if "uid_validity" in feed.columns else []
    return feed.filter("mailbox is not null and uid is not null").groupBy("account_id", "mailbox").agg((F.max("uid") + 1).alias("uid_next"), F.count(F.lit(1)).alias("messages"), *validity)


def fetch_batched(fetch: Callable[[list[int]], list], uids: Iterable[int], on_batch: Callable[[list], None], *, size: int = BATCH, sleep: Callable[[float], None] = time.sleep, pause_s: float = PAUSE_MS / 1000) -> int:
    """Fetches uids (ascending) by batches, each handed on before the next is fetched; pauses between them. A throttled batch is tried once more after a longer wait, then RateLimited is raised. The number of messages."""
    line, n = sorted(uids), 0
    for k in range(0, len(line), size):
        if k:
            sleep(pause_s)
        for attempt in (1, 2):
            try:
                got = fetch(line[k : k + size])
                break
            except Exception as e:
                if not throttled(str(e)):
                    raise
                if attempt == 2:
                    raise RateLimited(str(e)) from e
                sleep(BACK_OFF_S)
        on_batch(got)
        n += len(got)
    return n


def throttled(error: str) -> bool:
    e = error.lower()
    return any(x in e for x in ("rate", "throttl", "unavailable"))
