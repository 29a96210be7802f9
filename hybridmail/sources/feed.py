"""Mailboxes as a streaming source: spark.readStream.format("mailbox_feed").

The offset is the last UID of each mailbox. A micro-batch covers the UIDs between two offsets: a partition for each run of
RUN messages that are there in one mailbox (numbers that nobody has cost nothing), which opens a session of its own, fetches by small batches with pauses, tries a throttled one
once more (mail.fetch_batched), and hands messages on in Arrow batches as they come. Nothing but offsets passes the driver.
A query that is started again goes on from the offsets of its checkpoint; UIDs that vanished in between are no error.

Options: client (module:name of a class), account, and what its constructor takes, as strings. A client has uids(mailbox,
above, until) (ascending, `until` included; None: no end), fetch(mailbox, uids) (rows of subject, message_id, body,
internal_date by uid), mailboxes() and close(). It is made on the driver for offsets and in each task for messages, so
secrets travel as names, of an environment variable or a file that each machine has (password_env, password_file), not as values.
A client may have `batch`, how many messages it is asked for at once (else mail.BATCH).
"""

from __future__ import annotations

import datetime
import email
import email.policy
import imaplib
import importlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from hybridmail.sources import mail

SCHEMA = "account_id string, mailbox string, uid bigint, message_id string, subject string, body string, internal_date timestamp"
#: Messages of one partition at most, and of one read of a folder: each read looks through the folder.
RUN, FOLDER_BATCH = 2000, 500
_ARROW = pa.schema([("account_id", pa.string()), ("mailbox", pa.string()), ("uid", pa.int64()), ("message_id", pa.string()), ("subject", pa.string()), ("body", pa.string()), ("internal_date", pa.timestamp("us", "UTC"))])


class ImapClient:
    """A mailbox server over IMAP. Folders are opened read-only, messages fetched without being marked as read."""

    def __init__(self, host: str, user: str, password_env: str = "", password_file: str = "", port: str = "993", tls: str = "true", folders: str = "", pause_ms: str = str(mail.PAUSE_MS)):
        kind = imaplib.IMAP4_SSL if tls == "true" else imaplib.IMAP4
        self._folders, self.pause_s = [f for f in folders.split(",") if f], int(pause_ms) / 1000
        self._box = kind(host, int(port), timeout=60)
        self._box.login(user, Path(password_file).read_text().strip() if password_file else os.environ.get(password_env, ""))
        self._open: str | None = None

    def _said(self, answer: tuple) -> list:
        if answer[0] != "OK":
            raise OSError(str(answer[1]))
        return answer[1]

    def _select(self, mailbox: str) -> None:
        if self._open != mailbox:
            self._said(self._box.select('"' + mailbox.replace("\\", "\\\\").replace('"', '\\"') + '"', readonly=True))
            self._open = mailbox

    def mailboxes(self) -> list[str]:
        if self._folders:
            return self._folders
        lines = [x.decode() for x in self._said(self._box.list()) if isinstance(x, bytes)]
        return [m[2].strip('"') for x in lines if (m := re.match(r'\(([^)]*)\) (?:"[^"]*"|NIL) (.+)$', x)) and "\\noselect" not in m[1].lower()]

    def uids(self, mailbox: str, above: int, until: int | None = None) -> list[int]:
        self._select(mailbox)
        found = self._said(self._box.uid("SEARCH", f"UID {above + 1}:{until or '*'}"))
        # A server gives its last message for a range that begins behind it.
        return sorted(u for x in found if x for u in map(int, x.split()) if u > above)

    def fetch(self, mailbox: str, uids: list[int]) -> list[dict]:
        self._select(mailbox)
        out = []
        for part in self._said(self._box.uid("FETCH", ",".join(map(str, uids)), "(UID INTERNALDATE BODY.PEEK[])")):
            if not isinstance(part, tuple):
                continue
            head, data = part
            at = imaplib.Internaldate2tuple(head)
            parsed = email.message_from_bytes(data, policy=email.policy.default)
            body = parsed.get_body(("plain", "html"))
            identity = (parsed["Message-ID"] or "").strip().strip("<>") or None
            when = datetime.datetime(*at[:6]).astimezone(datetime.UTC) if at else None
            out.append({"uid": int(re.search(rb"UID (\d+)", head)[1]), "message_id": identity, "subject": parsed["Subject"], "body": body.get_content() if body else None, "internal_date": when})
        return out

    def close(self) -> None:
        try:
            self._box.logout()
        except (OSError, imaplib.IMAP4.error):
            pass


class FolderClient:
    """A mailbox that lies in Parquet files of SCHEMA below a path that every machine sees; each file system that pyarrow knows by its URI."""

    batch = FOLDER_BATCH

    def __init__(self, path: str, account: str = "", pause_ms: str = "0"):
        import pyarrow.dataset as ds
        from pyarrow import fs

        self.pause_s = int(pause_ms) / 1000
        system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        there = system.get_file_info(folder).type != fs.FileType.NotFound
        self._rows = ds.dataset(folder, filesystem=system, schema=_ARROW, format="parquet") if there else None
        self._account = account

    def _some(self, columns: list[str], condition) -> pa.Table:
        import pyarrow.compute as pc

        own = pc.field("account_id") == self._account
        return self._rows.to_table(columns=columns, filter=own if condition is None else own & condition) if self._rows is not None else _ARROW.empty_table().select(columns)

    def mailboxes(self) -> list[str]:
        return sorted(set(self._some(["mailbox"], None).column(0).unique().to_pylist()) - {None})

    def uids(self, mailbox: str, above: int, until: int | None = None) -> list[int]:
        import pyarrow.compute as pc

        asked = (pc.field("mailbox") == mailbox) & (pc.field("uid") > above)
        return sorted(self._some(["uid"], asked if until is None else asked & (pc.field("uid") <= until)).column(0).unique().to_pylist())

    def fetch(self, mailbox: str, uids: list[int]) -> list[dict]:
        import pyarrow.compute as pc

        near = (pc.field("uid") >= min(uids)) & (pc.field("uid") <= max(uids))  # by which row groups are skipped
        return self._some(["uid", "message_id", "subject", "body", "internal_date"], (pc.field("mailbox") == mailbox) & near & pc.field("uid").isin(uids)).sort_by("uid").to_pylist()

    def close(self) -> None:
        pass


@dataclass
class Run(InputPartition):
    mailbox: str
    above: int
    until: int


def client_of(options: dict):
    own = {k: v for k, v in options.items() if k not in ("client", "account", "above")}
    module, _, name = options["client"].partition(":")
    kind = getattr(importlib.import_module(module), name)
    return kind(**own, **({"account": options.get("account", "")} if kind is FolderClient else {}))


def runs(start: dict, end: dict, size: int = RUN) -> list[Run]:
    """The UIDs between two offsets, cut into runs."""
    out = []
    for box, until in sorted(end.items()):
        above = start.get(box, 0)
        while above < until:
            out.append(Run(box, above, min(until, above + size)))
            above += size
    return out


def runs_of(box: str, uids: list[int], above: int, until: int, size: int = RUN) -> list[Run]:
    """What lies above one number and up to another, cut so that each run has `size` of the UIDs (ascending) at most; none where there are no UIDs."""
    ends = [*uids[size - 1 : len(uids) - 1 : size], until] if uids else []
    return [Run(box, a, b) for a, b in zip([above, *ends], ends)]


class _Reader:
    def __init__(self, options: dict):
        # Spark hands options on in lower case; a constructor's names are.
        self.options = dict(options)

    def latest(self) -> dict:
        client = client_of(self.options)
        try:
            return {box: max(client.uids(box, 0), default=0) for box in client.mailboxes()}
        finally:
            client.close()

    def runs(self, start: dict, end: dict | None = None) -> list[Run]:
        """The messages between two offsets, or all above one, cut into runs."""
        client, out = client_of(self.options), []
        try:
            for box in sorted(client.mailboxes() if end is None else end):
                above, until = start.get(box, 0), None if end is None else end[box]
                if until is None or above < until:
                    uids = client.uids(box, above, until)
                    out += runs_of(box, uids, above, max(uids, default=0) if until is None else until)
            return out
        finally:
            client.close()

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands on where there are no partitions
            return
        client, held = client_of(self.options), []
        try:
            uids, size = client.uids(partition.mailbox, partition.above, partition.until), getattr(client, "batch", mail.BATCH)
            step = max(size, 10 * mail.BATCH)
            for k in range(0, len(uids), step):
                if k:
                    mail.time.sleep(client.pause_s)
                mail.fetch_batched(lambda some: client.fetch(partition.mailbox, some), uids[k : k + step], held.extend, size=size, pause_s=client.pause_s)
                rows = [{"account_id": self.options.get("account"), "mailbox": partition.mailbox} | r for r in held]
                held.clear()
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        finally:
            client.close()


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.latest()

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return self.runs(start, end)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Run]:
        return self.runs(json.loads(self.options.get("above", "{}")))


class MailboxFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(MailboxFeed)
