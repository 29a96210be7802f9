"""WARC archives: writing, a normaliser for monolithic gzip files, and reading by a sidecar offset index.

Crawlers that compress a whole archive as one gzip stream leave files that can't be read from the middle. The normaliser
inflates such a stream once, front to back, rewrites every record as a gzip member of its own, and writes a sidecar
index beside it: one line for each record with offset, compressed length, type and record id. With it, any record is read
by one seek. Archives are cut at ARCHIVE bytes of records, whatever a task holds; one task normalises one file, in chunks of CHUNK bytes, whatever the records' lengths.
A file that is already cut into members is normalised alike. A stream that ends within a record raises ValueError.

Equal payloads of at least LEAST bytes are stored once: the record with the largest page_id is the response and the
others are revisits that refer to it. Shorter ones are all responses.

Tasks write to names that hold the attempt's number, and only names that a finished attempt returned are read on, so a
retried or lost task leaves an unread file at worst. Archives lie in the shared folder, through any file system pyarrow
knows.

Null html counts as an empty payload, a null url gives a record without target. A null page_id is never referred to,
unless all of a payload's ids are null, when all its records are responses. Repeated rows with the largest page_id are
all responses. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail.llm.common import forget, partitions, scratch, ship, slices, stored, table

LEAST = 1000
#: Bytes of records after which an archive is closed and another one begun.
ARCHIVE = 256 << 20
CHUNK = 1 << 20
_END = b"\r\n\r\n"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else "0"


def record_head(page_id: int | None, url: str | None, kind: str, length: int, digest: str, refers_to: int | None) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {target}"] if target else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"Content-Length: {0 if kind == 'revisit' else length}"]
    return "\r\n".join(lines).encode() + _END


def _write_monolithic(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(folder)
        fs.create_dir(top, recursive=True)
        number, out, squeeze, n, held = 0, None, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is not None and held >= most:
                    yield closed()
                    out, number = None, number + 1
                if out is None:
                    name, n, held = f"whole-{_attempt()}-{number}.warc.gz", 0, 0
                    out, squeeze = fs.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = (row["html"] or "").encode()
                kind = "response" if row["refers_to"] is None else "revisit"
                head = record_head(row["page_id"], row["url"], kind, row["payload_bytes"], row["digest"], row["refers_to"])
                body = (payload if kind == "response" else b"") + _END
                out.write(squeeze.compress(head))
                out.write(squeeze.compress(body))
                n, held = n + 1, held + len(head) + len(body)
        if out is not None:
            yield closed()

    return write


class _Member:
    """Writes one record at a time as a gzip member, counting bytes."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def begin(self) -> None:
        self.first, self.squeeze = self.at, zlib.compressobj(6, zlib.DEFLATED, 31)

    def add(self, data: bytes) -> None:
        self._put(self.squeeze.compress(data))

    def finish(self) -> tuple[int, int]:
        self._put(self.squeeze.flush())
        return self.first, self.at - self.first

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)


def header_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _head(stream) -> bytes:
    """The next record's header with its blank line; empty at the end of the stream."""
    head = b""
    while True:
        line = stream.readline()
        if not line:
            if head.strip():
                raise ValueError("the stream ends within a header")
            return b""
        if not head and line in (b"\r\n", b"\n"):
            continue
        head += line
        if line in (b"\r\n", b"\n"):
            return head


def normalise_file(source: str, folder: str, name: str) -> tuple[str, str, int]:
    """Rewrites one archive: path of the new archive, path of its index, number of records."""
    fs, path = _fs(source)
    to, target = _fs(f"{folder}/{name}.warc.gz")
    to.create_dir(target.rpartition("/")[0], recursive=True)
    index = f"{target.removesuffix('.warc.gz')}.idx"
    n = 0
    with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as raw, gzip.GzipFile(fileobj=raw) as stream, to.open_output_stream(target, compression=None) as out, to.open_output_stream(index, compression=None) as side:
        member = _Member(out)
        try:
            while head := _head(stream):
                fields = header_of(head)
                left = int(fields["content-length"])
                member.begin()
                member.add(head)
                while left:
                    data = stream.read(min(left, CHUNK))
                    if not data:
                        raise ValueError(f"{source} ends within a record")
                    member.add(data)
                    left -= len(data)
                if stream.read(4) != _END:
                    raise ValueError(f"{source} ends within a record")
                member.add(_END)
                offset, length = member.finish()
                side.write(f"{offset} {length} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                n += 1
        except (EOFError, zlib.error, KeyError) as e:
            raise ValueError(f"{source} is no whole archive") from e
    return f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", n


def _normalise(folder: str):
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, source in enumerate(batch.column(0).to_pylist()):
                name = f"{source.rpartition('/')[2].removesuffix('.warc.gz')}-n{_attempt()}-{i}"
                archive, index, n = normalise_file(source, folder, name)
                yield pa.RecordBatch.from_pydict({"archive": [archive], "index": [index], "records": pa.array([n], pa.int64())})

    return normalise


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record by its entry in the index: the fields of the header, and the digest of the payload as read."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None  # noqa: E731  of <urn:page:N>
    for batch in batches:
        for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (fs, path), (_, side) = _fs(archive), _fs(index)
            rows: list[tuple] = []
            with fs.open_input_file(path) as file, fs.open_input_stream(side, compression=None) as entries:
                rest = b""
                while True:
                    data = entries.read(CHUNK)
                    lines = (rest + data).split(b"\n")
                    rest = lines.pop()
                    for line in lines:
                        offset, length = map(int, line.split(b" ", 2)[:2])
                        file.seek(offset)
                        record = gzip.decompress(file.read(length))
                        at = record.index(_END) + 4
                        fields = header_of(record[:at])
                        kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = memoryview(record)[at:-4]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if digest != stated:
                                raise ValueError(f"{archive} at {offset}: payload and digest differ")
                        else:
                            size, digest = int(fields["x-payload-length"]), stated
                        rows.append((number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to"))))
                    if len(rows) >= 4096 or not data:
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))
                        rows = []
                    if not data:
                        break


def decided(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, digest, refers_to (null for responses)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    long_ones = df.filter(F.col("payload_bytes") >= least).select("page_id", "digest")
    keepers = long_ones.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    row = F.xxhash64("page_id", "digest").alias("row")  # never null, unlike an id
    revisits = long_ones.join(keepers, "digest").filter(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).distinct().select(row, "digest", "keeper")
    # Payloads are dealt once: the join and the archives keep this partitioning.
    df = df.select("*", row).repartition(partitions(pages.sparkSession), "row", "digest").join(revisits, ["row", "digest"], "left")
    return df.select("page_id", "url", F.when(F.col("keeper").isNull(), F.col("html")).alias("html"), "payload_bytes", "digest", F.col("keeper").alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, *, most: int = ARCHIVE) -> DataFrame:
    """Writes archives of one gzip stream each, cut at `most` bytes of records: path and number of records of each."""
    spark = records.sparkSession
    ship(spark)
    return stored(records.mapInArrow(_write_monolithic(folder, most), "path string, records long"), "warc-whole")[0]


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """paths: a column path of archives. Rewrites each in folder: archive, index, records."""
    spark = paths.sparkSession
    ship(spark)
    dealt = paths.select("path").repartition(partitions(spark), "path")
    return stored(dealt.mapInArrow(_normalise(folder), "archive string, index string, records long"), "warc-members")[0]


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. What a revisit says of its payload is held against the response that it refers to; a revisit without one raises ValueError."""
    spark = archives.sparkSession
    ship(spark)
    dealt = archives.select("archive", "index").repartition(partitions(spark), "archive")
    rows, _ = stored(dealt.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    # By payload and the response's id: sums are combined before they are shuffled, however often a page is referred to.
    of = rows.groupBy("payload_digest", "payload_bytes", F.coalesce("refers_to", "page_id").alias("id")).agg(F.count_if(F.col("record_type") == "response").alias("responses"), F.count_if(F.col("record_type") == "revisit").alias("revisits"))
    if not of.filter("revisits > 0 and responses = 0").isEmpty():
        raise ValueError("a revisit refers to no response of its payload")
    return rows


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    whole = write_monolithic(decided(table(spark, sf_dir, "pages")), f"{folder}/whole")
    forget(spark)
    members = normalise(whole, f"{folder}/members")
    forget(spark, f"{folder}/whole")  # the normalised archives stand in for them
    return read(members)


SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     k as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as keeper from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST} and keeper <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST} and keeper <> page_id then keeper end as refers_to
from k
"""
