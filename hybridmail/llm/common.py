"""What the operators of this subpackage share: reading, scratch tables and whole-text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail import shipping

__all__ = ["WORD", "column", "edges", "eights", "forget", "forget_all", "give_back", "integer_id", "lower_ascii", "partitions", "same_stretches", "scratch", "shared_folder", "ship", "slices", "small_batches", "squeeze", "stored", "stretch", "table", "texts_of"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for sessions that name none, by application.
_OWN: dict[str, str] = {}
#: Scratch paths of this process that are still there.
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own, else one in the warehouse; a temporary one on one machine only, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="hybridmail-")
            atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), ignore_errors=True)
        base = _OWN[app]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Keeps the batches that go to Python small for what runs inside; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "8m")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def stored(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Cuts lineage: writes df as Parquet into the shared folder; gives what reads it, and the path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.discard(path)
    # Spark's cleaner removes the shuffle files of plans that nobody refers to any more, once they are seen to be gone: the first
    # round frees what Python held, the second what the JVM held for it.
    for _ in range(2):
        gc.collect()
        jvm.System.gc()


def forget_all(spark: SparkSession) -> None:
    """Removes all scratch tables of this process, once the results that read them have been used."""
    forget(spark, *list(_MADE))


def ship(spark: SparkSession) -> None:
    """Makes the package importable on the executors."""
    shipping.ship(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives longer than its task, and the next one may be of another kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches by the bytes of their text column, so that memory doesn't follow the length of the texts. A text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(n) + 1
        yield batch.slice(first)
    give_back()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def column(name: str):
    """The column of exactly that name, whatever characters it holds."""
    return F.col(f"`{name}`")


def integer_id(df: DataFrame, name: str):
    """The id column as a long. Ids are integers; a TypeError says so before any work is done."""
    kind = df.schema[name].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"ids must be integers; {name} is of type {kind}")
    return column(name).cast("long")


def edges(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes of a kind begin, and their sizes. inside: for each of the 256 bytes, whether it is of the kind."""
    own = np.zeros(len(data) + 2, dtype=bool)
    own[1:-1] = inside[np.frombuffer(data, dtype=np.uint8)]
    at = np.flatnonzero(own[1:] != own[:-1])
    return at[::2], at[1::2] - at[::2]


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as bytes: a plane for each byte that is needed, the lowest first, so that what compresses them finds the empty ones together."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def stretch(data: bytes) -> np.ndarray:
    """The numbers that squeeze() wrote."""
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").reshape(-1)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as numbers. data ends with eight bytes that belong to no stretch."""
    return np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))


def same_stretches(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which stretches of bytes are equal, size bytes from at in a and from bt in b (both as eights()), eight bytes of each at a time."""
    out = np.ones(len(size), dtype=bool)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        left = size[live] - k
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1))
        differ = (a[at[live] + k] ^ b[bt[live] + k]) & mask != 0
        out[live[differ]] = False
        k += 8
        live = live[~differ & (left > 8)]
    return out


def lower_ascii(column):
    """A-Z to a-z, all else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
