"""Pieces that several operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every word-based contract: space and bytes 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"
#: Words as the contracts define them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in `spark.checkpoint.dir`; only where that is unset and all runs on one machine (tests),
    a temporary folder takes its place. On a cluster without it, this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = tempfile.mkdtemp(prefix="barweave-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage.

    The files are replicated by the shared store, so a lost executor costs no recomputation.
    They are removed by `discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    atexit.register(_remove, spark, path)
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables made by `stored` that nothing will read any more."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def fold(id_col, modulus: int):
    """crc32 of the id written as decimal text, modulo `modulus`."""
    return F.crc32(id_col.cast("string")) % modulus


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def row_chunks(offsets: np.ndarray, most: int):
    """Row ranges [a, b) whose bytes stay within `most` (a longer row stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the finaliser of SplitMix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[list(SPACES)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = base
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            step = step * step
            done += take
    return out[:n]


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row) of every word of the concatenated texts, words never crossing rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE_TABLE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    Byte pairs and their place are scrambled before they are summed, so that the sum is not a
    polynomial that short words could collide in.
    """
    out = np.empty(len(starts), np.uint64)
    length = ends - starts
    total = np.cumsum(length)
    a = 0
    while a < len(starts):  # some 256 KiB at a time, since a byte takes many times its size on the way
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 18), "right")))
        size = length[a:b]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        byte = data[np.repeat(starts[a:b], size) + place].astype(np.uint64)
        with np.errstate(over="ignore"):
            x = mix64((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(seed) * _ODD)
            out[a:b] = mix64(np.add.reduceat(x, first) + size.astype(np.uint64) * _ODD)
        a = b
    return out


try:
    _TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
except (OSError, TypeError):
    _TRIM = None


def give_back() -> None:
    """Return to the system the memory that this process holds free.

    Python workers stay for later tasks, several an executor, and each would keep the most that a task took.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run):
    """`run` for mapInArrow, with `give_back` behind a task's last batch."""

    def until_done(batches):
        yield from run(batches)
        give_back()

    return until_done


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark schema string (made on the driver, shipped to the workers)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def zipped(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of `schema` from columns given by name."""
    arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
