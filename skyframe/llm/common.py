"""What the text operators share: spooling, word hashing, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: White space that separates words in every contract: 0x20 and 0x09-0x0D, what bytes.split() splits on.
SPACES = " \t\n\x0b\f\r"
#: A doc_id that is null sorts before all others.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own one where that is unset and Spark is one process (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyframe-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unspool(df: DataFrame, path: str | None = None) -> None:
    """Delete what spool wrote, where nothing reads it any more."""
    path = path or df.inputFiles()[0].rsplit("/", 1)[0]
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Groups to deal keys into: a multiple of the shuffle partitions, which grow with the input."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, in any case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Rows that are broadcast at most (8 to 16 bytes each, but for the windows of a benchmark); beyond that, both sides are shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bounded_sample(df: DataFrame, hashed: Column, n: int, total: int) -> DataFrame:
    """The rows of df with the smallest hashes: n of them at most, however many rows (total, as counted) there are."""
    key = fresh(df, "_h")
    few = min(1.0, 2.0 * n / max(1, total))
    rows = df.withColumn(key, hashed.bitwiseAND(F.lit(2**62 - 1))).where(F.col(key) < F.lit(int(few * 2**62)))
    return rows.orderBy(key).limit(n).drop(key)


def doc_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def tie_of(text_col: str = "text") -> Column:
    """32 bits of a hash of the text: they order rows with one id and different texts, and tell them apart.  Null is as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).bitwiseAND(F.lit(0xFFFFFFFF))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  lower() does so too where a text is pure ASCII, and is faster."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, up, up.lower()))


def release() -> None:
    """Free the token tables that a reused worker process still holds, for operators that do not need them."""
    bpe = sys.modules.get(f"{__package__}.bpe")
    if bpe is not None and bpe.codec.cache_info().currsize:
        bpe.codec.cache_clear()
        gc.collect()


def trim() -> None:
    """Give freed memory back where Arrow and the C library can: a worker process that is used again keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trim_heaps(spark: SparkSession) -> None:
    """Have each executor collect its heap, which then shrinks: what earlier stages have filled stays beside the Python workers otherwise.

    A task for each core, so that idle executors get some each; nothing depends on it where one gets none, or ignores the request.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def trim_driver(spark: SparkSession) -> str | None:
    """Have the driver collect its garbage and give freed memory back, that of its hundreds of threads for exchanges too; what its JVM says to that.

    A request as in trim_heaps: a JVM without that command keeps its memory, and None is returned.
    """
    gc.collect()
    trim()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)  # by the interface: the server's own class is closed to calls
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = of(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    return None


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, keep: bool = False) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a bounded slice at a time.  keep: the worker's token tables stay."""
    if not keep:
        release()
    trim()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
        batch = part = None
    trim()


def groups_of(rows: Iterator[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Consecutive rows in lists whose sizes sum to at most limit, or of one larger row."""
    held, total = [], 0
    for row in rows:
        n = size(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


def fold(unit: np.ndarray, length: int) -> np.ndarray:
    """Rolling polynomial hash of each run of `length` units; by doubling, mod 2**64."""
    powers, runs, size = [], [unit], 1
    while size * 2 <= length:
        h, p = runs[-1], U64(pow(_BASE, size, 2**64))
        runs.append(h[: len(h) - size] * p + h[size:] if len(h) > size else h[:0])
        size *= 2
    out, done = runs[-1], size
    for k in range(len(runs) - 2, -1, -1):
        if done + (1 << k) <= length:
            h, n = runs[k], len(unit) - done - (1 << k) + 1
            out = out[:n] * U64(pow(_BASE, 1 << k, 2**64)) + h[done : done + n] if n > 0 else out[:0]
            done += 1 << k
    del powers
    return out


def slide_min(v: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each run of `length` values; by doubling."""
    size = 1
    while size * 2 <= length:
        v = np.minimum(v[: len(v) - size], v[size:]) if len(v) > size else v[:0]
        size *= 2
    rest = length - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if 0 < rest < len(v) else v[:0] if rest else v


def prefix_ranks(values: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the sequences values[i:end[i]] by their first `length` values, by doubling.

    A sequence that ends is smaller than any that goes on.  Equal ranks: equal first values, and equal ends.
    """
    at, size = np.arange(len(values)), 1
    rank = np.unique(values, return_inverse=True)[1]
    while size < length:
        step = min(size, length - size)
        nxt = at + step
        rank = np.unique(rank * (len(values) + 1) + np.where(nxt < end, rank[np.minimum(nxt, len(values) - 1)] + 1, 0), return_inverse=True)[1]
        size += step
    return rank


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTE_HASH[data]


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)
    inverse = pow(_BASE, -1, 2**64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * U64(pow(_BASE, k, 2**64))])
            cls.down = np.concatenate([cls.down, cls.down * U64(pow(cls.inverse, k, 2**64))])
        return cls.up, cls.down


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal slices have equal hashes wherever they lie."""
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_HASH[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a byte array."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]
