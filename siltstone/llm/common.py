"""What the text operators share: Arrow texts as one byte array, vectorised words and hashes, checkpoints.

Texts stay UTF-8 bytes. An Arrow string array already holds all texts of a batch in one buffer with offsets, so words,
n-grams and hashes are computed over that buffer at once rather than text by text.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that are worked on at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
_rng = np.random.default_rng(20240607)
BYTE64 = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
ODD = _rng.integers(1, 1 << 62, 4096, dtype=np.int64).astype(U) * U(2) + U(1)
ADD = _rng.integers(1, 1 << 62, 4096, dtype=np.int64).astype(U)
BASE = 0x9E3779B97F4A7C13
BASE_INV = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of a word beyond which it is hashed on its own.
LONG = 512
#: Masks for the first 0 .. 8 bytes of a little-endian number.
REST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, BASE_INV)):
                p = np.full(m, U(b))
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n+1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``size`` bytes together; one text is never cut."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts i..j of (buf, offsets), A-Z in lower case, with a hash of each.

    start, end: byte positions in ``bytes``; doc: index of the text; first: n+1 offsets into the words by text.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, i: int, j: int):
        lo, hi = offsets[i], offsets[j]
        self.bytes = LOWER[buf[lo:hi]]
        at = offsets[i : j + 1] - lo
        n = len(self.bytes)
        inside = ~SPACE[self.bytes]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = at[:-1][at[:-1] < n]  # a text's first byte begins a word even where the text before ends in one
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = at[1:][at[1:] > 0] - 1
        ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(j - i), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """Each word's bytes are taken up eight at a time by multiplications and shifts that depend on all bytes before,
        so that no arithmetic relation of bytes makes two words collide. Very long words are hashed by BLAKE2b."""
        out = np.zeros(len(self.start), U)
        size = self.end - self.start
        eight = np.ndarray(len(self.bytes), "<u8", np.concatenate([self.bytes, np.zeros(8, np.uint8)]), strides=(1,))
        at = np.flatnonzero(size <= LONG)
        with np.errstate(over="ignore"):
            for k in range(0, int(size[at].max()) if len(at) else 0, 8):
                at = at[size[at] > k]
                part = eight[self.start[at] + k].astype(U) & REST[np.minimum(size[at] - k, 8)]
                out[at] = mix((out[at] + ADD[k + 1]) * ODD[k + 1] ^ part * ODD[k + 2]) + part
            out = mix(out + size.astype(U) * ODD[0])
        for k in np.flatnonzero(size > LONG):
            out[k] = int.from_bytes(hashlib.blake2b(self.bytes[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest(), "little")
        return out


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles in order of the texts, and n+1 offsets by text. Fewer words: the whole sequence as one."""
    h = words.hashes()
    count = np.diff(words.first)
    per = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(int(first[-1]), U)
    with np.errstate(over="ignore"):
        if len(h) >= size:
            roll = np.zeros(len(h) - size + 1, U)
            for k in range(size):
                roll += h[k : k + len(roll)] * ODD[k]
            whole = words.doc[: len(roll)] == words.doc[size - 1 :]
            long = np.repeat(count >= size, per)
            out[long] = mix(roll[whole])
        for d in np.flatnonzero((count > 0) & (count < size)):
            own = h[words.first[d] : words.first[d + 1]]
            out[first[d]] = mix((own * ODD[: len(own)]).sum(dtype=U, keepdims=True) + U(len(own)) * ADD[0])[0]
    return out, first


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times as fast here as numpy's hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``ordered``."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is not installed for them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where it is unset and all runs on this machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Of the steps settled within ``dropping``, where their rows are.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _place(settled: DataFrame) -> str | None:
    file = settled._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def forget(settled: DataFrame) -> None:
    """Deletes what ``settle`` wrote for this result, which nothing reads any more."""
    if path := _place(settled):
        delete(settled.sparkSession, path)


def trim(spark: SparkSession) -> bool:
    """Asks the driver's JVM to give back to the system what its own code has freed outside the heap. The C library keeps
    that for each of the many threads that shuffles and broadcasts start. False where a JVM knows no such command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    kinds, values = array(lang.Class, 4), array(lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = lang.Class.forName(name)
    for k, value in enumerate((jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(lang.Object, 0), array(lang.String, 0))):
        values[k] = value
    invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is in no open package
    try:
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect its garbage, and to give back what it has freed outside the heap. Plans of many small
    steps are garbage at once, but the JVM lets its heap grow to its limit before it looks; a driver with little memory
    beside the heap is then too small. Done behind each settled step: a few tenths of a second, once for work of many tasks."""
    spark.sparkContext._jvm.System.gc()
    trim(spark)


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """What is settled inside is deleted at the end; for callers that by then have written their result."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            delete(spark, path)
        _written.reset(token)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there: a lost executor costs no recomputation.

    The shuffle files of the step are removed as soon as its rows are written, by Spark's own setting for that; disk, not
    memory, is what runs short. Another query planned at the same moment would only lose its files at its own end."""
    spark = df.sparkSession
    shared_folder(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        out = df.select("*").checkpoint(eager=True)
    tidy(spark)
    written = _written.get()
    if written is not None and (path := _place(out)):
        written.append(path)
    return out


def fixed_plan(spark: SparkSession):
    """Without adaptive planning, a checkpoint remembers how its rows are partitioned. Another query planned at the same
    moment loses adaptive planning, not rows."""
    return setting(spark, "spark.sql.adaptive.enabled", "false")


#: Bytes of a table's files for each partition, at most about.
PARTITION = 256 << 20


def partitions(df: DataFrame) -> int:
    """As many as the session's setting, or more where the tables behind ``df`` are larger than that many partitions hold."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # the plan of rows without files has no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PARTITION))


def fold(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id is of no fold, -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(k), F.lit(-1)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
