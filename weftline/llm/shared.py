"""Shared storage, batching of Arrow text columns, and small numeric helpers of the training-data operators."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Text that is handled at once inside a task, in bytes of UTF-8. A longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 15
#: Rows of an Arrow batch between Spark and Python, where the session keeps Spark's default of 10,000: those are too many whole texts.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch to BATCH_ROWS for the session, unless it has a value of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder of this machine (all tasks run on it) and a cluster a
    folder in the warehouse, which its executors share.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_weftline_scratch", None)
        if base is None:
            alone = spark.sparkContext.master.split("[")[0] == "local"
            base = tempfile.mkdtemp(prefix="weftline-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/weftline-scratch"
            spark.sparkContext._weftline_scratch = base
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_WRITTEN: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:  # gone already, or the session has ended
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        _remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, survives lost executors and has known sizes.

    It stays until dropped() or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made and nothing reads any more."""
    for table in tables:
        _remove(table._weftline_path)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Row ranges of a batch with about `most` bytes of text and `rows` rows at most each, as (batch, Texts)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, done + most, "right"))), start + rows)
        part = batch.slice(start, stop - start)
        yield part, Texts(part.column(column))
        start = stop


class Texts:
    """The UTF-8 bytes of some texts side by side; nulls count as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.n = len(column)
        self._loads: dict[bool, np.ndarray] = {}

    @classmethod
    def of(cls, raw: bytes) -> Texts:
        """One text from its bytes."""
        out = cls.__new__(cls)
        out.bytes, out.bounds, out.n, out._loads = np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 1, {}
        return out

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte by text."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the first word of each text and after the last."""
        ink = np.concatenate([[False], IS_INK[self.bytes], [False]])
        edge = ink[1:] != ink[:-1]
        # a text's first byte starts a word and its last one ends it, whatever stands beside it
        inner = self.bounds[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(self.bytes))])
        both = inner[ink[inner] & ink[inner + 1]] if len(inner) else inner
        starts = np.flatnonzero(edge & ink[1:])
        ends = np.flatnonzero(edge & ink[:-1])
        if len(both):
            starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
        return starts, ends, np.searchsorted(starts, self.bounds)

    def loads(self, lower: bool = False) -> np.ndarray:
        """The eight bytes from each byte on as one number; beyond the end they are zero. lower: A-Z as a-z."""
        if lower not in self._loads:
            padded = np.zeros(len(self.bytes) + 8, np.uint8)
            padded[: len(self.bytes)] = LOWER[self.bytes] if lower else self.bytes
            self._loads[lower] = np.ndarray(len(self.bytes) + 1, "<u8", buffer=padded.data, strides=(1,))
        return self._loads[lower]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; spans of equal length up to 8 bytes never share one.

        Eight bytes after another are stirred in, all spans at a time; those of LONG bytes and more go through BLAKE2.
        Lanes are hashes apart from one another: two make 128 bits.
        """
        loads, size = self.loads(lower), ends - starts
        out = mixed(size.astype(np.uint64) * _ODD + _LANES[lane])
        out = mixed(out ^ (loads[starts] & _MASKS[np.minimum(size, 8)]))
        alive, done = np.flatnonzero(size > 8), 8
        while len(alive) and done < LONG:
            left = size[alive] - done
            out[alive] = mixed((out[alive] ^ (loads[starts[alive] + done] & _MASKS[np.minimum(left, 8)])) + _LANES[lane])
            done += 8
            alive = alive[left > 8]
        if len(alive):
            raw = (LOWER[self.bytes] if lower else self.bytes).data
            for i in alive.tolist():
                out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, person=b"lane%d" % lane).digest(), "little")
        return out


def same_spans(a: Texts, a_starts: np.ndarray, b: Texts, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of two spans of equal size are the same, pair by pair."""
    left, right = a.loads(), b.loads()
    out = ((left[a_starts] ^ right[b_starts]) & _MASKS[np.minimum(size, 8)]) == 0
    alive, done = np.flatnonzero(out & (size > 8)), 8
    while len(alive) and done < LONG:
        rest = size[alive] - done
        equal = ((left[a_starts[alive] + done] ^ right[b_starts[alive] + done]) & _MASKS[np.minimum(rest, 8)]) == 0
        out[alive] = equal
        done += 8
        alive = alive[equal & (rest > 8)]
    for i in alive.tolist():
        out[i] = np.array_equal(a.bytes[a_starts[i] : a_starts[i] + size[i]], b.bytes[b_starts[i] : b_starts[i] + size[i]])
    return out


IS_INK = np.ones(256, bool)
IS_INK[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes from which on a span is hashed by BLAKE2.
LONG = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the SplitMix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbours in order (len - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= _ODD
        out += hashes[j : j + len(out)]
    return mixed(out)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
