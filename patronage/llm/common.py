"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a worker lives through many tasks: give the memory of each batch back
pa.set_memory_pool(pa.system_memory_pool())

#: Stands for a null doc_id while rows are compared: it sorts after every real id.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, on storage all executors
    share; only a local-mode session (tests) without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there,
    so that later jobs neither recompute it nor depend on one executor's disk."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def id_column(name: str = "doc_id"):
    """The id as a long that is never null (NULL_ID for null)."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def text_column(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest128(column):
    """Two 64-bit hashes of a string as a struct: a key that stands for the string."""
    return F.struct(F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(1), column).alias("h2"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows and bytes of an Arrow batch of texts (Spark's own defaults: 10,000 and 64 MB).
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def short_batches(spark: SparkSession) -> None:
    """Let texts go to Python workers in short batches, unless the session itself
    says how long they are: both the worker and the JVM hold a batch at a time."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def slices(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that a task holds few texts (and what
    is made of them) as Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# --- 64-bit hashing in numpy ------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """r^0 .. r^(n-1) modulo 2^64 for an odd r, or of its inverse."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
        have = np.full(size, _R_INV if inverse else _R, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span; it depends on the bytes and the
    length alone, not on the place. One pass over the bytes for all spans."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(n), out=sums[1:])
    at = powers(n + 1, inverse=True)
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * at[starts] + mix(lengths + np.uint64(1)))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space and \\x09-\\x0D."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


_FACTORS = mix(np.arange(300, 364, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(raw: bytes, words: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of ``words`` words, in order (with repeats). A
    text with fewer words has one shingle of all its words, without words none.
    (``words``: 64 at most.)"""
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    each = span_hashes(data, starts, ends)
    k = min(words, len(each))
    total = np.full(len(each) - k + 1, np.uint64(k))
    for i in range(k):
        total += each[i : len(each) - k + 1 + i] * _FACTORS[i]
    return mix(total)
