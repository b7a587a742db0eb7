"""Helpers shared by the corpus operators: the shared folder, row keys and batch hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Stands for a null id inside the operators; it sorts before every real id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without it (tests) gets one of its own, gone at its end."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="clauseloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
        _gone_at_exit(sc, sc._jsc.sc().getCheckpointDir().get())
    return path


def _gone_at_exit(sc, path: str) -> None:
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)


def stage_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files between two steps; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _gone_at_exit(spark.sparkContext, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder. The files go with the driver, and before that with the last plan that
    holds them where spark.cleaner.referenceTracking.cleanCheckpoints is set, as the engine's own sessions do."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes that go to a Python worker at a time, where the session has no setting of its own.
_BATCH_BYTES = 8 << 20


def lean(run):
    """A function over batches that gives its memory back to the system at its end, as workers stay for later stages; batches are small."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def row_id(col: str = "doc_id"):
    """A non-null long for joins and order; rows with a null id share NULL_ID."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def public_id(col: str):
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, (cols[f.name] for f in schema), strict=True)], schema=schema)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and n + 1 offsets into them; null counts as empty."""
    col = col.fill_null("").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(col) else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(texts: pa.Array, limit: int = 1 << 18):
    """(start, length) of runs of rows with about limit bytes of text or a single longer row, at most 1000 rows."""
    ends = text_bytes(texts)[1]
    at, n = 0, len(ends) - 1
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + 1000, n)
        yield at, to - at
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wraps on overflow)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: One random word for each byte value; the seed is fixed so that all tasks agree.
BYTE_WORD = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_WORD_LOWER = BYTE_WORD.copy()
BYTE_WORD_LOWER[65:91] = BYTE_WORD[97:123]
_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    got = _POWERS.get(inverse)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, U64)
        got[0] = 1
        got = _POWERS[inverse] = np.multiply.accumulate(got)
        if len(got) > 1 << 24:
            _POWERS.pop(inverse)
    return got[:n]


def prefix_sums(data: np.ndarray, words: np.ndarray = BYTE_WORD) -> np.ndarray:
    """s with s[j] - s[i] the hash of data[i:j] up to the factor that range_hash undoes."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(words[data] * powers(len(data), inverse=True), out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; equal bytes have equal hashes wherever they stand."""
    return mix((s[end] - s[start]) * powers(len(s))[start] + (end - start).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs without [\\x20\\x09-\\x0D]) of the rows."""
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < len(data))]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word shingles of each row, A-Z lower-cased: the hashes, ordered by (row, hash), and n + 1 offsets.

    Rows with fewer words than width give one shingle of all their words, rows without words none.
    """
    data, off = text_bytes(texts)
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    start, end, row = word_spans(data, off)
    h = range_hash(prefix_sums(data, BYTE_WORD_LOWER), start, end)
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    # Every word starts a shingle unless fewer than width words are left in its row; a short row has one.
    left = first[row + 1] - np.arange(len(row))
    at = np.flatnonzero((left >= width) | ((count[row] < width) & (left == count[row])))
    size = np.minimum(width, left[at])
    sh = np.full(len(at), 0x5851F42D4C957F2D, U64)
    for k in range(width):
        more = size > k
        sh[more] = mix(sh[more] * U64(0xD6E8FEB86659FD93) + h[at[more] + k])
    row = row[at]
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[keep], row[keep]
    return sh, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))


def worker_cache() -> dict:
    """A dict that outlives the task in a Python worker (functions sent by value lose their globals)."""
    import sys
    import types

    module = sys.modules.setdefault("_clauseloom_worker_cache", types.ModuleType("_clauseloom_worker_cache"))
    return module.__dict__
