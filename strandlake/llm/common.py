"""Helpers shared by the corpus operators: durable cuts of the lineage and byte kernels in numpy.

The kernels work on Arrow string buffers: the texts of a slice lie back to back in one
``uint8`` array, so hashing, word splitting and window minima are a few passes of numpy over
the slice and never a Python loop over characters or words.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one pass of a kernel takes; a single longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Base of the polynomial that picks anchors of windows and n-grams of a few letters (``gram_hashes``).
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def ready(spark: SparkSession) -> None:
    """Make sure that checkpoints go to the shared folder which the session names.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is set only
    where none is configured and driver and executors are one process, as in local tests.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandlake-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as set for checkpoints."""
    ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Whether Spark removes a query's shuffle files when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    What was shuffled for it is never read again and leaves the disks at once.
    """
    ready(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")  # holds for queries made from here on
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


#: A narrow table that is counted and found shorter than this is broadcast (some 16 bytes a row); a longer one is shuffled.
BROADCAST_ROWS = 1 << 17


def few(rows: DataFrame) -> DataFrame:
    """Rows of one or two numbers, written, and marked for a broadcast if there are few of them."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


#: Bytes of an Arrow batch, where the session leaves Spark's own bound.
BATCH_BYTES = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts shall go to Python in batches of BATCH_BYTES.

    An executor holds a batch for each of its cores twice, on both sides of the pipe.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, BATCH_BYTES)
    return df


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(run: Run) -> Run:
    """``run``, after which the Python worker gives what it no longer holds back to the system.

    Workers serve one task after the other; else each keeps the most that any of its tasks took.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows or more that end where ``keys`` change.

    Batches come sorted by the keys; what is held is ``rows`` rows, a batch and one key's rows.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(n, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        ends = np.flatnonzero(change)
        if len(ends):
            yield table.slice(0, int(ends[-1]))
            held = table.slice(int(ends[-1])).to_batches()
            n -= int(ends[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, row after the last, bytes of the run, offsets into them). Null texts
    count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _sum_mixed(pieces: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    """Sum over each row's pieces of the piece mixed with a key of its number; ``pieces`` gets places and rows."""
    keys = mix(np.arange(1, int(count.max(initial=0)) + 2, dtype=U64) * U64(0xD6E8FEB86659FD93))
    some = np.flatnonzero(count > 0)
    out = np.zeros(len(start), U64)
    out[some] = mix(pieces(start[some], some) ^ keys[0])
    more = np.flatnonzero(count > 1)
    some_rows = max(1, (1 << 15) * len(more) // max(int(count[more].sum()), 1))  # about 32,768 pieces at a time
    for lo in range(0, len(more), some_rows):
        rows = more[lo : lo + some_rows]
        n = count[rows] - 1
        i = ranges(np.ones(len(rows), np.int64), n)
        total = np.append(U64(0), np.cumsum(mix(pieces(np.repeat(start[rows], n) + step * i, np.repeat(rows, n)) ^ keys[i])))
        end = np.cumsum(n)
        out[rows] += total[end] - total[end - n]
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they lie.

    Eight bytes at a time are mixed with their place before they are added up, so there is no
    arithmetic relation between bytes that makes different spans meet, as there is between the terms of a
    polynomial. Spans of one length up to eight bytes never meet.
    """
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 8,), (1,), writeable=False)
    stop = start + size

    def pieces(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        left = np.minimum(stop[rows] - at, 8)
        return eight[at] & (U64(MASK) >> (U64(64) - (left * 8).astype(U64)))

    return mix(_sum_mixed(pieces, start, (size + 7) >> 3, 8) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def run_hashes(units: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same for runs of 64-bit units: a hash of each units[start:start+length]."""
    return mix(_sum_mixed(lambda at, rows: units[at], np.asarray(start, np.int64), np.asarray(length, np.int64), 1) + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` units, by doubling; position i holds the run that begins at i."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    level, width, power = units.astype(U64), 1, BASE
    out, done = None, 0
    rest = k
    while rest:
        if rest & 1:
            shift = pow(BASE, width, 1 << 64)
            part = level[done : done + n]
            out = part.copy() if out is None else out * U64(shift) + part
            done += width
        rest >>= 1
        if rest:
            level = level[: len(level) - width] * U64(power) + level[width:]
            width *= 2
            power = power * power & MASK
    return mix(out)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` keys."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    cur, width = keys, 1
    while width * 2 <= w:
        cur = np.minimum(cur[: len(cur) - width], cur[width:])
        width *= 2
    if width < w:
        cur = np.minimum(cur[: n], cur[w - width : w - width + n])
    return cur[:n]


_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def runs_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes in the texts between ``offs``; they never run across texts.

    Returns start and end of each run and the first run of each text (with one entry more at the end).
    """
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offs, side="left")


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs outside space and \\t..\\r) of the texts between ``offs``, as ``runs_of`` gives them."""
    return runs_of(~_space[data], offs)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, back to back."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Mask of the units that the ranges cover, and the number of maximal covered runs."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    mask = np.cumsum(step[:n]) > 0
    runs = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
    return mask, runs
