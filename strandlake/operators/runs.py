"""Runs of letters of whole texts, cut and folded by numpy over Arrow's string buffers.

A run is the letters of a text from some place on, as many as asked for; runs never go across texts. Letters are code points.
A run of up to eight letters below U+00FF is a 64-bit number, others are rows of such numbers; what moves are sorted arrays of
them, a blob a bucket and task, and equal runs fold by sorting on both sides of the exchange. A row is made of a run only when it is known to be the only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import ALPHABET, END

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: 64-bit numbers that a task holds to fold equal runs.
HELD = 1 << 23
#: Rows of a batch that is given out.
ROWS = 1 << 16
BUCKETS = 1 << 12
_POINTS = 0x110000
_LONG = (1 << 63) - 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, offsets) of about SLICE_BYTES at a time. Null texts count as empty, invalid bytes as U+FFFD."""
    texts = texts.fill_null("").cast(pa.large_string())
    bufs = texts.buffers()
    at = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1))
        some, ends = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        try:
            points = np.frombuffer(some.tobytes().decode().encode("utf-32-le"), np.uint32)
            yield lo, points, np.append(0, np.cumsum((some & 0xC0) != 0x80, dtype=np.int64))[ends]
        except UnicodeDecodeError:
            each = [some[a:b].tobytes().decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield lo, np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.append(0, np.cumsum([len(t) for t in each], dtype=np.int64))
        lo = hi


def starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Where runs of ``n`` letters begin that end in the text they begin in, as a mask."""
    inside = np.ones(max(0, int(offsets[-1]) - n + 1), bool)
    late = (offsets[1:, None] - np.arange(1, n)[None, :]).ravel()
    inside[late[(late >= 0) & (late < len(inside))]] = False
    return inside


def _codes(values: np.ndarray, other: int) -> np.ndarray:
    """A table of code points: ``values`` for the alphabet's letters in any case, ``other`` for the rest (as ``sequence.encode`` with ``fold``)."""
    table = np.full(_POINTS, other, values.dtype)
    for c, value in zip(ALPHABET, values, strict=True):
        table[ord(c)] = table[ord(c.lower())] = value
    return table


def _sorted_once(rows: np.ndarray) -> np.ndarray:
    """Distinct rows (or numbers) in order."""
    if not len(rows):
        return rows
    if rows.ndim == 1:
        rows = np.sort(rows)
        return rows[np.append(True, rows[1:] != rows[:-1])]
    rows = rows[np.lexsort(rows.T)]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]


def _buckets(rows: np.ndarray) -> np.ndarray:
    x = rows if rows.ndim == 1 else np.bitwise_xor.reduce(rows * np.arange(1, 2 * rows.shape[1], 2, dtype=np.uint64), axis=1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(52)).astype(np.uint16) % BUCKETS


class Folded:
    """Distinct runs among those put in. Kind 0 are numbers of up to eight letters below U+00FF (0xFF fills up shorter ones), kind n rows of three letters a number."""

    def __init__(self) -> None:
        self.runs: dict[int, list[np.ndarray]] = {}
        self.held = 0

    def add(self, kind: int, rows: np.ndarray) -> None:
        rows = _sorted_once(rows)
        if len(rows):
            self.runs.setdefault(kind, []).append(rows)
            self.held += rows.size

    def put(self, points: np.ndarray, offsets: np.ndarray, n: int) -> None:
        """Runs of ``n`` letters."""
        inside = starts(offsets, n)
        if not inside.any():
            return
        other = np.zeros(len(inside), bool) if n <= 8 else inside.copy()
        if n <= 8:
            wide = np.flatnonzero(points >= 0xFF)
            at = (wide[:, None] - np.arange(n)[None, :]).ravel()
            other[at[(at >= 0) & (at < len(other))]] = True
            padded = np.zeros(len(points) + 8, np.uint8)
            padded[: len(points)] = points.astype(np.uint8)
            runs = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(inside),), (1,), writeable=False)[inside & ~other]
            self.add(0, runs if n == 8 else runs | np.uint64((1 << 64) - (1 << 8 * n)))
        at = np.flatnonzero(inside & other)
        for lo in range(0, len(at), 1 << 18):
            letters = np.zeros((len(at[lo : lo + (1 << 18)]), -(-n // 3) * 3), np.uint64)
            letters[:, :n] = points[at[lo : lo + (1 << 18), None] + np.arange(n)[None, :]]
            self.add(n, letters[:, 0::3] << np.uint64(42) | letters[:, 1::3] << np.uint64(21) | letters[:, 2::3])

    def fold(self) -> None:
        self.runs = {kind: [_sorted_once(np.concatenate(rows))] for kind, rows in self.runs.items()}
        self.held = sum(rows[0].size for rows in self.runs.values())

    def full(self) -> bool:
        """Whether more than half of HELD is left when equal runs are folded."""
        if self.held > HELD:
            self.fold()
        return self.held > HELD // 2

    def blobs(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, kind, numbers) of what is held, which is given up."""
        self.fold()
        for kind, (rows,) in self.runs.items():
            bucket = _buckets(rows)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for lo, hi in zip(first, np.append(first[1:], len(rows)), strict=True):
                yield int(bucket[lo]), kind, rows[lo:hi].tobytes()
        self.runs, self.held = {}, 0

    def strings(self) -> Iterator[pa.Array]:
        """What is held, as text."""
        self.fold()
        for kind, (rows,) in self.runs.items():
            for lo in range(0, len(rows), ROWS):
                some = rows[lo : lo + ROWS]
                if kind:
                    letters = np.stack([some >> np.uint64(42), some >> np.uint64(21), some], axis=2).reshape(len(some), -1)
                    yield _strings((letters & np.uint64((1 << 21) - 1))[:, :kind])
                    continue
                letters = some.view(np.uint8).reshape(-1, 8)
                length = (letters != 0xFF).sum(axis=1)
                for n in np.unique(length).tolist():
                    yield _strings(letters[length == n, :n])
        self.runs, self.held = {}, 0


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.append(0, np.cumsum(size.sum(axis=1))).astype(np.int32)
    data = np.ascontiguousarray(points).astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def distinct_runs(texts: DataFrame, plain: tuple[int, ...], encoded: tuple[int, ...], seq: str = "seq", name: str = "query") -> DataFrame:
    """(name): all distinct runs of the lengths ``plain`` of texts as they stand, and of ``encoded`` of encoded ones.

    All come from one pass over the texts and one exchange.
    """

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codes(np.array([ord(c) for c in ALPHABET], np.uint32), ord("N"))
        folded = Folded()

        def given() -> Iterator[pa.RecordBatch]:
            found = list(folded.blobs())
            for lo in range(0, len(found), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found[lo : lo + 256], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "runs"])

        for batch in batches:
            for _, points, offsets in _slices(batch.column(0)):
                for letters, lengths in ((points, plain), (table[points], encoded)):
                    for n in lengths:
                        folded.put(letters, offsets, n)
                if folded.full():
                    yield from given()
        yield from given()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, last = Folded(), None
        for batch in batches:
            for bucket, kind, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != last and folded.held > ROWS:  # small buckets go out together
                    yield from (pa.RecordBatch.from_arrays([strings], names=[name]) for strings in folded.strings())
                last = bucket
                rows = np.frombuffer(runs.as_buffer(), "<u8")
                folded.add(kind, rows.reshape(-1, -(-kind // 3)) if kind else rows)
                if folded.held > 2 * HELD:
                    folded.fold()
        yield from (pa.RecordBatch.from_arrays([strings], names=[name]) for strings in folded.strings())

    blobs = texts.select(seq).mapInArrow(cut_out, "bucket int, kind int, runs binary")
    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(once, f"{name} string")


def folded_windows(records: DataFrame, e: int, *, seq: str = "seq", rec_ord: str = "rec_ord", name: str = "color") -> DataFrame:
    """(kmer, name, first, n): windows of ``e`` letters (eight at most) of encoded (any case), padded sequences, counted, with the least occurrence order.

    The same as grouping ``graph.windows`` by k-mer and colour, for record numbers that fit ``occurrence_order``. Windows are
    numbers of three bits a letter, and fold in their task.
    """

    def least(key: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[begins], np.minimum.reduceat(first[order], begins), np.add.reduceat(n[order], begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codes(np.arange(len(ALPHABET), dtype=np.uint8), ALPHABET.index("N"))
        letters = np.frombuffer(ALPHABET.encode(), np.uint8)
        numbers: dict[str | None, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def given() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(numbers), pa.string())
            for key, first, n in held:
                for lo in range(0, len(key), ROWS):
                    some = key[lo : lo + ROWS]
                    codes = some[:, None] >> (3 * np.arange(e - 1, -1, -1))[None, :] & 7
                    yield pa.RecordBatch.from_arrays([_strings(letters[codes]), names.take(pa.array(some >> 3 * e)), pa.array(first[lo : lo + ROWS]), pa.array(n[lo : lo + ROWS])], names=["kmer", name, "first", "n"])

        for batch in batches:
            colors = batch.column(1).dictionary_encode()
            values = np.array([numbers.setdefault(c, len(numbers)) for c in [*colors.dictionary.to_pylist(), None]], np.int64)
            color = values[colors.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).astype(np.int64)]
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            record = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            for at, points, offsets in _slices(batch.column(0)):
                size = np.diff(offsets)
                text = np.flatnonzero(size >= e)
                if not len(text):
                    continue
                # e end marks before each text and one behind it
                into = np.arange(len(points)) + np.repeat((e + 1) * np.arange(len(size)) + e, size)
                padded = np.full(len(points) + (e + 1) * len(size), ALPHABET.index(END), np.uint8)
                padded[into] = table[points]
                begins = offsets + (e + 1) * np.arange(len(offsets))
                code = np.zeros(len(padded) - e + 1, np.int64)
                for i in range(e):
                    code = code << 3 | padded[i : len(padded) - e + 1 + i]
                n = size[text] + 2
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                key = np.repeat(color[at + text] << 3 * e, n) | code[np.repeat(begins[text], n) + pos]
                first = np.where(np.repeat(known[at + text], n), np.repeat(record[at + text] * (1 << 31), n) + pos, _LONG)
                held.append(least(key, first, np.ones(len(key), np.int64)))
                rows += len(held[-1][0])
                if rows > HELD // 4:
                    held[:] = [least(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    rows = len(held[0][0])
                    if rows > HELD // 8:
                        yield from given()
                        held, rows = [], 0
        if held:
            held[:] = [least(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield from given()

    ready = records.where(F.length(seq) >= e).select(seq, F.col(name).cast("string"), F.col(rec_ord).cast("long"))
    found = ready.mapInArrow(run, f"kmer string, `{name}` string, first long, n long")
    return found.groupBy("kmer", name).agg(F.nullif(F.min("first"), F.lit(_LONG)).alias("first"), F.sum("n").alias("n"))
