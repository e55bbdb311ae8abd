"""Binary forms of row tables: raw matrices and string sets.

A matrix is many files of some rows each. Packing is a grouping of narrow rows by their place, a bounded number
to a file; a file is read by one task, row by row, and its rows leave that task in small batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import colorsets as C

#: Words (of a raw matrix) and rows (of a string set) that leave a task together.
BATCH_WORDS, BATCH_ROWS = 1 << 16, 4096
#: Rows of a packed file.
ROWS = 4096


def _hex64(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 16, "0")


def _content(each: DataFrame, part: Column, head: Column, body: Column, order: Column) -> DataFrame:
    """(path, content): the bytes of ``head`` and of its rows in order, for each part; both columns are in hex."""
    placed = each.select(part.alias("part"), order.alias("o"), body.alias("b"))
    whole = placed.groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o", "b"))).alias("rows"))  # ROWS at most
    return whole.select(F.format_string("part-%012d", "part").alias("path"), F.unhex(F.concat(head, F.array_join(F.transform("rows", lambda r: r["b"]), ""))).alias("content"))


def packed_matrix(rows: DataFrame, n_colors: int, per: int = ROWS) -> DataFrame:
    """(path, content) of raw matrices with ``per`` rows (row_id, colors) each: a row count, then a word count and words a row, big-endian."""
    words = C.words(F.col("colors"), n_colors)
    body = F.concat(_hex64(F.size(words)), F.array_join(F.transform(words, _hex64), ""))
    return _content(rows, F.floor(F.col("row_id") / per), _hex64(F.col("n")), body, F.col("row_id"))


def packed_strings(rows: DataFrame, n_colors: int, prefixes: list[int], per: int = ROWS) -> DataFrame:
    """(path, content) of string sets of rows (row_id, kmer, colors): the class colours, the numbers of columns and rows, then each row's colours and string."""
    lists = "".join(f"{x:016x}" for x in [len(prefixes), *prefixes, n_colors])
    body = F.concat(_hex64(F.size("colors")), F.array_join(F.transform("colors", _hex64), ""), F.hex("kmer"), F.lit("00"))
    return _content(rows, F.floor(F.col("row_id") / per), F.concat(F.lit(lists), _hex64(F.col("n"))), body, F.col("row_id"))


def _bit_lists(words: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The set bits of rows of ``counts`` words."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    ends = np.cumsum(counts)
    within = np.arange(len(words)) - np.repeat(ends - counts, counts)
    offsets = np.searchsorted(word, np.append(0, ends))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(64 * within[word] + bit, pa.int32()))


def matrix_rows(files: DataFrame, *, swap_bytes: bool = False) -> DataFrame:
    """(file, row_id, colors) of raw matrices that come as (path, content); row_id counts from 0 in each."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = np.frombuffer(raw.as_buffer(), "<u8" if swap_bytes else ">u8")
                n, at, first = int(words[0]), 1, 0
                while first < n:
                    begin, counts, held = at, [], 0
                    while first + len(counts) < n and held < BATCH_WORDS:
                        counts.append(int(words[at]))
                        held += counts[-1] + 1
                        at += counts[-1] + 1
                    counts = np.array(counts)
                    inner = np.delete(words[begin:at], np.cumsum(counts + 1) - counts - 1)
                    ids = np.arange(first, first + len(counts))
                    first += len(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(len(ids), np.int64))), pa.array(ids), _bit_lists(inner, counts)], names=["file", "row_id", "colors"])

    return files.select("path", "content").mapInArrow(parse, "file string, row_id long, colors array<int>")


def string_rows(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, kmer, colors) of string sets that come as (path, content); ``limit`` reads the first rows of each only."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                number = lambda at: struct.unpack_from(">Q", raw, at)[0]
                at = 8 + 8 * number(0)
                left, at = number(at + 8), at + 16
                left = left if limit is None else min(left, limit)
                while left:
                    kmers, colors = [], []
                    for _ in range(min(left, BATCH_ROWS)):
                        n = number(at)
                        colors.append(sorted(struct.unpack_from(f">{n}Q", raw, at + 8)))
                        at += 8 + 8 * n
                        end = raw.index(b"\0", at)
                        kmers.append(raw[at:end].decode())
                        at = end + 1
                    left -= len(kmers)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(kmers)), pa.array(kmers), pa.array(colors, pa.list_(pa.int32()))], names=["file", "kmer", "colors"])

    return files.select("path", "content").mapInArrow(parse, "file string, kmer string, colors array<int>")


def read_raw_matrix(spark: SparkSession, paths: list[str] | str, *, swap_bytes: bool = False) -> DataFrame:
    """``matrix_rows`` of binary files."""
    return matrix_rows(spark.read.format("binaryFile").load(paths), swap_bytes=swap_bytes)


def read_string_sets(spark: SparkSession, paths: list[str] | str, limit: int | None = None) -> DataFrame:
    """``string_rows`` of binary files."""
    return string_rows(spark.read.format("binaryFile").load(paths), limit)
