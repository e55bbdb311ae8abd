"""Substring dedup by super-k-mer partitioning over words.

Consecutive windows of ``WINDOW`` words that share a minimiser travel as one packed string to the
minimiser's bucket (see ``windows``). There the words are numbered, windows are ranked by
sorting (runs of 1, 2, 4, ... words), and windows of equal rank are counted exactly. Every
word that lies in a window which occurs more than once is removed, in all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, covered, freed, ranges
from .windows import Windows, keyed, repeated_spans, span_arrays, unkeyed, with_spans

WINDOW = 35
GRAM = 8


def window_ranks(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words; equal runs have equal numbers."""
    rank, width = words.astype(np.int64), 1

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        order = np.argsort(key)
        k = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        return out

    while width * 2 <= size:
        rank = paired(rank[: len(rank) - width], rank[width:])
        width *= 2
    if width < size:
        n = len(words) - size + 1
        rank = paired(rank[:n], rank[size - width : size - width + n])
    return rank


def kernel(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, end) of the windows that occur more than once."""
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in body.split()] for body in part["bodies"]]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([np.array(w, np.int64) for w in words])
    first = np.cumsum(size) - size
    rank = window_ranks(flat, WINDOW)
    at = ranges(first, size - WINDOW + 1)
    own = np.repeat(np.arange(len(words)), size - WINDOW + 1)
    doc, start, r = part["doc"][own], part["start"][own] + at - first[own], rank[at]
    order = np.lexsort((start, doc, r))
    same = (r[order][1:] == r[order][:-1]) & ((doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1]))
    hit = np.zeros(len(order), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return own[hit], start[hit], start[hit] + WINDOW


CONFIG = Windows("word", WINDOW, GRAM, False)


def repeated_words(docs: DataFrame, config: Windows = CONFIG) -> DataFrame:
    """Spans (doc_id, start, end) of words in windows whose word sequence also starts elsewhere."""
    return repeated_spans(config, docs, kernel)  # docs: rows of keyed


def op9(docs: DataFrame, config: Windows = CONFIG) -> DataFrame:
    """The contract's digest.

    Null texts have no words; with none kept, the hash is that of the empty string; texts are taken whole,
    however long. Rows that share a doc_id but not the text are different documents, null ids among
    them; rows that share both are one row repeated and count once as an occurrence. Other columns are not read;
    an empty table gives no rows.
    """
    docs = keyed(docs)
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                at, starts, ends = span_arrays(batch)
                total, removed, sha = [], [], []
                for i, text in enumerate(column(batch, "text").to_pylist()):
                    words = (text or "").encode().split()
                    n = len(words)
                    a, b = starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
                    if len(a):
                        mask, _ = covered(a, b, n)
                        words = [words[j] for j in np.flatnonzero(~mask)]
                    total.append(n)
                    removed.append(n - len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", *[f.name for f in extra]])

    return unkeyed(with_spans(docs, repeated_words(docs, config)).mapInArrow(freed(run), T.StructType([docs.schema["doc_id"], *extra])))
