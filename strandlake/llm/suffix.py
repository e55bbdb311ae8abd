"""Suffix-array dedup by common-prefix intervals.

The strings of a bucket (see ``windows``) get an enhanced suffix array: suffixes ranked by
prefix doubling, common prefixes of neighbours read off the rank tables. A stack scan over
it visits the common-prefix intervals; those whose suffixes are preceded by different bytes
are the maximal repeats, and each is reported with all its occurrences. The dedup keeps the
first occurrence of every string of ``window`` bytes and removes what the later ones cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, covered, freed
from .windows import NO_ID, Windows, keyed, repeated_spans, span_arrays, unkeyed, with_spans

WINDOW = 100
GRAM = 32


def suffix_array(text: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` and the common prefix of each with the one before it.

    ``text`` holds strings of symbols 1..256 (as int16) that each end in a 0; no string is
    longer than ``longest``. Prefixes are ranked at lengths 6, 12, 24, ... and compared rank by
    rank. Common prefixes may run past a 0; callers cap them.
    """
    n = len(text)
    pad = np.concatenate([text, np.zeros(2 * longest + 8, text.dtype)]).astype(np.int64)
    key = pad[:n]
    for j in range(1, 6):
        key = key << 9 | pad[j : n + j]
    tables: list[tuple[int, np.ndarray]] = []
    width = 6
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        tables.append((width, rank.astype(np.int32)))
        if width >= longest or rank[order[-1]] == n - 1:
            break
        key = rank << 32
        if width < n:
            key[: n - width] |= rank[width:] + 1
        width *= 2
    order = starts[np.argsort(tables[-1][1][starts])]
    a, b = order[:-1], order[1:]
    off = np.zeros(len(a), np.int64)
    for width, rank in reversed(tables):
        i, j = a + off, b + off
        same = (i < n) & (j < n) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        off += width * same
    for _ in range(5):
        off += (a + off < n) & (b + off < n) & (pad[np.minimum(a + off, n)] == pad[np.minimum(b + off, n)])
    return order, np.append(0, off)


def repeat_intervals(lcp: list[int], left: list[int], first: list[int], least: int) -> tuple[list[tuple[int, int, int, bool]], list[int]]:
    """Stack scan over suffixes in order.

    ``lcp[i]`` is the common prefix with suffix i-1; ``left[i]`` the symbol before suffix i,
    negative and unique where there is none; ``first[i]`` ranks the occurrences. Returns the
    intervals of common prefix ``least`` or more as (from, to, prefix, preceded by different
    symbols) and, for each suffix, the longest prefix that an earlier occurrence has too: where
    two intervals or suffixes meet, the later of their earliest occurrences is covered that far.
    """
    n = len(lcp)
    intervals: list[tuple[int, int, int, bool]] = []
    reach = [0] * n
    stack: list[list] = []  # prefix, from, symbol before (None once they differ), earliest occurrence

    def meet(top: list, symbol: int | None, best: int) -> None:
        if top[2] != symbol:
            top[2] = None
        if first[best] < first[top[3]]:
            best, top[3] = top[3], best
        reach[best] = top[0]

    for i in range(1, n + 1):
        here = lcp[i] if i < n else -1
        low, symbol, best = i - 1, left[i - 1], i - 1
        while stack and stack[-1][0] > here:
            top = stack.pop()
            meet(top, symbol, best)
            prefix, low, symbol, best = top
            intervals.append((low, i - 1, prefix, symbol is None))
        if here >= least:
            if stack and stack[-1][0] == here:
                meet(stack[-1], symbol, best)
            else:
                stack.append([here, low, symbol, best])
    return intervals, reach


def bucket_repeats(bodies: list[bytes], order_key: np.ndarray, least: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]:
    """Suffixes (string, place) in suffix-array order that share ``least`` bytes with another, how far an
    earlier occurrence covers each, and the intervals among them. ``order_key`` ranks the
    strings' documents, ``shift`` is each string's place in its document."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = np.zeros(int(sizes.sum()) + len(bodies), np.int16)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    body = np.ones(len(text), bool)
    body[begin + sizes] = False
    text[body] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 1
    place = np.arange(len(text)) - begin[owner]
    starts = np.flatnonzero(place + least <= sizes[owner])
    order, lcp = suffix_array(text, starts, int(sizes.max()))
    own = owner[order]
    left_over = sizes[own] - place[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left_over[1:], left_over[:-1]))
    # runs of suffixes that share ``least`` bytes; runs all preceded by one byte repeat what the run before them says
    run = np.cumsum(lcp < least)
    before = np.where(place[order] > 0, text[np.maximum(order - 1, 0)], -1 - np.arange(len(order)))
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(run)))
    diverse = np.zeros(0, bool)
    if len(head):
        diverse = (np.minimum.reduceat(before, head) != np.maximum.reduceat(before, head)) & (size > 1)
    keep = np.repeat(diverse, size)
    order, own, lcp, before = order[keep], own[keep], lcp[keep].copy(), before[keep]
    if not len(order):
        return own, order, order, [], order
    spot = place[order]
    position = np.lexsort((shift[own] + spot, order_key[own]))
    first = np.empty(len(order), np.int64)
    first[position] = np.arange(len(order))
    intervals, reach = repeat_intervals(lcp.tolist(), before.tolist(), first.tolist(), least)
    return own, spot, np.array(reach, np.int64), intervals, first


def kernel(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, end) of what an earlier occurrence covers."""
    out = []
    group, sizes = part["group"], np.cumsum([len(b) for b in part["bodies"]])
    lo = 0
    while lo < len(group):  # whole anchors of about half a megabyte at a time
        hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 19), side="right"))
        hi = int(np.searchsorted(group, group[max(hi, lo + 1) - 1], side="right"))
        own, spot, reach, _, _ = bucket_repeats(part["bodies"][lo:hi], part["doc"][lo:hi], WINDOW, part["start"][lo:hi])
        hit = reach > 0
        own, a = own[hit] + lo, (part["start"][lo:hi][own] + spot)[hit]
        out.append((own, a, a + reach[hit]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def maximal_repeats(strings: list[tuple[int, bytes]], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeat groups of whole strings (id, bytes): the repeat and all places it occurs at."""
    bodies = [s for _, s in strings]
    ids = np.array([i for i, _ in strings], np.int64)
    if not bodies:
        return []
    own, spot, _, intervals, _ = bucket_repeats(bodies, ids, least, np.zeros(len(bodies), np.int64))
    out = []
    for lo, hi, prefix, diverse in intervals:
        if diverse:
            j = int(own[lo])
            out.append((bodies[j][int(spot[lo]) : int(spot[lo]) + prefix], sorted((int(ids[own[i]]), int(spot[i])) for i in range(lo, hi + 1))))
    return out


CONFIG = Windows("byte", WINDOW, GRAM, True)


def repeated_bytes(docs: DataFrame, config: Windows = CONFIG) -> DataFrame:
    """Spans (doc_id, start, end) of bytes in strings of WINDOW bytes that also start earlier in the corpus."""
    return repeated_spans(config, docs, kernel)  # docs: rows of keyed


def op7(docs: DataFrame, config: Windows = CONFIG) -> DataFrame:
    """The contract's digest.

    Null and empty texts have 0 bytes and keep the empty string; texts are taken whole, however long. A null
    doc_id counts as the smallest; rows that share a doc_id but not the text are ordered by a
    hash of it; rows that share both are one row repeated, and each gets that row's result. Other columns are
    not read; an empty table gives no rows.
    """
    extra = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def make(batch: pa.RecordBatch, size: list, removed: list, runs: list, rest: list) -> pa.RecordBatch:
        cols = [column(batch, "doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rest])]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f.name for f in extra]])

    docs = keyed(docs)
    return unkeyed(digest(with_spans(docs, repeated_bytes(docs, config)), make, T.StructType([docs.schema["doc_id"], *extra])))


def without_repeats(docs: DataFrame, config: Windows = CONFIG) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the repeated bytes taken out of text.

    A character goes only if all its bytes are repeated, so texts stay valid UTF-8. Null texts
    stay null; no row goes. Documents are told apart and ordered as in ``op7``; a column named ``spans`` is dropped,
    others stay as they are.
    """
    names = [n for n in docs.columns if n != "spans"]
    others = F.struct(*[n for n in names if n != "text"], F.lit(0).alias("__")).alias("rest")
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.xxhash64("text").alias("uid"), "text", others)
    joined = with_spans(rows, repeated_bytes(rows, config)).select("text", "rest", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                at, starts, ends = span_arrays(batch)
                texts = column(batch, "text").to_pylist()
                for i in np.flatnonzero(np.diff(at)).tolist():
                    raw = np.frombuffer((texts[i] or "").encode(), np.uint8)
                    keep = ~covered(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], len(raw))[0]
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # number of the character of each byte
                    whole_char = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
                    whole_char[char[keep]] = True
                    texts[i] = raw[whole_char[char]].tobytes().decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), column(batch, "rest")], names=["text", "rest"])

    whole = joined.mapInArrow(freed(run), T.StructType([T.StructField("text", T.StringType()), rows.schema["rest"]]))
    return whole.select(*[F.col("text") if n == "text" else F.col("rest")[n].alias(n) for n in names])


def digest(found: DataFrame, make, schema: T.StructType) -> DataFrame:
    """Cut the spans out of each text and let ``make`` build the output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                at, starts, ends = span_arrays(batch)
                size, removed, runs, rest = [], [], [], []
                for i, text in enumerate(column(batch, "text").to_pylist()):
                    raw = (text or "").encode()
                    a, b = starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
                    n_runs, kept = 0, raw
                    if len(a):
                        mask, n_runs = covered(a, b, len(raw))
                        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                    size.append(len(raw))
                    removed.append(len(raw) - len(kept))
                    runs.append(n_runs)
                    rest.append(kept)
                yield make(batch, size, removed, runs, rest)

    return found.mapInArrow(freed(run), schema)
