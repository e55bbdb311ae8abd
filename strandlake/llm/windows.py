"""Repeated windows over whole corpora: minimiser buckets that exchange packed strings.

A window is W consecutive units (bytes or words) of one text. Its anchor is the run of K units
in it whose hash is smallest (the leftmost of equals), so equal windows have equal anchors at
equal places. Consecutive windows that share an anchor form a super-k-mer: one string of at
most 2W-K units. The job never ships texts that have nothing in common with others:

A  each slice of texts finds its super-k-mers. Equal ones within the slice are settled on the
   spot; the first of them travels as (anchor, document, place).
B  rows meet by anchor, in order. Equal ones (128 bits of hash) are settled like those of one
   slice: they are one string with many places. An anchor that only one string has can't hold
   another repeated window and is dropped.
C  the others' strings are cut out of their texts and travel to their anchor's bucket. Anchors
   on more than HOT strings (a common line in ever new surroundings) are split by the longest
   prefix there is: each of their windows is a string of its own, with a bucket of its own.
D  a bucket's kernel finds the windows that occur more than once (suffix array or sorting).
E  the spans found meet their texts again.

What crosses the network per occurrence of a repeated string is one row per slice of texts, and
Spark sorts what meets (spilling where it must); tasks read it in order and hold one batch and
at most HOT strings of one anchor, however many rows an anchor has.

A document is a row's doc_id and text: rows that have both in common are one row repeated and
are treated alike; rows that share only the doc_id (or have none) are different documents,
in order of a hash of their texts. A null doc_id counts as the smallest.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, column, freed, gram_hashes, mix, ranges, run_hashes, shuffle_partitions, sliding_min, small_batches, span_hashes, text_slices, whole_runs, word_spans

#: Anchors with more travelling strings than this are split into single windows.
HOT = 256
#: Low bits of a window key that hold the place of its anchor.
PLACE_BITS = 24
#: Units of one text that are looked at together.
SEGMENT = 1 << 22
#: Super-k-mers that are settled together before they travel.
SETTLED = 1 << 17

Kernel = Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (doc_id, text hash) of each row: the document it belongs to.
Docs = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Windows:
    """What counts as a window: ``unit`` is "byte" or "word"; ``keep_first`` spares the first occurrence."""

    unit: str
    size: int
    gram: int
    keep_first: bool
    hot: int = HOT


def units_of(cfg: Windows, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a slice of texts, first unit of each text, and each unit's byte range."""
    if cfg.unit == "byte":
        at = np.arange(len(data), dtype=np.int64)
        return data, offs, at, at + 1
    start, end, first = word_spans(data, offs)
    return span_hashes(data, start, end), first, start, end


def super_kmers(cfg: Windows, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first unit counted from the text's own start, length in units, anchor hash) of each super-k-mer."""
    n, w = len(units), cfg.size
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none, none.astype(U64)
    if n > SEGMENT + w:  # very long texts: overlapping pieces, each window in one of them
        parts = []
        for lo in range(0, n - w + 1, SEGMENT):
            piece = units[lo : lo + SEGMENT + w - 1]
            text, start, length, h = super_kmers(cfg, piece, np.clip(first - lo, 0, len(piece)))
            before = np.maximum(lo - first[text], 0)
            parts.append((text, start + before, length, h))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]
    grams = gram_hashes(units, cfg.gram)
    keys = (grams >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(grams), dtype=U64)
    best = sliding_min(keys, w - cfg.gram + 1)
    place = (best & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    lens = np.maximum(np.diff(first) - w + 1, 0)
    at = ranges(first[:-1], lens)
    if not len(at):
        return none, none, none, none.astype(U64)
    text = np.repeat(np.arange(len(lens)), lens)
    p = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    return text[head], at[head] - first[text[head]], count + w - 1, grams[p[head]]


def sequence_hashes(cfg: Windows, data: np.ndarray, units: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of units[start:start+length] of each row."""
    if cfg.unit == "byte":
        return span_hashes(data, start, start + length)
    return run_hashes(units, start, length)


def places(docs: Docs, start: np.ndarray) -> np.ndarray:
    """A number for each (document, start) that orders them; within one call."""
    order = np.lexsort((start, docs[1], docs[0]))
    new = np.zeros(len(order), bool)
    for c in (*docs, start):
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def settle(keep_first: bool, place: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal strings (hash ``s``): which of them travels on, and which are known to be covered whole.

    Rows of one place (a repeated row of the table) count once.
    """
    n = len(place)
    travels, hit = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return travels, hit
    order = np.lexsort((place, s))
    new = np.append(True, s[order][1:] != s[order][:-1])
    head = order[new][np.cumsum(new) - 1]
    later = place[order] != place[head]
    travels[order[new]] = True
    hit[order[later]] = True
    if not keep_first:
        hit[head[later]] = True
    return travels, hit


def merge_spans(docs: Docs, start: np.ndarray, end: np.ndarray) -> tuple[Docs, np.ndarray, np.ndarray]:
    """Union of spans per document as maximal runs."""
    if not len(start):
        return docs, start, end
    order = np.lexsort((start, docs[1], docs[0]))
    d, u, start, end = docs[0][order], docs[1][order], start[order], end[order]
    new_doc = np.append(True, (d[1:] != d[:-1]) | (u[1:] != u[:-1]))
    group = np.cumsum(new_doc)
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step)
    new = new_doc.copy()
    new[1:] |= start[1:] + group[1:] * step > reach[:-1]
    head = np.flatnonzero(new)
    return (d[head], u[head]), start[head], reach[np.append(head[1:], len(d)) - 1] - group[head] * step


SPAN, STRING, WINDOW = 1, 0, 2
A_SCHEMA = "key long, s long, doc_id long, uid long, start int, units int"
B_SCHEMA = "kind int, doc_id long, uid long, h long, start int, units int, hot boolean"
C_SCHEMA = "kind int, key long, h long, doc_id long, uid long, start int, units int, body binary"
SPAN_SCHEMA = "doc_id long, uid long, start int, end int"


def _batch(schema: str, **cols) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[n], (pa.Array, pa.ChunkedArray)) else pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int32) if k == "int" else c, type=kinds[k]) for n, k in names], names=[n for n, _ in names])


def _full(n: int, value: int) -> np.ndarray:
    return np.full(n, value, np.int64)


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [column(batch, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def find_anchors(cfg: Windows, docs: DataFrame) -> DataFrame:
    """Step A; a string that is known to be covered whole (and doesn't travel) has key and s 0 and units below 0."""

    def settled(found: list) -> Iterator[pa.RecordBatch]:
        d, u, start, length, h, s = (np.concatenate(x) for x in zip(*found, strict=True))
        travels, whole = settle(cfg.keep_first, places((d, u), start), s)
        docs_, a, b = merge_spans((d[whole], u[whole]), start[whole], (start + length)[whole])
        if len(a):
            yield _batch(A_SCHEMA, key=mix(docs_[1].astype(U64)), s=_full(len(a), 0), doc_id=docs_[0], uid=docs_[1], start=a, units=a - b)
        yield _batch(A_SCHEMA, key=h[travels], s=s[travels], doc_id=d[travels], uid=u[travels], start=start[travels], units=length[travels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = _longs(batch, "doc_id", "uid")
            found, held = [], 0
            for lo, _, data, offs in text_slices(column(batch, "text")):
                units, first, _, _ = units_of(cfg, data, offs)
                text, start, length, h = super_kmers(cfg, units, first)
                if len(text):
                    found.append((ids[lo + text], uids[lo + text], start, length, h, sequence_hashes(cfg, data, units, first[text] + start, length)))
                    held += len(text)
                if held >= SETTLED:
                    yield from settled(found)
                    found, held = [], 0
            if found:
                yield from settled(found)

    return small_batches(docs).select("doc_id", "uid", "text").mapInArrow(freed(run), A_SCHEMA)


class _Equal:
    """Rows in order of (key, s, document, start), batch by batch: firsts of equal strings, and what is covered."""

    def __init__(self, keep_first: bool) -> None:
        self.keep_first = keep_first
        self.head: tuple | None = None  # key, s, doc_id, uid, start, units of the string that the last row has
        self.told = True  # the head is covered, and that has been told

    def take(self, key: np.ndarray, s: np.ndarray, doc: np.ndarray, uid: np.ndarray, start: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Rows that are the first of their string, and (doc_id, uid, start, units) of what is covered whole."""
        rows = (key, s, doc, uid, start, units)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
        if self.head is not None:
            new[0] = (key[0], s[0]) != self.head[:2]
        own = np.where(new, np.arange(len(key)), -1)
        own = np.maximum.accumulate(own)  # each row's head; -1: the one from before
        later = ~new
        heads = [np.where(own >= 0, c[own], 0 if self.head is None else h) for c, h in zip((doc, uid, start), (0, 0, 0) if self.head is None else self.head[2:5], strict=True)]
        later &= (doc != heads[0]) | (uid != heads[1]) | (start != heads[2])
        covered = [c[later] for c in rows[2:]]
        if not self.keep_first:
            firsts = np.unique(own[later])
            if len(firsts) and firsts[0] < 0:
                if not self.told:
                    covered = [np.append(c, h) for c, h in zip(covered, self.head[2:], strict=True)]
                    self.told = True
                firsts = firsts[1:]
            covered = [np.append(c, r[firsts]) for c, r in zip(covered, rows[2:], strict=True)]
        if own[-1] >= 0:
            self.head = tuple(int(c[own[-1]]) for c in rows)
            self.told = bool(later[own[-1] :].any())
        return np.flatnonzero(new), tuple(covered)


def shared_anchors(cfg: Windows, rows: DataFrame) -> DataFrame:
    """Step B: equal strings are settled; a string passes if a different one has its anchor."""

    def strings(key: np.ndarray, held: tuple, hot: np.ndarray) -> pa.RecordBatch:
        doc, uid, start, units = held
        return _batch(B_SCHEMA, kind=_full(len(key), STRING), doc_id=doc, uid=uid, h=key, start=start, units=units, hot=hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equal, waiting, hot_key = _Equal(cfg.keep_first), None, None  # waiting: strings of the last anchor, HOT at most
        for batch in batches:
            if not batch.num_rows:
                continue
            key, s, doc, uid, start, units = _longs(batch, "key", "s", "doc_id", "uid", "start", "units")
            span = units < 0
            spans = [(doc[span], uid[span], start[span], -units[span])]
            if not span.all():
                own = [c[~span] for c in (key, s, doc, uid, start, units)]
                first, covered = equal.take(*own)
                spans.append(covered)
                key, *rest = (c[first] for c in (own[0], *own[2:]))
                if waiting is not None:
                    key, *rest = (np.append(w, c) for w, c in zip(waiting, (key, *rest), strict=True))
                    waiting = None
                if len(key):
                    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    size = np.diff(np.append(head, len(key)))
                    last, count = int(head[-1]), np.repeat(size, size)
                    hot = (count > cfg.hot) | (False if hot_key is None else key == hot_key)
                    ready = (count > 1) | hot
                    if not hot[-1]:  # more strings of the last anchor may follow
                        ready[last:] = False
                        waiting = tuple(c[last:] for c in (key, *rest))
                    else:
                        hot_key = key[-1]
                    if ready.any():
                        yield strings(key[ready], tuple(c[ready] for c in rest), hot[ready])
            d, u, a, n = (np.concatenate(x) for x in zip(*spans, strict=True))
            if len(d):
                (d, u), a, b = merge_spans((d, u), a, a + n)
                yield _batch(B_SCHEMA, kind=_full(len(d), SPAN), doc_id=d, uid=u, h=_full(len(d), 0), start=a, units=b - a, hot=np.zeros(len(d), bool))
        if waiting is not None and len(waiting[0]) > 1:
            yield strings(waiting[0], waiting[1:], np.zeros(len(waiting[0]), bool))

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "s", "doc_id", "uid", "start").mapInArrow(freed(run), B_SCHEMA)


def cut_strings(cfg: Windows, docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Step C: the flagged super-k-mers' strings, or the windows of hot ones, and the spans known so far."""
    wanted = flagged.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("kind", "h", "start", "units", "hot")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                yield from one(whole.slice(lo, 1024))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, uids = _longs(batch, "doc_id", "uid")
        lists = column(batch, "wanted")
        rows = lists.flatten()
        counts = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), counts)
        kind, h, start, units = (rows.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("kind", "h", "start", "units"))
        hot = rows.field("hot").to_numpy(zero_copy_only=False)
        known = kind == SPAN
        if known.any():
            o, a, n = owner[known], start[known], units[known]
            yield _batch(C_SCHEMA, kind=_full(len(o), SPAN), key=mix(uids[o].astype(U64)), h=_full(len(o), 0), doc_id=ids[o], uid=uids[o], start=a, units=n, body=pa.nulls(len(o), pa.binary()))
        owner, h, start, units, hot = (c[~known] for c in (owner, h, start, units, hot))
        for first_row, last_row, data, offs in text_slices(column(batch, "text")):
            lo, hi = np.searchsorted(owner, [first_row, last_row])
            if lo == hi:
                continue
            u, first, byte_a, byte_b = units_of(cfg, data, offs)
            o, cold, size = owner[lo:hi], ~hot[lo:hi], units[lo:hi]
            at = first[o - first_row] + start[lo:hi]
            if cold.any():
                s = sequence_hashes(cfg, data, u, at[cold], size[cold])
                a, b = byte_a[at[cold]], byte_b[at[cold] + size[cold] - 1]
                raw = data.tobytes()
                body = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                yield _batch(C_SCHEMA, kind=_full(len(s), STRING), key=h[lo:hi][cold], h=s, doc_id=ids[o[cold]], uid=uids[o[cold]], start=start[lo:hi][cold], units=size[cold], body=body)
            if not cold.all():
                w = size[~cold] - cfg.size + 1
                each, i = ranges(at[~cold], w), np.repeat(np.flatnonzero(~cold), w)
                s = sequence_hashes(cfg, data, u, each, _full(len(each), cfg.size))
                d, a = (ids[o[i]], uids[o[i]]), each - first[o[i] - first_row]
                travels, covered = settle(cfg.keep_first, places(d, a), s)
                n = int(travels.sum())
                yield _batch(C_SCHEMA, kind=_full(n, WINDOW), key=s[travels], h=h[lo:hi][i[travels]], doc_id=d[0][travels], uid=d[1][travels], start=a[travels], units=_full(n, cfg.size), body=pa.nulls(n, pa.binary()))
                (dd, du), a, b = merge_spans((d[0][covered], d[1][covered]), a[covered], a[covered] + cfg.size)
                if len(a):
                    yield _batch(C_SCHEMA, kind=_full(len(a), SPAN), key=mix(du.astype(U64)), h=_full(len(a), 0), doc_id=dd, uid=du, start=a, units=b - a, body=pa.nulls(len(a), pa.binary()))

    # all columns of ``docs``: the join that brings the spans back reads the same exchange
    return docs.join(wanted, ["doc_id", "uid"]).mapInArrow(freed(run), C_SCHEMA)


def bucket_spans(cfg: Windows, rows: DataFrame, kernel: Kernel) -> DataFrame:
    """Step D: spans that the buckets' kernels find, and those already known."""

    def spans(docs: Docs, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        (d, u), a, b = merge_spans(docs, start, end)
        if len(a):
            yield _batch(SPAN_SCHEMA, doc_id=d, uid=u, start=a, end=b)

    def buckets(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole anchors, each with HOT different strings at most."""
        key, doc, uid, start = (table.column(n).to_numpy() for n in ("key", "doc_id", "uid", "start"))
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        if len(key) > 1:
            bodies = table.column("body").to_pylist()
            own, a, b = kernel({"doc": places((doc, uid), np.zeros(len(doc), np.int64)), "start": start.astype(np.int64), "group": group, "bodies": bodies})
            yield from spans((doc[own], uid[own]), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        rest: list[pa.RecordBatch] = []

        def strings() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                string = column(batch, "kind").to_numpy() == STRING
                yield batch.filter(pa.array(string))
                if not string.all():
                    rest.append(batch.filter(pa.array(~string)))
                    return

        for table in whole_runs(strings(), ("key",), 4096):
            yield from buckets(table)
        equal = _Equal(cfg.keep_first)
        for batch in itertools.chain(rest, batches):
            known = column(batch, "kind").to_numpy() == SPAN
            if known.any():
                d, u, a, n = (c[known] for c in _longs(batch, "doc_id", "uid", "start", "units"))
                yield from spans((d, u), a, a + n)
            if not known.all():
                _, (d, u, a, n) = equal.take(*(c[~known] for c in _longs(batch, "key", "h", "doc_id", "uid", "start", "units")))
                yield from spans((d, u), a, a + n)

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("kind", "key", "h", "doc_id", "uid", "start").mapInArrow(freed(run), SPAN_SCHEMA)


#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), uid (hash of the text) and text; both joins of the job use these rows and share their exchange."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.xxhash64("text").alias("uid"), "text")


def repeated_spans(cfg: Windows, docs: DataFrame, kernel: Kernel) -> DataFrame:
    """(doc_id, uid, start, end) in units: spans that hold all removable windows (they may overlap).

    ``docs`` are rows of ``keyed``; further columns of theirs are carried where the job's joins share an exchange.
    """
    return bucket_spans(cfg, cut_strings(cfg, docs, shared_anchors(cfg, find_anchors(cfg, docs))), kernel)


def span_lists(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of ``keyed`` with column ``spans``, null where nothing was found."""
    return docs.join(span_lists(spans), ["doc_id", "uid"], "left").drop("uid")


def unkeyed(df: DataFrame) -> DataFrame:
    """Give null ids back."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def span_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each row's spans, and their starts and ends."""
    lists = column(batch, "spans")
    counts = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        counts = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, counts)
    rows = lists.flatten()
    return np.append(0, np.cumsum(counts)), rows.field("start").to_numpy().astype(np.int64), rows.field("end").to_numpy().astype(np.int64)
