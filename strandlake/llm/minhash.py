"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct shingles of SHINGLE words. A sketch holds, for each of
REGISTERS hash functions, the least hash over the set taken as an exponential variable and
rounded down to a power of SPACING: registers of the union of two sets are the larger of the
two, and equal registers are likely where sets overlap. Bands of registers find candidates;
the joint likelihood of the registers' order and equality, given both set sizes, estimates
the similarity; what may reach the threshold is confirmed on the full sets.

Documents with equal sets are one class from the start. In a band's bucket each class is
first compared with the least one; buckets that still hold several components then meet once
more: what lies outside a bucket's largest component is compared with all of it, in tiles, until one
link joins two components. Pairs are never rows of a table, so a group of near copies is
shipped in proportion to its size.

A row's identity is a hash of doc_id and text, so rows that share a doc_id (or have none) are
documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, column, cut, few, freed, gram_hashes, lower_ascii, mix, ranges, shuffle_partitions, small_batches, span_hashes, text_slices, word_spans
from .components import components, pieces, tiled_apart

SHINGLE = 4
REGISTERS = 160
BANDS = 32
SPACING = 1.2
#: The estimate must come this many standard deviations below the threshold to drop a candidate.
DEVIATIONS = 5.0
TOP = 255
_OFFSET = 8.0

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct 64-bit shingle hashes sorted within each row, offsets by row)."""
    for lo, hi, data, offs in text_slices(texts):
        data = lower_ascii(data)
        start, end, first = word_spans(data, offs)
        words = span_hashes(data, start, end)
        n = np.diff(first)
        count = np.maximum(n - size + 1, 0)
        doc = np.repeat(np.arange(hi - lo), count)
        h = gram_hashes(words, size)[ranges(first[:-1], count)] if len(doc) else np.zeros(0, U64)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):  # fewer words: the whole sequence is one shingle
            extra = np.array([gram_hashes(words[first[i] : first[i + 1]], int(n[i]))[0] for i in short], U64)
            doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(extra ^ n[short].astype(U64))])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        yield lo, hi, h, np.searchsorted(doc, np.arange(hi - lo + 1))


def registers(h: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(U64).max, U64)
    for lo in range(0, len(h), 512):
        least = np.minimum(least, (h[lo : lo + 512, None] * _MULTIPLIERS[None, :]).min(axis=0))
    x = -np.log1p(-((least >> U64(11)).astype(np.float64) + 0.5) / 2.0**53)
    return np.clip(np.floor(_OFFSET - np.log(x) / np.log(SPACING)), 0, TOP).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def likely_similarity(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, total: int = REGISTERS) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of a are greater and less than b's."""
    if len(n_a) > 1024:  # a row has 201 points of the likelihood, several times
        parts = [likely_similarity(*(x[lo : lo + 1024] for x in (greater, less, n_a, n_b)), total) for lo in range(0, len(n_a), 1024)]
        return np.concatenate(parts)
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * most[:, None]
    scale = (SPACING - 1) / SPACING

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(SPACING)

    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    same = total - greater - less
    score = greater[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return grid[np.arange(len(u)), score.argmax(axis=1)]


SKETCH_SCHEMA = "id long, doc_id long, n_shingles long, s1 long, s2 long, sketch binary"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Set size, 128-bit set identity and sketch of each document; empty sets have a null sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_all, s1, s2, sig = [], [], [], []
            for lo, hi, h, offs in shingle_sets(column(batch, "text"), size):
                n = np.diff(offs)
                pad = np.append(h, U64(0))
                for out, salt in ((s1, 0x5851F42D4C957F2D), (s2, 0x14057B7EF767814F)):
                    sums = np.add.reduceat(np.append(mix(h ^ U64(salt)), U64(0)), offs[:-1]) if len(pad) else np.zeros(hi - lo, U64)
                    out.append(np.where(n > 0, sums, U64(0)).view(np.int64))
                n_all.append(n)
                sig += [registers(h[offs[i] : offs[i + 1]]).tobytes() if n[i] else None for i in range(hi - lo)]
            if n_all:
                yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "doc_id"), *(pa.array(np.concatenate(x), pa.int64()) for x in (n_all, s1, s2)), pa.array(sig, pa.binary())], names=["id", "doc_id", "n_shingles", "s1", "s2", "sketch"])

    return small_batches(docs).select("id", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), SKETCH_SCHEMA)


def likely_pairs(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Candidates (a, b) whose sizes allow the threshold and whose sketches don't rule it out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b"))
    floor = per_cent / 100 - DEVIATIONS * np.sqrt(per_cent / 100 * (1 - per_cent / 100) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(column(batch, f"sketch_{c}").to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in "ab")
            est = likely_similarity((x > y).sum(1), (x < y).sum(1), *(column(batch, f"n_{c}").to_numpy().astype(float) for c in "ab"))
            keep = pa.array(est >= floor)
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(keep) for c in "ab"], names=["a", "b"])

    return joined.mapInArrow(freed(run), "a long, b long")


def set_rows(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, members): packed shingle hashes of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for lo, hi, h, offs in shingle_sets(column(batch, "text"), size):
                packed += [h[offs[i] : offs[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(packed, pa.binary())], names=["id", "members"])

    return docs.select("id", "text").join(few(wanted), "id", "left_semi").mapInArrow(freed(run), "id long, members binary")


def similar(p: np.ndarray, q: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets of distinct hashes reach the threshold."""
    if 100 * min(len(p), len(q)) < per_cent * max(len(p), len(q)):
        return False
    both = np.sort(np.concatenate([p, q]), kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= per_cent * (len(p) + len(q) - inter)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    have = set_rows(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), size)
    side = lambda x: have.select(F.col("id").alias(x), F.col("members").alias(f"members_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, U64), np.frombuffer(y, U64), per_cent) for x, y in zip(column(batch, "members_a").to_pylist(), column(batch, "members_b").to_pylist(), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(mask) for c in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(freed(run), "a long, b long")


#: Members of a bucket, and shingles in their sets, that one tile has; two tiles are compared with each other at a time.
TILE = 1024
TILE_SHINGLES = 1 << 21


def _tiled(rows: DataFrame) -> DataFrame:
    return tiled_apart(rows.withColumn("weight", F.col("n_shingles")), F.ceil(F.greatest(F.col("n") / TILE, F.col("m") / TILE_SHINGLES)).cast("int"))


def _likely_across(piece: pa.Table, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a piece's rows in different components that the sketches don't rule out.

    A pair is looked at in the first band that it shares, not in every one.
    """
    n = piece.num_rows
    sketch = np.frombuffer(b"".join(piece.column("sketch").to_pylist()), np.uint8).reshape(n, REGISTERS)
    comp, tile, other, sizes, ids = (piece.column(c).to_numpy() for c in ("component", "tile", "other", "n_shingles", "id"))
    band = int(piece.column("band")[0].as_py())
    width = REGISTERS // BANDS
    lo, hi = np.minimum(tile, other), np.maximum(tile, other)
    left = np.flatnonzero(tile == lo)
    right = np.flatnonzero(tile == hi)
    same_tile = bool((lo == hi).all())
    for a in range(0, len(left), 64):
        i = left[a : a + 64]
        equal = sketch[i][:, None, :] == sketch[right][None, :, :]
        want = (comp[i][:, None] != comp[right][None, :]) & (equal.sum(axis=2) >= floor * REGISTERS)
        if same_tile:
            want &= ids[i][:, None] < ids[right][None, :]
        x, y = np.nonzero(want)
        if not len(x):
            continue
        first = equal[x, y].reshape(-1, BANDS, width).all(axis=2).argmax(axis=1)
        x, y = x[first == band], y[first == band]
        p, q = i[x], right[y]
        for at in range(0, len(p), 20_000):
            r, t = p[at : at + 20_000], q[at : at + 20_000]
            est = likely_similarity((sketch[r] > sketch[t]).sum(1), (sketch[r] < sketch[t]).sum(1), sizes[r].astype(float), sizes[t].astype(float))
            yield r[est >= floor], t[est >= floor]


def links_across(rest: DataFrame, docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Links (a, b) that join different components within buckets.

    ``rest`` has key, band, id, component, sketch, n_shingles. Rows meet by bucket twice: with
    their sketches, to find the members that have a likely partner, and then those with their sets. No pair is
    shipped; a pair whose components are joined already is not compared.
    """
    floor = per_cent / 100 - DEVIATIONS * np.sqrt(per_cent / 100 * (1 - per_cent / 100) / REGISTERS)
    n = shuffle_partitions(rest.sparkSession)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hit = np.zeros(piece.num_rows, bool)
            for i, j in _likely_across(piece, floor):
                hit[i] = hit[j] = True
            if hit.any():
                mask = pa.array(hit)
                yield pa.RecordBatch.from_arrays([piece.column(c).combine_chunks().filter(mask) for c in ("key", "id")], names=["key", "id"])

    fields = ["piece", "key", "band", "id", "component", "tile", "other", "n_shingles", "sketch"]
    flagged = cut(_tiled(rest).select(*fields).repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(freed(likely), "key long, id long").distinct())
    have = set_rows(docs, flagged.select("id").distinct(), size)
    full = _tiled(rest.join(flagged, ["key", "id"], "left_semi")).join(have, "id").select(*fields, "members")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            up: dict[int, int] = {}

            def root(c: int, up: dict[int, int] = up) -> int:
                while up.get(c, c) != c:
                    up[c] = up.get(up[c], up[c])
                    c = up[c]
                return c

            comp, ids = piece.column("component").to_pylist(), piece.column("id").to_pylist()
            sets = [np.frombuffer(x, U64) for x in piece.column("members").to_pylist()]
            a, b = [], []
            for i, j in _likely_across(piece, floor):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root(comp[x]), root(comp[y])
                    if p != q and similar(sets[x], sets[y], per_cent):
                        up[p] = q
                        a.append(ids[x])
                        b.append(ids[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return full.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(freed(link), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, per_cent: int = 80) -> DataFrame:
    """(id, doc_id, n_shingles, lead): each row of ``keyed`` with the least (doc_id, id) that links reach, itself included.

    Documents are linked if 100 * |A & B| >= per_cent * |A | B|. Documents without words or
    text have n_shingles 0 and are linked with nothing; a null doc_id is the least; whole texts
    count, however long; rows repeated in full share a line; an empty table gives no rows.
    """
    rows = cut(sketches(docs, size))
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "id")).alias("first"), F.any_value("sketch").alias("sketch"))
    classes = cut(classes.withColumn("id", F.col("first.id")))
    width = REGISTERS // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(F.xxhash64(b, F.substring(F.col("sketch"), b * width + 1, F.lit(width))).alias("key"), b.alias("band")))
    banded = classes.select(F.inline(keys), "id")
    buckets = banded.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = cut(banded.join(buckets, "key"))
    stars = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    found = components(confirmed(cut(likely_pairs(stars, classes, per_cent)), docs, size, per_cent))
    # buckets of three or more that aren't one component yet: compare across components
    named = members.where("n > 2").join(found, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    split = named.groupBy("key").agg((F.min("component") < F.max("component")).alias("split")).where("split").select("key")
    rest = cut(named.join(split, "key", "left_semi").join(classes.select("id", "n_shingles", "sketch"), "id"))
    more = cut(links_across(rest, docs, size, per_cent))
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_class = classes.select("s1", "s2", "n_shingles", "first", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("id")
    leads = of_class.groupBy("component").agg(F.min("first").alias("lead"))
    of_class = of_class.drop("first").join(leads, "component")
    placed = rows.select("id", "doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2", "n_shingles"], "left")
    return placed.select("id", "doc_id", "n_shingles", F.coalesce("lead", F.struct("doc_id", "id")).alias("lead"))


def keyed(docs: DataFrame) -> DataFrame:
    """id (of doc_id and text), doc_id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", "text")


def op3(docs: DataFrame) -> DataFrame:
    """The contract's digest. Other columns are not read; of the rest see ``near_duplicates``."""
    out = near_duplicates(keyed(docs))
    first = F.col("lead.doc_id")
    return out.select("doc_id", "n_shingles", first.alias("component_id"), F.col("doc_id").eqNullSafe(first).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates (by reachability), that of the least doc_id.

    Of rows that are alike in doc_id and text one stays; rows that share only the doc_id, or have
    none, are compared like any others. Null and empty texts have no near duplicates. Columns, whatever their
    names, stay as they are.
    """
    found = cut(near_duplicates(keyed(docs), size, per_cent).select("id", F.col("lead.id").alias("lead")))
    gone = few(found.where("id <> lead").select(F.col("id").alias("__id")).distinct())
    left = docs.withColumn("__id", F.xxhash64("doc_id", "text")).join(gone, "__id", "left_anti")
    if not found.groupBy("id").count().where("count > 1").isEmpty():  # rows repeated in full
        left = left.withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy("__id"))).where("__n = 1").drop("__n")
    return left.drop("__id")
