"""Embedding near-dedup by NN-descent.

Each vector keeps a list of its nearest known neighbours. Lists start from buckets of random
hyperplane codes; then, round by round, the lists of a vector's neighbours are compared with
each other (a join of the graph with the vectors, and small matrix products at the shared
neighbour) and better neighbours enter. A list that is full of neighbours above the
threshold is enlarged. Links above the threshold give components; rounds go on until none joins
two of them. A group of more links than its lists hold gives a spanning forest of them as well,
and buckets too large for one piece meet once more in tiles, where members of different
components are compared exactly: linked vectors that share a bucket always end in one component.
Groups of near copies are larger than any list, so the number of links is counted exactly
in the end, by tiles of TILE vectors within each component: no pair is emitted for it.

Equal vectors are one node; their number weighs in the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, column, cut, few, freed, mix, shuffle_partitions, whole_runs
from .components import components, pieces, tiled_apart
from .vectors import matrix, unit, usable_rows

LIST = 10
#: Tables of codes, at least; longer codes take more (see ``shape``).
CODES = 24
#: Probability that a pair at the threshold shares no bucket, at most.
MISS = 1e-4
#: Neighbours this much nearer than random are kept as stepping stones.
FLOOR = 0.8
#: Rounds in which lists are enlarged; more follow while links join components.
ROUNDS = 4
#: Rows that are compared with each other in one piece, and in a tile of the exact counts.
TILE = 1024
COUNT_TILE = 4096
SEED = 31

EDGE_SCHEMA = "a long, b long, score double"


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "score"])


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a spanning forest of a symmetric matrix of links."""
    parent = np.full(len(linked), -1)
    seen = ~linked.any(axis=1)
    for root in np.flatnonzero(~seen).tolist():
        if seen[root]:
            continue
        seen[root] = True
        reached = [root]
        while reached:
            v = reached.pop()
            new = np.flatnonzero(linked[v] & ~seen)
            seen[new], parent[new] = True, v
            reached += new.tolist()
    j = np.flatnonzero(parent >= 0)
    return parent[j], j


def best_of(ids: np.ndarray, x: np.ndarray, keep: int, floor: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best pairs of each vector of a small group, above ``floor``, and pairs that join all its links."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    m = min(keep, len(ids) - 1)
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    score = np.take_along_axis(s, top, axis=1)
    i, j = np.nonzero(score >= floor)
    j = top[i, j]
    linked = s >= threshold
    if (linked.sum(axis=1) > m).any():  # links that the lists don't hold
        p, q = forest(linked)
        i, j = np.append(i, p), np.append(j, q)
    return ids[i], ids[j], s[i, j]


def large_keys(ids: DataFrame) -> DataFrame:
    """(key, parts) of keys with over TILE rows; counted before vectors travel."""
    return few(ids.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).alias("parts")))


def grouped(rows: DataFrame, large: DataFrame, keep: int, threshold: float) -> DataFrame:
    """Best pairs above FLOOR within each key of (key, id, embedding); keys of ``large`` are split by a hash of the id."""
    sizes = large.withColumnRenamed("key", "__k")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0))
    split = rows.join(sizes, F.col("key") == F.col("__k"), "left").select(F.xxhash64("key", part).alias("piece"), "id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("piece",), 4096):
            piece, ids = table.column("piece").to_numpy(), table.column("id").to_numpy()
            x = unit(matrix(table.column("embedding")))
            head = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            out = [best_of(ids[lo:hi], x[lo:hi], keep, FLOOR, threshold) for lo, hi in zip(head.tolist(), np.append(head[1:], len(piece)).tolist(), strict=True) if hi - lo > 1]
            if out:
                a, b, s = (np.concatenate(v) for v in zip(*out, strict=True))
                m = a != b
                yield _edges(a[m], b[m], s[m])

    n = shuffle_partitions(rows.sparkSession)
    return split.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(freed(run), EDGE_SCHEMA)


def merged(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a", "b").agg(F.max("score").alias("score"))


def shape(total: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of tables for ``total`` vectors: the chance to miss a pair stays below MISS at every size."""
    bits = min(24, max(4, math.ceil(math.log2(max(total, 1) / 24 + 1))))
    met = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(CODES, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else CODES


def coded(nodes: DataFrame, total: int, threshold: float, vectors: bool) -> DataFrame:
    """(key, id, and embedding if ``vectors``): each node's bucket in each table."""
    bits, tables = shape(total, threshold)
    names = ["key", "id", "embedding"][: 3 if vectors else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(column(batch, "embedding"))
            if planes is None:
                planes = np.random.default_rng(SEED).normal(size=(tables, x.shape[1], bits))
            for t in range(tables):
                code = ((x @ planes[t]) > 0) @ (1 << np.arange(bits))
                key = mix(code.astype(U64) + U64(t << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(column(batch, c) for c in names[1:])], names=names)

    return nodes.select("id", "embedding").mapInArrow(freed(run), "key long, id long" + ", embedding array<double>" * vectors)


def seed_edges(nodes: DataFrame, total: int, threshold: float) -> DataFrame:
    return grouped(coded(nodes, total, threshold, True), large_keys(coded(nodes, total, threshold, False)), LIST, threshold)


def large_buckets(nodes: DataFrame, total: int, threshold: float) -> DataFrame:
    """(key, id) of the buckets that ``grouped`` doesn't compare as wholes."""
    rows = coded(nodes, total, threshold, False)
    return rows.join(rows.groupBy("key").count().where(F.col("count") > TILE), "key", "left_semi")


def across(edges: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Links among ``edges`` that join two components of ``found``."""
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    named = edges.where(F.col("score") >= threshold).join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "score")


def bucket_links(large: DataFrame, found: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links that join components of ``found`` within buckets (key, id), exactly: what lies outside a bucket's
    largest component meets all of it, in tiles."""
    named = large.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = named.groupBy("key").agg((F.min("component") < F.max("component")).alias("split")).where("split")
    rest = cut(named.join(split.select("key"), "key", "left_semi").withColumn("weight", F.lit(1)))
    placed = tiled_apart(rest, F.ceil(F.col("n") / TILE).cast("int")).select("piece", "tile", "other", "id", "component")
    rows = placed.join(nodes.select("id", "embedding"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            tile, other, ids, comp = (t.column(c).to_numpy() for c in ("tile", "other", "id", "component"))
            x = unit(matrix(t.column("embedding")))
            s = x @ x.T
            linked = (s >= threshold) & (comp[:, None] != comp[None, :])
            if tile.min() != tile.max():  # each tile meets itself elsewhere
                linked &= tile[:, None] != tile[None, :]
            i, j = forest(linked)
            if len(i):
                yield _edges(ids[i], ids[j], s[i, j])

    n = shuffle_partitions(nodes.sparkSession)
    return rows.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(freed(run), EDGE_SCHEMA)


def directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "score").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def lists(edges: DataFrame, threshold: float, size: int) -> DataFrame:
    """Each node's nearest known neighbours: LIST of them, ``size`` where LIST is full of links."""
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    full = F.sum((F.col("score") >= threshold).cast("int")).over(Window.partitionBy("a")) >= LIST
    out = directed(edges).withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).withColumn("full", full)
    return out.where(F.col("full") | (F.col("r") <= LIST)).select("a", "b", "score")


def descend(edges: DataFrame, nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """One round: at each node the vectors of its list and of those that list it are compared.

    A node gives each vector's ``size`` best pairs, and what joins all links there.
    """
    near = lists(edges, threshold, size)
    at = near.select(F.col("a").alias("key"), F.col("b").alias("id")).unionByName(near.select(F.col("b").alias("key"), F.col("a").alias("id"))).distinct()
    at = cut(at)
    rows = at.join(nodes.select("id", "embedding"), "id").select("key", "id", "embedding")
    return grouped(rows, large_keys(at), size, threshold)


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links) of members (component, id, n, embedding): exact, by pairs of tiles within components."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / COUNT_TILE).cast("int").alias("tiles"))
    tiled = members.join(size, "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    placed = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = placed.select(F.xxhash64("component", F.least("tile", "other"), F.greatest("tile", "other")).alias("piece"), "tile", "other", "id", "n", "embedding")

    def counts(ids: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(ids), 512):
            linked = (x[lo : lo + 512] @ y.T) >= threshold
            if same:
                linked[np.arange(len(linked)), lo + np.arange(len(linked))] = False
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 512]), pa.array(linked @ n, pa.int64())], names=["id", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            tile, ids, n = (t.column(c).to_numpy() for c in ("tile", "id", "n"))
            x = unit(matrix(t.column("embedding")))
            first = tile == tile.min()
            if first.all():
                other = int(t.column("other")[0].as_py())
                if other == tile[0]:
                    yield from counts(ids, x, x, n, True)
                continue
            yield from counts(ids[first], x[first], x[~first], n[~first], False)
            yield from counts(ids[~first], x[~first], x[first], n[first], False)

    parts = shuffle_partitions(members.sparkSession)
    return keyed.repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(freed(run), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``table`` (vec_id, embedding).

    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components link with nothing; nor do rows without vec_id. Equal vectors under several ids
    are links of each other; repeated rows count once as partners. Where a vec_id has several
    vectors they are one node, and each of its rows gets the least component and count. Other columns are
    not read, whatever their names; an empty table gives no rows.
    """
    rows = usable_rows(table)
    nodes = cut(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("n"), F.any_value("embedding").alias("embedding")))
    total = nodes.count()
    edges = cut(merged(seed_edges(nodes, total, threshold)))
    large = cut(large_buckets(nodes, total, threshold))
    linked = lambda: cut(components(edges.where(F.col("score") >= threshold).select("a", "b")))
    known, size, turn, found = edges.count(), LIST, 0, None
    while True:
        turn += 1
        size = min(2 * size, LIST << ROUNDS)
        edges = cut(merged(edges.unionByName(descend(edges, nodes, threshold, size))))
        now = edges.count()
        if now > known and turn < ROUNDS:
            known = now
            continue
        # lists have their full length: further links matter only where they join components
        if found is not None and across(edges, found, threshold).isEmpty():
            break
        found = linked()
        more = cut(bucket_links(large, found, nodes, threshold))
        if more.isEmpty():
            if now == known:
                break
        else:
            edges = cut(merged(edges.unionByName(more)))
            found = linked()
        known = edges.count()
    members = cut(found.join(nodes, "id"))
    counts = link_counts(members.select("component", "id", "n", "embedding"), threshold)
    of_node = nodes.select("h1", "h2", "id", "n").join(found, "id", "left").join(counts, "id", "left")
    of_node = of_node.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    placed = rows.select("vec_id", "h1", "h2").join(of_node, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    named = table.select("vec_id").join(placed.groupBy("vec_id").agg(F.min(F.struct("component_id", "n_links")).alias("x")).select("vec_id", "x.*"), "vec_id", "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))


def audit(table: DataFrame, result: DataFrame, threshold: float = 0.95, sample: int = 256) -> float:
    """Share of the true links of a bounded sample of vectors that ``result`` counts."""
    rows = usable_rows(table)
    some = rows.orderBy(F.xxhash64("vec_id")).limit(sample).select("vec_id", "embedding").collect()
    if not some:
        return 1.0
    ids, q = [r[0] for r in some], unit(np.array([r[1] for r in some], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = q @ unit(matrix(column(batch, "embedding"))).T
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((s >= threshold).sum(axis=1), pa.int64())], names=["vec_id", "n"])

    truth = rows.select("embedding").mapInArrow(freed(run), "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = truth.join(result, "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return (both[1] or 0) / both[0] if both[0] else 1.0


def op6(table: DataFrame) -> DataFrame:
    return near_duplicates(table)
