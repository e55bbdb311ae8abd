"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables cuts a number of Gaussian projections of the unit vector into cells of
WIDTH. A query visits the cells of each table in which a neighbour at the usual distance is
likeliest, given where the query lies in its own cell. All candidates met are scored by their
exact cosine on the original vectors.

How many projections and probes a table gets, and what the usual distance is, is fitted: some
queries (SAMPLE_QUERIES) are searched exactly, and of the settings in a small grid the one with
the fewest candidates is taken that meets RECALL of their neighbours. So codes grow longer where there are
more vectors or nearer neighbours; random directions, whose neighbours lie almost as far off as
anything else, need most of the table at any setting.

Index rows and probes meet in groups of a table and the leading cells of a code; groups are
split on both sides, so no task holds more than GROUP_ROWS index rows and GROUP_QUERIES
queries. Equal vectors are one index row with their few smallest ids. Inside a group scores are worked out a tile at a time and
only candidates that can still be among the nearest are held, so a task's memory doesn't follow what a cell holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import column, cut, few
from .vectors import cosines, matrix, unit, usable_rows

TABLES = 6
WIDTH = 2.0
#: Settings that are tried: projections, and probes in each table.
GRID = [(f, p) for f in (6, 8, 10, 12, 14, 16) for p in (30, 60, 120, 240, 480)]
#: Share of the sample's true neighbours that a setting must meet.
RECALL = 0.97
#: Queries searched exactly to choose a setting, and index rows (or components of them) that its candidates are counted on, at most.
SAMPLE_QUERIES = 64
SAMPLE_ROWS = 20_000
SAMPLE_COMPONENTS = 1 << 22
#: What a probe costs, in candidates.
PROBE_COST = 8
#: Cells of one projection are numbered -REACH..REACH, the outer ones being open.
REACH = 3
GROUP_ROWS = 20_000
GROUP_QUERIES = 16_384
#: Queries scored against everything at once where an exact pass is needed.
BLOCK = 2048
#: Scores worked out at once, candidates held before those that fell behind are dropped, and pairs whose exact score is worked out at once.
TILE = 1 << 19
HELD = 1 << 18
EXACT = 1 << 13
SEED = 29

_CELLS = 2 * REACH + 1
_normal = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])


@dataclass(frozen=True)
class Setting:
    """Projections of a table, probes in it, and the cosine that neighbours usually have."""

    functions: int = 8
    probes: int = 60
    target: float = 0.45


def family(dims: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(TABLES, functions, dims)), rng.uniform(0, WIDTH, (TABLES, functions))


def codes(x: np.ndarray, functions: int) -> np.ndarray:
    """Cell of each unit vector in each table: [tables, rows, functions]."""
    a, b = family(x.shape[1], functions)
    return np.stack([np.clip(np.floor((x @ a[t].T + b[t]) / WIDTH), -REACH, REACH).astype(np.int64) + REACH for t in range(TABLES)])


def packed(cells: np.ndarray) -> np.ndarray:
    return cells @ (_CELLS ** np.arange(cells.shape[-1], dtype=np.int64))


def probes(x: np.ndarray, setting: Setting) -> np.ndarray:
    """Packed cells to visit for each unit vector, likeliest first: [tables, rows, probes].

    Of each projection the three likeliest cells are combined, one projection after the other; the best ``probes``
    combinations of the first ones are all that the best of more can be made of.
    """
    a, b = family(x.shape[1], setting.functions)
    spread = math.sqrt(max(1 - setting.target**2, 1e-4))
    out = []
    rows = np.arange(len(x))[:, None]
    for t in range(TABLES):
        here = x @ a[t].T
        edges = np.arange(-REACH, REACH + 2)[None, None, :] * WIDTH - b[t][None, :, None]
        edges = np.broadcast_to(edges, (len(x), setting.functions, _CELLS + 1)).copy()
        edges[..., 0], edges[..., -1] = -1e9, 1e9
        p = np.diff(_normal((edges - setting.target * here[:, :, None]) / spread), axis=2)
        best = np.argsort(-p, axis=2, kind="stable")[:, :, :3]
        log = np.log(np.take_along_axis(p, best, axis=2) + 1e-300)
        score, cell = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for f in range(setting.functions):
            score = (score[:, :, None] + log[:, f, None, :]).reshape(len(x), -1)
            cell = (cell[:, :, None] + best[:, f, None, :] * _CELLS**f).reshape(len(x), -1)
            if score.shape[1] > setting.probes:
                top = np.argpartition(-score, setting.probes - 1, axis=1)[:, : setting.probes]
                score, cell = score[rows, top], cell[rows, top]
        order = np.argsort(-score, axis=1, kind="stable")
        got = cell[rows, order]
        if got.shape[1] < setting.probes:  # fewer combinations than probes
            got = np.concatenate([got, np.full((len(x), setting.probes - got.shape[1]), -1)], axis=1)
        out.append(got)
    return np.stack(out)


def met(q: np.ndarray, x: np.ndarray, owner: np.ndarray | None, functions: int, target: float, counts: list[int]) -> list[float]:
    """For each number of probes the share of rows ``x`` that queries ``q`` meet: of their own rows (``owner``), or of all."""
    visited, index = probes(q, Setting(functions, max(counts), target)), codes(x, functions)
    keys = np.stack([packed(index[t]) for t in range(TABLES)])
    shares = []
    for n in counts:
        hits = 0
        for i in range(len(q)):
            some = slice(None) if owner is None else np.flatnonzero(owner == i)
            hit = np.zeros(len(x[some]), bool)
            for t in range(TABLES):
                hit |= np.isin(keys[t][some], visited[t, i, :n])
            hits += int(hit.sum())
        shares.append(hits / max(1, len(x) * (len(q) if owner is None else 1)))
    return shares


def fitted(queries: DataFrame, classes: DataFrame, k: int, total: int) -> Setting:
    """The cheapest setting of GRID that meets RECALL of a sample's true neighbours; where none does, the one that meets most."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    if not some:
        return Setting()
    truth = ranked(exact_candidates(some, classes, k), k).select("query_id", "vec_id", "score")
    # vectors of SAMPLE_QUERIES * k neighbours
    near = classes.select(F.explode("ids").alias("vec_id"), "embedding").join(F.broadcast(truth), "vec_id").select("query_id", "score", "embedding").collect()
    if not near:
        return Setting()
    q = unit(np.array([r["embedding"] for r in some], np.float64))
    at = {r["vec_id"]: i for i, r in enumerate(some)}
    y = unit(np.array([r["embedding"] for r in near], np.float64))
    owner = np.array([at[r["query_id"]] for r in near])
    target = float(np.clip(np.median([r["score"] for r in near]), 0.05, 0.95))
    rows = max(256, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // q.shape[1]))
    share = F.pmod(F.xxhash64(F.lit(SEED), F.col("ids")[0]), F.lit(1_000_000)) < math.ceil(1e6 * rows / total)
    sample = classes.where(share).limit(2 * rows).select("embedding").toArrow().column("embedding")
    x = unit(matrix(sample)) if len(sample) else y
    by_functions: dict[int, list[int]] = {}
    for f, p in GRID:
        by_functions.setdefault(f, []).append(p)
    found = []
    for f, counts in by_functions.items():
        for p, recall_, cost in zip(counts, met(q, y, owner, f, target, counts), met(q[:16], x, None, f, target, counts), strict=True):
            found.append((recall_ < RECALL, -recall_ if recall_ < RECALL else cost * total + PROBE_COST * TABLES * p, f, p))
    _, _, f, p = min(found)
    return Setting(f, p, target)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """One row for equal vectors: (ids, the k+1 smallest in order, embedding)."""
    smallest = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("r", F.dense_rank().over(smallest)).where(F.col("r") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.any_value("embedding").alias("embedding")).drop("h1", "h2")


#: Scores by matrix products differ from the exact ones by less than this.
NEAR = 1e-9


def near_best(at_q: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates that the product's error leaves among the k+1 best of their query, in order of query and score; and each one's query's floor."""
    order = np.lexsort((-score, at_q))
    at_q, score = at_q[order], score[order]
    first = np.searchsorted(at_q, at_q, side="left")
    last = np.searchsorted(at_q, at_q, side="right")
    floor = score[np.minimum(first + k, last - 1)]  # one more than k: a query's own row may be among them
    keep = score >= floor - NEAR
    return order[keep], (last - first)[keep], floor[keep]


def best_rows(query: np.ndarray, q: np.ndarray, ids: list, x: np.ndarray, at_q: np.ndarray, at_x: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest (query, id, cosine) of each query among candidate pairs, ties by id.

    All candidates that the product's error leaves among the nearest get their exact score; of
    index rows that score alike those with the smallest ids are enough.
    """
    keep, _, _ = near_best(at_q, score, k)
    at_q, at_x = at_q[keep], at_x[keep]
    exact = np.concatenate([np.zeros(0), *(cosines(q[at_q[lo : lo + EXACT]], x[at_x[lo : lo + EXACT]]) for lo in range(0, len(at_q), EXACT))])
    least = np.fromiter((ids[j][0] for j in at_x), np.int64, len(at_x))
    order = np.lexsort((least, -exact, at_q))
    rank = np.arange(len(order)) - np.searchsorted(at_q[order], at_q[order], side="left")
    found: dict[int, list] = {}
    for r in order[rank <= k].tolist():
        own = int(query[at_q[r]])
        found.setdefault(int(at_q[r]), []).extend((-float(exact[r]), v, own) for v in ids[at_x[r]] if v != own)
    return [(own, v, -s) for rows in found.values() for s, v, own in sorted(set(rows))[:k]]


class Candidates:
    """Candidate pairs of queries ``q`` and index rows ``x``, of which only those that can be among the k nearest are held.

    Scores come in tiles of TILE at most. Below ``floor`` k+1 better ones of a query were met, and what lies there goes at
    once; if HELD / 2 pairs are left, as with many equal cosines, their k nearest are worked out and the rest goes. So memory
    is bounded however many rows and queries share a cell.
    """

    def __init__(self, query: np.ndarray, q: np.ndarray, ids: list, x: np.ndarray, k: int) -> None:
        self.query, self.q, self.ids, self.x, self.k = query, q, ids, x, k
        self.uq, self.ux = unit(q), unit(x)
        self.best = np.full((len(q), k + 1), -np.inf)
        self.floor = np.full(len(q), -np.inf)
        self.at_q: list[np.ndarray] = []
        self.at_x: list[np.ndarray] = []
        self.score: list[np.ndarray] = []
        self.held = 0
        self.out: list[tuple[int, int, float]] = []

    def meet(self, some: np.ndarray, lo: int, hi: int) -> None:
        """Queries ``some`` (each once) meet index rows lo to hi."""
        for a in range(lo, hi, 2048):
            b = min(a + 2048, hi)
            step = max(1, TILE // (b - a))
            for c in range(0, len(some), step):
                self._tile(some[c : c + step], a, b)

    def _tile(self, some: np.ndarray, a: int, b: int) -> None:
        s = self.uq[some] @ self.ux[a:b].T
        if s.size <= 4096:  # not worth a look at what falls behind
            self._hold(np.repeat(some, b - a), np.tile(np.arange(a, b), len(some)), s.ravel())
            return
        most = s.max(axis=1)
        better = np.flatnonzero(most > self.floor[some])
        if len(better):
            rows = s[better]
            if rows.shape[1] > self.k + 1:
                rows = np.partition(rows, rows.shape[1] - self.k - 1, axis=1)[:, -self.k - 1 :]
            both = np.concatenate([self.best[some[better]], rows], axis=1)
            both.sort(axis=1)
            self.best[some[better]] = both[:, -self.k - 1 :]
            self.floor[some[better]] = np.maximum(self.floor[some[better]], both[:, -self.k - 1])
        floor = self.floor[some] - NEAR
        left = np.flatnonzero(most >= floor)
        i, j = np.nonzero(s[left] >= floor[left, None])
        i = left[i]
        self._hold(some[i], a + j, s[i, j])

    def _hold(self, at_q: np.ndarray, at_x: np.ndarray, score: np.ndarray) -> None:
        self.at_q.append(at_q)
        self.at_x.append(at_x)
        self.score.append(score)
        self.held += len(score)
        if self.held > HELD:
            self._shrink()

    def _shrink(self) -> None:
        at_q, at_x, score = np.concatenate(self.at_q), np.concatenate(self.at_x), np.concatenate(self.score)
        some = np.flatnonzero(score >= self.floor[at_q] - NEAR)
        keep, met, floor = near_best(at_q[some], score[some], self.k)
        at_q, at_x, score = at_q[some][keep], at_x[some][keep], score[some][keep]
        enough = met > self.k
        self.floor[at_q[enough]] = np.maximum(self.floor[at_q[enough]], floor[enough])
        if len(score) > HELD // 2:
            self.out += best_rows(self.query, self.q, self.ids, self.x, at_q, at_x, score, self.k)
            at_q, at_x, score = at_q[:0], at_x[:0], score[:0]
        self.at_q, self.at_x, self.score, self.held = [at_q], [at_x], [score], len(score)

    def nearest(self) -> list[tuple[int, int, float]]:
        if self.held:
            self.out += best_rows(self.query, self.q, self.ids, self.x, np.concatenate(self.at_q), np.concatenate(self.at_x), np.concatenate(self.score), self.k)
        return self.out


PAIR_SCHEMA = "query_id long, vec_id long, score double"


def _pairs(rows: list[tuple[int, int, float]]) -> pa.Table:
    q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def hashed_candidates(queries: DataFrame, classes: DataFrame, k: int, setting: Setting, total: int) -> DataFrame:
    """Best candidates of each query in each group that it probes."""
    lead = min(setting.functions, max(1, math.ceil(math.log(max(total, 1) / GROUP_ROWS + 1, 2.5))))
    groups = _CELLS**lead

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = codes(unit(matrix(column(batch, "embedding"))), setting.functions)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(packed(c[t][:, :lead]) + t * groups), pa.array(packed(c[t])), column(batch, "ids"), column(batch, "embedding")], names=["g", "key", "ids", "embedding"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                cells = probes(unit(matrix(column(batch, "embedding"))), setting)
                g, row, keys = [], [], []
                for t in range(TABLES):
                    for i in range(batch.num_rows):
                        full = cells[t, i][cells[t, i] >= 0]
                        first = full % groups + t * groups
                        for one in np.unique(first):
                            g.append(int(one))
                            row.append(i)
                            keys.append(full[first == one].astype("<i8").tobytes())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), column(batch, "vec_id").take(take), column(batch, "embedding").take(take), pa.array(keys, pa.binary())], names=["g", "query_id", "embedding", "keys"])

    kind = classes.schema["embedding"].dataType.simpleString()
    indexed = classes.mapInArrow(index, f"g long, key long, ids array<long>, embedding {kind}")
    visits = queries.select("vec_id", "embedding").mapInArrow(visit, f"g long, query_id long, embedding {kind}, keys binary")
    size = lambda rows, most, name: rows.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = few(size(indexed, GROUP_ROWS, "parts").join(size(visits, GROUP_QUERIES, "blocks"), "g"))  # broadcast, so vectors move once
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int")).withColumn("block", each("blocks")).drop("parts", "blocks")
    right = visits.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", each("parts")).drop("parts", "blocks")

    def meet(rows: pa.Table, probing: pa.Table) -> pa.Table:
        if not rows.num_rows or not probing.num_rows:
            return _pairs([])
        key = rows.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        x, q = matrix(rows.column("embedding"))[order], matrix(probing.column("embedding"))
        ids = rows.column("ids").take(pa.array(order)).to_pylist()
        wanted = [np.frombuffer(b, "<i8") for b in probing.column("keys").to_pylist()]
        owner = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        flat = np.concatenate(wanted)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        cells = np.intersect1d(key, flat)
        bounds = [np.searchsorted(a, cells, side=s) for a in (key, flat) for s in ("left", "right")]
        found = Candidates(probing.column("query_id").to_numpy(), q, ids, x, k)
        for a, b, c, d in zip(*bounds, strict=True):
            found.meet(owner[c:d], a, b)
        return _pairs(found.nearest())

    return left.groupBy("g", "part", "block").cogroup(right.groupBy("g", "part", "block")).applyInArrow(meet, PAIR_SCHEMA)


def exact_candidates(queries: list, classes: DataFrame, k: int) -> DataFrame:
    """Best candidates of a few queries (BLOCK at most, as (id, vector)) among all vectors."""
    ids_q = np.array([r[0] for r in queries], np.int64)
    q = np.array([r[1] for r in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x = matrix(column(batch, "embedding"))
                found = Candidates(ids_q, q, column(batch, "ids").to_pylist(), x, k)
                found.meet(np.arange(len(q)), 0, len(x))
                yield from _pairs(found.nearest()).to_batches()

    return classes.mapInArrow(run, PAIR_SCHEMA)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, k: int = 5, every: int = 50, setting: Setting | None = None) -> DataFrame:
    """The k nearest found of each vector whose vec_id is divisible by ``every``.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; rows
    without vec_id neither. Scores are cosines as doubles, not rounded further; where these are equal the smaller vec_id comes first; equal rows count once; where a vec_id has several vectors each
    is a query and the answers are merged; other columns are not read; an empty
    table gives no rows. A query that finds fewer than k is scored against everything.
    """
    rows = usable_rows(table)
    stored = table.schema["embedding"].dataType
    if isinstance(stored, ArrayType) and isinstance(stored.elementType, FloatType):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))  # as they came: half of what is shipped
    classes = cut(vector_classes(rows, k))
    queries = cut(rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "h1", "h2").dropDuplicates(["vec_id", "h1", "h2"]).drop("h1", "h2"))
    total = classes.count()
    setting = setting or fitted(queries, classes, k, total)
    found = cut(hashed_candidates(queries, classes, k, setting, total))
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(enough, "vec_id", "left_anti").orderBy("vec_id")
    while block := short.limit(BLOCK).collect():
        found = found.unionByName(exact_candidates(block, classes, k))
        if len(block) < BLOCK:
            break
        short = short.where(F.col("vec_id") > block[-1]["vec_id"])
    return ranked(found, k)


def recall(table: DataFrame, result: DataFrame, k: int = 5, every: int = 50, sample: int = 256) -> float:
    """Share of the true k nearest that ``result`` has, over ``sample`` queries."""
    rows = usable_rows(table)
    some = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id")).limit(sample).select("vec_id", "embedding").collect()
    if not some:
        return 1.0
    truth = ranked(exact_candidates(some, vector_classes(rows, k), k), k)
    hits = truth.join(result.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(truth.count(), 1)


def op2(table: DataFrame) -> DataFrame:
    return nearest(table)
