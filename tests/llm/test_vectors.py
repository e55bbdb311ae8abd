import math
import tracemalloc
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import ann, embdedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[40:70] = x[40] + rng.normal(size=(30, 16)).astype(np.float32) * 0.08  # a group of near copies
    x[100:110] = x[100]  # equal vectors
    x[200] = x[201] * 2
    rows = [(i * 3, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(10**6, None, 0), (10**6 + 50, [0.0] * 16, 0), (10**6 + 100, [float("nan")] + [1.0] * 15, 0), (10**6 + 150, [1.0, None] + [1.0] * 14, 0), (10**6 + 200, [1.0] * 5, 0), (10**6 + 250, [], 0), (10**6 + 300, [float("inf")] * 16, 0)]
    ids = np.array([r[0] for r in rows])
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return spark.createDataFrame(rows + odd + rows[:3], SCHEMA), ids, u @ u.T


def test_nearest(spark):
    df, ids, s = table(spark)
    got = {}
    for r in ann.op2(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert set(got) == {int(ids[i]) for i in queries}
    hits = 0
    for i in queries:
        rows = sorted(got[int(ids[i])])
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        order = sorted((-s[i, j], int(ids[j])) for j in range(len(ids)) if j != i)[:5]
        hits += len({r[1] for r in rows} & {v for _, v in order})
        at = {int(v): k for k, v in enumerate(ids)}
        assert all(abs(r[2] - s[i, at[r[1]]]) < 1e-9 for r in rows)
        assert [r[1] for r in rows] == [v for _, v in sorted((-r[2], r[1]) for r in rows)]
    assert hits >= 0.9 * 5 * len(queries)


def test_ties_scale_and_clashing_columns(spark):
    """Many equal cosines go by id; huge and tiny vectors keep their direction; other columns don't matter."""
    base = np.array([1.0, 2.0, -3.0, 0.5])
    scaled = [(i, (base * (i * 0.37 + 0.1)).tolist()) for i in range(60)]
    far = [(1000 + i, [1.0, float(i), 2.0, 1.0]) for i in range(20)]
    huge = [(5000, [1e200, 0.0, 1e200, 0.0]), (5001, [1e-200, 0.0, 1e-200, 0.0]), (5002, [3.0, 0.0, 3.0, 0.0])]
    df = spark.createDataFrame(scaled + far + huge, "vec_id long, embedding array<double>")
    for clash in ("ids", "key", "score", "h1"):
        df = df.withColumn(clash, F.lit("x"))
    got = {}
    for r in ann.op2(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [v for v, _ in got[5000]][:2] == [5001, 5002]
    assert abs(got[5000][0][1] - 1) < 1e-12
    rows = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.op6(df).collect()}
    assert [rows[i] for i in (5000, 5001, 5002)] == [(2, 5000)] * 3
    assert all(rows[i] == (59, 0) for i in range(60))


def test_scores_are_not_rounded(spark):
    """Neighbours 1e-13 apart are ranked by their cosine, not by id; scores are the doubles next to the true cosines."""
    angles = {0: 0.0, 9: 0.5, 8: 0.5 + 2e-13, 7: 0.5 + 4e-13, 6: 0.5 + 6e-13}
    x = {i: [math.cos(a), math.sin(a), 0.0] for i, a in angles.items()} | {5: [0.0, 0.0, -3.0]}
    rows = ann.op2(spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [9, 8, 7, 6, 5]
    dot = lambda a, b: sum((Decimal(p) * Decimal(q) for p, q in zip(a, b, strict=True)), Decimal(0))
    with localcontext() as c:
        c.prec = 60
        assert [r["score"] for r in rows] == [float(dot(x[0], x[i]) / (dot(x[0], x[0]).sqrt() * dot(x[i], x[i]).sqrt())) for i in (9, 8, 7, 6, 5)]


def test_split_groups_and_recall(spark, monkeypatch):
    """Groups split on both sides give what whole ones give; recall on the driver's table."""
    df, _, _ = table(spark, 400)
    setting = ann.Setting(1, 3, 0.5)
    want = sorted(map(tuple, ann.nearest(df, setting=setting).collect()))
    monkeypatch.setattr(ann, "GROUP_ROWS", 37)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 3)
    assert sorted(map(tuple, ann.nearest(df, setting=setting).collect())) == want
    monkeypatch.undo()
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert ann.recall(vectors, ann.op2(vectors)) >= 0.95


def test_candidates_of_a_full_cell_in_bounded_memory():
    """A cell where 2,000 queries meet 6,000 rows (96 MB of scores), a third of them with equal cosines: the k nearest by cosine and id, in bounded memory."""
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(2000, 8)), rng.normal(size=(6000, 8))
    x[2000:4000] = x[0] * 2.0 ** rng.integers(-3, 4, 2000)[:, None]
    q[::2] = x[0] + rng.normal(size=(1000, 8)) * 0.01
    ids = [[int(i)] for i in rng.permutation(6000)]
    least = np.array([i[0] for i in ids])
    query = np.arange(2000) + 10**6
    tracemalloc.start()
    found = ann.Candidates(query, q, ids, x, 5)
    for lo in range(0, 6000, 2000):
        found.meet(np.arange(2000), lo, lo + 2000)
    rows = found.nearest()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 << 20
    got = {}
    for own, v, score in set(rows):
        got.setdefault(own, []).append((-score, v))
    for i in range(0, 2000, 37):
        exact = ann.cosines(np.repeat(q[i : i + 1], 6000, axis=0), x)
        order = np.lexsort((least, -exact))[:5]
        assert sorted(got[int(query[i])])[:5] == [(-float(exact[j]), int(least[j])) for j in order]


def test_few_or_no_vectors(spark):
    assert ann.op2(spark.createDataFrame([], SCHEMA)).collect() == []
    few = spark.createDataFrame([(50, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (7, [-1.0, 0.0], 1)], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.op2(few).orderBy("rank").collect()] == [(50, 1, 3), (50, 2, 7)]


def test_near_duplicates(spark):
    df, ids, s = table(spark)
    link = s >= 0.95
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.array([min(comp[i], comp[link[i]].min()) if link[i].any() else comp[i] for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp, strict=True)}
    rows = embdedup.op6(df).collect()
    assert len(rows) == len(ids) + 10
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert {k: v for k, v in got.items() if k < 10**6} == want
    assert all(v == (0, k, True) for k, v in got.items() if k >= 10**6)
    assert embdedup.audit(df.dropDuplicates(["vec_id"]), embdedup.op6(df.dropDuplicates(["vec_id"]))) == 1.0
    assert embdedup.op6(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bridged_groups(spark):
    """Two groups of 1050 near copies, 18.6 degrees apart, with one pair at 18.0 degrees."""
    rng = np.random.default_rng(5)
    angle = np.radians(np.repeat([0.0, 18.6], 1050))
    angle[7], angle[1050 + 11] = np.radians([0.3, 18.3])
    x = np.zeros((2100, 16))
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    x[:, 2:] = rng.normal(size=(2100, 14)) * 1e-4
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = (x @ turn).astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link[:1050, 1050:].sum() == 1
    rows = embdedup.op6(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == {i: (int(n), 0) for i, n in enumerate(link.sum(axis=1))}


def test_tables_follow_the_length_of_codes():
    for total in (1, 600, 51_000, 10**6, 10**7, 10**8, 10**10):
        bits, tables = embdedup.shape(total, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-4
