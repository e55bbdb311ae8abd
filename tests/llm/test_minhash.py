import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import minhash
from strandlake.llm.components import components
from tests.llm import plain

SCHEMA = "doc_id long, text string"


def test_against_plain_version(spark):
    rows = plain.corpus(2, 100)
    # a group whose members are near the threshold to each other
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(1, 12))):
            w[int(rng.integers(150))] = f"x{rng.integers(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op3(docs).collect()}
    assert got == plain.near_duplicates(dict(rows).items(), 4)


def test_buckets_as_wholes(spark):
    """All comparisons left to the second step give the same links."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        w = [f"t{j}" for j in range(100)]
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(100))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.col("doc_id"))
    sk = minhash.sketches(docs, 4)
    width = minhash.REGISTERS // minhash.BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(minhash.BANDS - 1)), lambda b: F.struct(F.xxhash64(b, F.substring(F.col("sketch"), b * width + 1, F.lit(width))).alias("key"), b.alias("band")))
    rest = sk.select(F.inline(keys), "id", F.col("id").alias("component"), "sketch", "n_shingles")
    comp = {r[0]: r[1] for r in components(minhash.links_across(rest, docs, 4, 80)).collect()}
    want = plain.near_duplicates(rows, 4)
    assert {d: comp.get(d, d) for d, _ in rows} == {d: c for d, (_, c, _) in want.items()}


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 3)
    test_buckets_as_wholes(spark)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 300)
    monkeypatch.setattr(minhash, "TILE", 1024)
    test_buckets_as_wholes(spark)


def test_one_of_each(spark):
    """Repeated and null ids, repeated rows, clashing columns, a long text."""
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, long = text(80), text(80), text(40_000)
    rows = [(None, a, 1), (None, a + " x", 2), (7, a, 3), (7, b, 4), (7, b, 4), (9, b + " y", 5), (10, None, 6), (11, "", 7), (12, long, 8), (13, long + " z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long").withColumn("lead", F.lit("clash")).withColumn("component", F.lit("clash"))
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(r["id"] for r in out.collect())
    assert got in ([1, 4, 6, 7, 8], [2, 4, 6, 7, 8])
    assert minhash.one_of_each(docs.limit(0)).collect() == []
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op3(docs).collect()}
    assert {(None, 77, None, True), (None, 78, None, True), (7, 77, None, False), (7, 77, 7, True), (9, 78, 7, False), (12, 39_997, 12, True), (13, 39_998, 12, False)} <= got


def test_edges_of_the_table(spark):
    assert minhash.op3(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, "A b\tC d e"), (5, "a b"), (6, "a b c"), (6, "a b c")]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in minhash.op3(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 2, -1, True), (1, 2, -1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 2, -1, False), (5, 1, 5, True), (6, 1, 6, True), (6, 1, 6, True)]


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = h[:2400], h[400:2800]
    x, y = minhash.registers(a), minhash.registers(b)
    assert (minhash.merged(x, y) == minhash.registers(h[:2800])).all()
    est = minhash.likely_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([2400.0]), np.array([2400.0]))
    assert abs(est[0] - 2000 / 2800) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (7, 7), (9, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3}
