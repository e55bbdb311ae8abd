import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing, sharding
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weight[s] / w >= 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weight[s] / w
            break
        for s in over:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2 * sizes[s]
            open_.discard(s)
    return target


def test_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    odd = spark.createDataFrame([(9001, None, "a b c"), (9002, None, "d"), (9003, "zz", None), (9004, "src1", " \t"), (9004, "src1", " \t")], docs.schema)
    both = docs.unionByName(odd)
    df = mixing.op4(both)
    rows, again = df.collect(), mixing.op4(both.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {(r["doc_id"]): (r["source"], len(plain.words(r["text"]))) for r in both.collect()}
    sizes, taken = {}, {}
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n
        assert 0 <= r["taken"] <= 2 * n
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + r["taken"]
    want = plain_targets(sizes)
    for r in rows:
        s = source[r["doc_id"]][0]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert mixing.op4(docs.limit(0)).collect() == []


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("block", F.lit("clash"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(count.values()) == 2
    assert {r["size"] for r in out.collect()} == {"clash"}


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "x"), (5, "é"), (5, "é")], docs.schema)
    both = docs.unionByName(odd)
    rows, again = sharding.op10(both).collect(), sharding.op10(both.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == both.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    assert set(slots) == set(range(16))
    assert {len(v) for v in slots.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    size = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (9001, 9002)}
    assert size == {9001: (1, 0), 9002: (1, 0)}
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(2, zlib.crc32(b"x"))}
    assert sharding.op10(docs.limit(0)).collect() == []


def test_matrix_margins_and_law():
    m = sharding.communication_matrix([5, 0, 9, 6], [7, 7, 6], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 6]
    assert m.sum(axis=0).tolist() == [7, 7, 6]
    first = [sharding.communication_matrix([10, 10], [10, 10], s)[0, 0] for s in range(2000)]
    assert abs(np.mean(first) - 5) < 0.15
    assert abs(np.var(first) - 10 * 0.25 * 10 / 19) < 0.2
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 10**9, 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(big) - 500) < 4


def test_shards_of_long_texts_clashing_columns_and_an_empty_table(spark):
    rows = [(i, "é" * 300_000 if i == 3 else f"t{i % 5}", "x", 1, 2) for i in range(40)] + [(None, None, "x", 1, 2), (7, "t2", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, size int")
    found = sharding.op10(docs).collect()
    assert len(found) == 42
    assert {r["size"] for r in found if r["doc_id"] == 3} == {600_001}
    assert [(r["size"], r["text_crc32"]) for r in found if r["doc_id"] is None] == [(1, 0)]
    per_shard = {}
    for r in found:
        per_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per_shard.values())
    assert max(map(len, per_shard.values())) - min(map(len, per_shard.values())) <= 1
    assert sharding.op10(docs.limit(0)).count() == 0
