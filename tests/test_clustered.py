from pathlib import Path

from pyspark.sql import functions as F

from strandlake.operators import graph as G
from strandlake.sources import clustered
from strandlake.streaming import growth

SCHEMA = "rec_ord long, color string, seq string"
K = 5


def text(seed, n):
    return "".join("ACGT"[(i * i * seed + i // 3 + seed) % 7 % 4] for i in range(n))


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def grown(spark, base, batches, buckets=8):
    for v, rows in enumerate(batches):
        growth.grow(spark, base, spark.createDataFrame(rows, SCHEMA), v, K, buckets=buckets)


def whole(spark, rows):
    """k-mers in order of first occurrence with their colours' names."""
    occ = G.windows(spark.createDataFrame(rows, SCHEMA), K, keep=("rec_ord", "color"))
    edges = G.build_edges(occ, G.occurrence_order(F.col("rec_ord"), F.col("pos")))
    named = {}
    for r in occ.select("kmer", "color").distinct().collect():
        named.setdefault(r["kmer"], set()).add(r["color"])
    return [(r["kmer"], named[r["kmer"]]) for r in edges.orderBy("edge_id").collect()]


def state(spark, base):
    t = clustered.tables(spark, base)
    named = {}
    for r in t["annotation"].join(t["colors"], "color_id").collect():
        assert r["name"] not in named.setdefault(r["kmer"], set())
        named[r["kmer"]].add(r["name"])
    edges = t["edges"].orderBy("edge_id").collect()
    assert [r["edge_id"] for r in edges] == list(range(len(edges)))
    return [(r["kmer"], named[r["kmer"]]) for r in edges]


def test_deltas_make_the_graph_and_compaction_keeps_it(spark, tmp_path):
    batches = [[(0, "a", text(1, 300)), (1, "b", text(2, 40))], [(2, "a", text(3, 200)), (3, "c", text(1, 100)), (4, "c", "AC")], [(5, "b", text(1, 300))]]
    base = str(tmp_path / "g")
    grown(spark, base, batches)
    want = whole(spark, [r for b in batches for r in b])
    assert state(spark, base) == want
    growth.grow(spark, base, spark.createDataFrame(batches[2], SCHEMA), 2, K)  # run again after a failure
    assert state(spark, base) == want
    clustered.compact(spark, base)
    assert [r["full"] for r in clustered.versions(spark, base)] == [True]
    assert state(spark, base) == want
    growth.grow(spark, base, spark.createDataFrame([(9, "z", text(5, 90))], SCHEMA), 3, K)
    assert state(spark, base) == whole(spark, [r for b in batches for r in b] + [(9, "z", text(5, 90))])


def test_a_batch_writes_what_it_adds(spark, tmp_path):
    base = str(tmp_path / "g")
    import random

    letters = "".join(random.Random(1).choice("ACGT") for _ in range(60_000))
    grown(spark, base, [[(0, "a", letters)], [(1, "a", letters)], [(2, "b", letters[:30])]])
    first, again, small = (size(f"{base}/edges/delta-{v}") + size(f"{base}/annotation/delta-{v}") for v in range(3))
    assert again == 0
    assert small < first / 2
    assert clustered.tables(spark, base)["annotation"].count() > clustered.tables(spark, base)["edges"].count()


def test_lookups_read_the_files_of_their_buckets(spark, tmp_path):
    base = str(tmp_path / "g")
    grown(spark, base, [[(0, "a", text(1, 500))], [(1, "b", text(2, 500)), (2, "a", text(2, 60))]], buckets=16)
    truth = {kmer: (i, names) for i, (kmer, names) in enumerate(state(spark, base))}
    asked = [text(1, 500)[7:13], text(2, 500)[20:26], "NNNNNN", "ACG", None]
    found = clustered.looked_up(spark, base, spark.createDataFrame([(q, 1) for q in asked], "query string, edge int"))
    got = {r["query"]: (r["edge_id"], set(r["color_names"])) for r in found.collect()}
    assert got == {q: truth.get(q, (None, set())) for q in asked}
    one = clustered.looked_up(spark, base, spark.createDataFrame([(asked[0],)], "query string"))
    one.collect()
    scans = [line for line in one._jdf.queryExecution().toString().splitlines() if "FileScan" in line and "bucket" in line]
    assert scans and all("PartitionFilters: [" in line and f"(bucket#" in line for line in scans)
    assert all("In(kmer" in line or "EqualTo(kmer" in line for line in scans)
    files = clustered.tables(spark, base)["edges"].where(F.col("bucket") == clustered.bucket(F.lit(asked[0]), 16)).select(F.input_file_name().alias("f")).distinct()
    assert {r["f"].split("bucket=")[1].split("/")[0] for r in files.collect()} == {str(spark.range(1).select(clustered.bucket(F.lit(asked[0]), 16)).first()[0])}
    many = spark.createDataFrame([(k,) for k in truth], "query string")
    assert {r["query"]: r["edge_id"] for r in clustered.looked_up(spark, base, many).collect()} == {k: i for k, (i, _) in truth.items()}
