import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import graph as G
from strandlake.operators import runs as RU


def code(t):
    return "".join(c if c in "ACGTN$" else "N" for c in t.translate(str.maketrans("acgtn", "ACGTN")))


def want(texts, plain, encoded):
    each = [(t, n) for t in texts for n in plain] + [(code(t), n) for t in texts for n in encoded]
    return {t[i : i + n] for t, n in each for i in range(len(t) - n + 1)}


def odd_texts():
    rng = random.Random(3)
    common, rare = "acgtACGTN$ \n\0xyzäéßÿþ", [chr(c) for c in (*range(0x4E00, 0x4F80), *range(0x1F600, 0x1F650), 0x10FFFF)]
    texts = ["".join(rng.choice(common) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["".join(rng.choice(rare if rng.random() < 0.3 else common) for _ in range(50)) for _ in range(200)]
    return texts + ["", "ACGTACG", "ACGTACGT", "abcdefgh" * 500, "😀" * 9, "a\0\0\0\0\0\0\0", "a\0\0\0\0\0\0\0\0", "ÿÿÿÿÿÿÿÿÿ"]


def test_distinct_runs(spark):
    """Each run once: of texts as they stand and encoded, of letters of all widths, more than eight at a time."""
    texts = odd_texts()
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "seq string").repartition(3)
    rows = [r["query"] for r in RU.distinct_runs(df, (8, 11), (8, 7)).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want(texts, (8, 11), (8, 7))


def test_folded_windows(spark):
    """The same as grouping windows by k-mer and colour; record numbers that repeat, are negative or missing, and colours that are missing."""
    texts = odd_texts()
    rows = [(None if i % 50 == 7 else (i % 90) - 5, None if i % 40 == 3 else f"c{i % 7}", t) for i, t in enumerate(texts)] + [(1, "c1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, seq string").repartition(3)
    slow = G.windows(df, 7, fold=True, keep=("doc_id", "source")).groupBy("kmer", "source").agg(F.min(G.occurrence_order(F.col("doc_id"), F.col("pos"))).alias("first"), F.count("*").alias("n"))
    fast = RU.folded_windows(df, 8, rec_ord="doc_id", name="source")
    assert fast.dtypes == slow.dtypes
    assert sorted(map(tuple, fast.collect()), key=repr) == sorted(map(tuple, slow.select(*fast.columns).collect()), key=repr)


def test_runs_fold_in_bounded_space(monkeypatch):
    """What a task holds is folded and given out as it fills up; nothing is lost, and a run that comes again and again is given out a few times only."""
    monkeypatch.setattr(RU, "HELD", 2000)
    rng = random.Random(4)
    fold, texts, out, most = RU.Folded(), [], [], 0
    for _ in range(60):
        t = "".join(rng.choice("acgt") for _ in range(900)) if rng.random() < 0.5 else "spam and eggs " * 60
        texts.append(t)
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        fold.put(points, np.array([0, len(points)]), 8)
        most = max(most, fold.held)
        if fold.full():
            out += fold.blobs()
    out += fold.blobs()
    got = [b[i : i + 8].decode() for _, _, b in out for i in range(0, len(b), 8)]
    assert set(got) == want(texts, (8,), ())
    assert most <= 2 * RU.HELD
    assert got.count("spam and") < 30


def test_queries_stay_where_edges_are_few(spark):
    """A short table of edges is broadcast, so that many queries are neither moved nor sorted."""
    recs = spark.createDataFrame([(0, "ATGCTCGCGCGCTCTCGCGCA")], "rec_ord long, seq string")
    e = G.build_edges(G.windows(recs, 9, keep=("rec_ord",)), G.occurrence_order(F.col("rec_ord"), F.col("pos")))
    q = spark.range(1000).select(F.concat(F.lit("TCGCGCGCT"), F.substring(F.lit("ACGT"), (F.col("id") % 4 + 1).cast("int"), F.lit(1))).alias("query"))
    found = G.map_kmers(q, e, 9)
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.where("edge_id = 14").count() == 250 and found.where("edge_id is null").count() == 750
