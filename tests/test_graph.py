import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import graph as G


def build(spark, seqs, k):
    recs = spark.createDataFrame(list(enumerate(seqs)), "rec_ord long, seq string")
    occ = G.windows(recs, k, keep=("rec_ord",))
    return G.build_edges(occ, G.occurrence_order(F.col("rec_ord"), F.col("pos")))


@pytest.mark.parametrize(("k", "edges", "solid", "out_many", "in_many"), [(3, 16, 11, 5, 6), (4, 19, 13, 5, 4), (9, 23, 12, 0, 0)])
def test_contig_counts(spark, k, edges, solid, out_many, in_many):
    e = build(spark, ["ATGCTCGCGCGCTCTCGCGCA"], k)
    d = G.degrees(e, k).collect()
    assert len(d) == edges
    real = [r for r in d if "$" not in r["kmer"]]
    assert len(real) == solid
    assert sum(r["out_degree"] > 1 for r in real) == out_many
    assert sum(r["in_degree"] > 1 for r in real) == in_many


def test_queries_on_contig(spark):
    e = build(spark, ["ATGCTCGCGCGCTCTCGCGCA"], 9)
    q = spark.createDataFrame([("TCGCGCGCTA",), ("TCGCGCGCTC",), ("TCGCGCGCTN",), ("TCGCGCGCTANA",)], "query string")
    got = {r["query"]: (r["valid"], r["edge_id"]) for r in G.map_kmers(q, e, 9).collect()}
    assert got == {"TCGCGCGCTA": (True, None), "TCGCGCGCTC": (True, 14), "TCGCGCGCTN": (True, None), "TCGCGCGCTANA": (False, None)}


def test_edges_in_first_seen_order(spark):
    e = build(spark, ["AAAACGT", "AAAAGGT"], 4)
    got = [r["kmer"] for r in e.orderBy("edge_id").collect()]
    assert got == "$$$$$ $$$$A $$$AA $$AAA $AAAA AAAAC AAACG AACGT ACGT$ AAAAG AAAGG AAGGT AGGT$".split()
    assert [r["edge_id"] for r in e.orderBy("edge_id").collect()] == list(range(13))


@pytest.mark.parametrize("k", [5, 11, 29])
def test_traversal_visits_neighbours(spark, k):
    seq = "".join("ACGT"[i * 199 % 163 % 4] for i in range(3 * k // 2 + 1))
    e = build(spark, [seq], k).persist()
    n = e.count()
    nxt = {r[0]: r[1] for r in G.next_edges(e, k).collect()}
    prv = {r[0]: r[1] for r in G.previous_edges(e, k).collect()}
    assert all(nxt[i] == i + 1 for i in range(1, n - 1))
    assert all(prv[i] == i - 1 for i in range(2, n))


def test_long_sequences_are_chunked(spark):
    seq = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1500))
    recs = spark.createDataFrame([(0, seq), (1, "ACG"), (2, None), (3, "")], "rec_ord long, seq string")
    got = {(r["pos"], r["kmer"]) for r in G.windows(recs, 7, keep=("rec_ord",)).collect()}
    padded = "$" * 8 + seq + "$"
    assert got == {(i, padded[i : i + 8]) for i in range(len(padded) - 7)}


def test_scalars(spark):
    df = spark.createDataFrame([("acGTUNx", "b.VCF.gz"), ("$AC", "x.gz"), ("", "reads.fq")], "s string, f string")
    got = df.select(S.encode(F.col("s")), S.encode(F.col("s"), True), S.reverse_complement(F.col("s")), S.file_type(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("NNGTNNN", "ACGTNNN", "xNAACgt", "VCF"), ("$AC", "$AC", "GT$", ""), ("", "", "", "FASTQ")]
    pairs = [("ACG", "TCG", 1), ("ACG", "TCG", 0), ("ACG", "CG", 0), ("ACG", "TTT", 3)]
    eq = spark.createDataFrame(pairs, "a string, b string, s int").select(S.suffix_equal(F.col("a"), F.col("b"), F.col("s")), S.colex_greater(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in eq] == [(True, False), (False, False), (False, True), (True, False)]


def test_dense_ids_of_clustered_and_negative_values(spark):
    for values in (range(10**9, 10**9 + 3000), [-5, 7, 2**62, -(2**62), 0], []):
        df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
        got = [(r["v"], r["i"]) for r in G.dense_ids(df, "v", "i").orderBy("i").collect()]
        assert got == [(v, i) for i, v in enumerate(sorted(values))]
