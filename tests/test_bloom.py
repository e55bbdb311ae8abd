import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import bloom_math as B
from strandlake.operators import bloom as BL
from strandlake.operators import graph as G

SEQS = [
    "GGCTTTGTAGCTAACTCTCGGGTTTGTCGAACGGTTGCCAAACTTGCTGGCAATGGGTCCACTGCTACGTCTATTATGGTACGACAGCTGCTGATATTGG",
    "TTCAGACTATCGCCCAAATATAAAAGACCATCGGTGTCTAGGCTTTGTAGCTAACTCTCGGGTTTGTCGAACGGTTGCCAAACTTGCTGGCAATGGGTCC",
    "CGTTTAGCGTCCCTTCCTACCGTAGTTCGTATGATTTGAGGCAGTGCGGGCAATCGACGTGTGTCGAGTTCCCACTTCAGCAGCACGCGTTGCTAGGGTACCAGAATGTAAGGCTCCGGC",
    "GGCTTTGTAGCTAACTCTCGGGTTTGTCGAACGGTTGCCAAACTTGCTGGCAATGGGTCC",
]
K = 5


@pytest.fixture(scope="module")
def graph(spark):
    recs = spark.createDataFrame([(i, i, s) for i, s in enumerate(SEQS)], "rec_ord long, color_id int, seq string")
    occ = G.windows(recs, K, keep=("rec_ord", "color_id"))
    edges = G.build_edges(occ, G.occurrence_order(F.col("rec_ord"), F.col("pos"))).persist()
    inner = G.windows(recs, K, rooted=True, keep=("rec_ord", "color_id")).persist()
    exact = inner.select("kmer", "color_id").distinct().join(edges, "kmer").select("edge_id", "color_id").persist()
    return edges, inner, exact


@pytest.mark.parametrize(
    ("bits", "h", "raw_n", "raw_fp", "cut2", "cut2_fp", "cut50", "cut50_fp"),
    [(1.4427, 1, 675, 315, 396, 36, 375, 15), (6.2352, 5, 389, 29, 360, 0, 360, 0)],
)
def test_correction_goldens(spark, graph, bits, h, raw_n, raw_fp, cut2, cut2_fp, cut50, cut50_fp):
    edges, inner, exact = graph
    assert edges.count() == 267
    assert exact.count() == 360
    meta = BL.sizes(inner, bits, h)
    found = BL.probe(edges.where(~F.col("kmer").contains("$")).select("kmer"), meta, BL.build(inner, meta))
    raw = found.join(edges, "kmer").select("edge_id", "color_id").persist()
    truth = {tuple(r) for r in exact.collect()}
    pairs = {tuple(r) for r in raw.collect()}
    assert truth <= pairs
    assert (len(pairs), len(pairs - truth)) == (raw_n, raw_fp)
    for cutoff, n, fp in ((0, raw_n, raw_fp), (2, cut2, cut2_fp), (50, cut50, cut50_fp)):
        fixed = {tuple(r) for r in BL.corrected(edges, raw, K, cutoff).collect()}
        assert truth <= fixed <= pairs
        assert (len(fixed), len(fixed - truth)) == (n, fp)
    report = BL.evaluation(edges, exact, raw, BL.corrected(edges, raw, K)).first()
    assert (report["n_edges"], report["n_bits_exact"], report["fp_bits_pre"], report["fp_bits_post"], report["fn_bits_post"]) == (248, 360, raw_fp, cut50_fp, 0)


def test_one_way_correction_keeps_truth(spark, graph):
    edges, inner, exact = graph
    meta = BL.sizes(inner, 3.9486, 3)
    raw = BL.probe(edges.where(~F.col("kmer").contains("$")).select("kmer"), meta, BL.build(inner, meta)).join(edges, "kmer").select("edge_id", "color_id").persist()
    fixed = {tuple(r) for r in BL.corrected_one_way(edges, raw, K, 1).collect()}
    assert {tuple(r) for r in exact.collect()} <= fixed <= {tuple(r) for r in raw.collect()}


def test_chains_of_a_cycle(spark):
    seq = "AACAGATCCG"
    edges = G.windows(spark.createDataFrame([(0, seq + seq[:4])], "rec_ord long, seq string"), 4, rooted=True, keep=("rec_ord",))
    e = G.build_edges(edges, G.occurrence_order(F.col("rec_ord"), F.col("pos")))
    rows = BL.chains(e, 4).orderBy("place").collect()
    assert len(rows) == len(seq)
    assert all(r["cyclic"] for r in rows)
    assert [r["place"] for r in rows] == list(range(len(seq)))


def test_sizes():
    for p, bits, h in ((0.01, 9.5851, 7), (0.05, 6.2352, 5), (0.15, 3.9486, 3), (0.45, 1.6620, 2), (0.5, 1.4427, 1)):
        got = B.by_rate(p)
        assert (round(got[0], 4), got[1]) == (bits, h)
    for bits, h, p in ((0.4, 1, 0.82516), (5, 4, 0.09051), (10, 7, 0.00819)):
        got = B.by_bits(bits)
        assert (got[1], round(got[2], 5)) == (h, p)
    with pytest.raises(ValueError, match="hash"):
        B.by_bits(5, 0)


def walked(rows, links, starts, cutoff):
    """Plain walks: (colours, steps) of each start; ``links`` has (before, after) and the edges entered by one way."""
    before, after, entered = links
    out = {}
    for e in starts:
        cur, steps = rows.get(e, frozenset()), 0
        for ways, forward in ((after, True), (before, False)) if cur else ():
            at, quiet = e, 0
            while quiet < cutoff and (forward or at in entered):
                quiet, steps = quiet + 1, steps + 1
                at = ways.get(at)
                new = cur & rows.get(at, frozenset())
                if not new:
                    break
                if new != cur:
                    cur, quiet = new, 0
        out[e] = (sorted(cur), steps)
    return out


@pytest.mark.parametrize(("segment", "cutoff"), [(3, 50), (8, 3), (4096, 1)])
def test_segments_and_steps_equal_plain_walks(spark, segment, cutoff):
    rng = np.random.default_rng(cutoff)
    line, ring = "".join(rng.choice(list("ACGT"), 70)), "".join(rng.choice(list("ACGT"), 41))
    recs = spark.createDataFrame([(0, line), (1, line[20:45] + "GG"), (2, line[40:])], "rec_ord long, seq string")
    occ = G.windows(recs, 6, keep=("rec_ord",)).unionByName(G.windows(spark.createDataFrame([(3, ring + ring[:6])], recs.schema), 6, rooted=True, keep=("rec_ord",)))
    edges = G.build_edges(occ, G.occurrence_order(F.col("rec_ord"), F.col("pos"))).persist()
    d = {r["edge_id"]: r for r in G.degrees(edges, 6).collect()}
    ids = {r["kmer"]: r["edge_id"] for r in edges.collect()}
    solid = [e for kmer, e in ids.items() if "$" not in kmer]
    entered = {e for e in solid if d[e]["out_degree"] == 1 and d[e]["in_degree"] == 1}
    after = {r["edge_id"]: r["next_id"] for r in G.next_edges(edges.where(~F.contains("kmer", F.lit("$"))), 6).collect() if r["next_id"] in entered}
    before = {b: a for a, b in after.items()}
    pairs = [(e, c) for e in solid for c in range(4) if rng.random() < (0.97 if c < 2 else 0.8)]
    rows = {}
    for e, c in pairs:
        rows.setdefault(e, set()).add(c)
    raw = spark.createDataFrame(pairs, "edge_id long, color_id int")
    want = walked({e: frozenset(c) for e, c in rows.items()}, (before, after, entered), solid, cutoff)
    got = {r["edge_id"]: (list(r["colors"]), r["steps"]) for r in BL.corrected_rows(edges, raw, 6, cutoff, segment=segment).collect()}
    assert got == want
    some = spark.createDataFrame([(e,) for e in solid[::7]], "edge_id long")
    got = {r["edge_id"]: (list(r["colors"]), r["steps"]) for r in BL.corrected_rows(edges, raw, 6, cutoff, some, segment).collect()}
    assert got == {e: want[e] for e in solid[::7]}


def test_sampled_evaluation_counts_steps(spark, graph):
    edges, inner, exact = graph
    meta = BL.sizes(inner, 1.4427, 1)
    raw = BL.probe(edges.where(~F.col("kmer").contains("$")).select("kmer"), meta, BL.build(inner, meta)).join(edges, "kmer").select("edge_id", "color_id").persist()
    report = BL.evaluated(edges, exact, raw, K, 267).first()
    assert (report["n_edges"], report["fp_bits_pre"], report["fp_bits_post"], report["fn_bits_post"]) == (248, 315, 15, 0)
    assert report["n_steps"] > 248
    few = BL.evaluated(edges, exact, raw, K, 20, 2, both=False).first()
    assert few["n_edges"] == sum("$" not in r["kmer"] for r in edges.collect() if r["edge_id"] % 13 == 0)
    assert few["fn_bits_post"] == 0 and few["n_steps"] > 0


def test_probes_ask_sizes_and_not_colours(spark):
    rows = [(f"{i:05d}", c) for i in range(120) for c in range(40) if (i * 7 + c) % 5 == 0]
    pairs = spark.createDataFrame(rows, "kmer string, color_id int")
    meta = BL.sizes(pairs, 12.0, 5, ladder=True)
    assert meta.select("n_bits").distinct().count() < 4
    bits = BL.build(pairs, meta)
    found = BL.probe(pairs.select("kmer"), meta, bits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {tuple(r) for r in found.collect()}
    assert set(rows) <= got
    have, sizes = {(r["color_id"], r["bit"]) for r in bits.collect()}, {r["color_id"]: r["n_bits"] for r in meta.collect()}
    hashed = {(r[0], r[1]): r[2] for r in pairs.select("kmer").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("kmer", "j", B.portable_hash(F.col("kmer"), F.col("j"))).collect()}
    assert got == {(k, c) for k in {k for k, _ in hashed} for c in sizes if all((c, hashed[k, j] % sizes[c]) in have for j in range(5))}
    some = {tuple(r) for r in BL.probe(pairs.select("kmer"), meta, bits, colors=(3, 7)).collect()}
    assert some == {x for x in got if x[1] in (3, 7)}
    assert BL.probe(pairs.select("kmer"), meta.limit(0), bits).count() == 0
