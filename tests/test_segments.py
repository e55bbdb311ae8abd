import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph as G
from strandlake.sources import sequences as SQ


def write(folder, n_files=2, seed=4):
    """FASTA files with sequences from none to many lines, in lines of different lengths; (file, rec, name, seq) of each."""
    r = random.Random(seed)
    made = []
    for f in range(n_files):
        parts = []
        for i in range(25):
            seq = "".join(r.choice("ACGTNacg") for _ in range(r.choice([0, 1, 5, 9, 60, 400, 3000])))
            name = f"s{f}-{i}"
            made.append((f"x{f}.fa", i, name, seq))
            width = r.choice([7, 60, 10000])
            parts.append(f">{name} {r.random()}\n" + "".join(seq[a : a + width] + r.choice(["\n", "\r\n", " \n"]) for a in range(0, len(seq), width)) + r.choice(["", "\n"]))
        (folder / f"x{f}.fa").write_text(("stray letters\n" if f else "") + "".join(parts))
    return made


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize(("k", "segment"), [(4, 50), (9, 13), (20, 1 << 16)])
def test_segments_join_to_the_records_and_give_their_windows(spark, tmp_path, small_blocks, k, segment):
    made = write(tmp_path)
    parts = SQ.read_fasta_segments(spark, str(tmp_path), k, segment).withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    found = {}
    for r in parts.orderBy("file", "rec_ord", "start").collect():
        seq = found.setdefault((r["file"], r["rec_ord"], r["name"]), [])
        assert r["start"] == sum(map(len, seq))
        seq.append(r["seq"])
    whole = {(f, i, n): s for f, i, n, s in made}
    assert {x: "".join(s) for x, s in found.items()} == whole
    for r in parts.collect():
        rest = whole[r["file"], r["rec_ord"], r["name"]][r["start"] + len(r["seq"]) :]
        assert r["halo"] == rest[:k]
    records = spark.createDataFrame(made, "file string, rec_ord long, name string, seq string")
    for rooted in (False, True):
        want = G.windows(records, k, fold=True, rooted=rooted, keep=("file", "rec_ord")).collect()
        got = G.segment_windows(parts, k, fold=True, rooted=rooted, keep=("file", "rec_ord")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_records_are_numbered_over_blocks(spark, tmp_path, small_blocks):
    made = write(tmp_path)
    got = sorted((r["file"].rsplit("/", 1)[1], r["rec_ord"], r["name"], r["seq"]) for r in SQ.read_fasta(spark, str(tmp_path / "x0.fa")).collect())
    assert got == sorted(x for x in made if x[0] == "x0.fa")
    text = "".join(f"{i},{i % 7}\n" for i in range(2000))
    (tmp_path / "rows.txt").write_text(text)
    rows = SQ.read_index_lists(spark, str(tmp_path / "rows.txt")).orderBy("row_id").collect()
    assert [(r["row_id"], r["colors"]) for r in rows] == [(i, sorted([i, i % 7])) for i in range(2000)]


def test_windows_of_large_record_numbers(spark):
    recs = spark.createDataFrame([(2**40 + 1, "AAAACGT"), (2**40, "AAAAGGT"), (-(2**62), "TTTTT")], "rec_ord long, seq string")
    occ = G.windows(recs, 4, keep=("rec_ord",))
    assert G.wide_order(recs)
    edges = G.build_edges(occ, G.occurrence_order(F.col("rec_ord"), F.col("pos"), True)).orderBy("edge_id").collect()
    want = "$$$$$ $$$$T $$$TT $$TTT $TTTT TTTTT TTTT$ $$$$A $$$AA $$AAA $AAAA AAAAG AAAGG AAGGT AGGT$ AAAAC AAACG AACGT ACGT$".split()
    assert [(r["edge_id"], r["kmer"]) for r in edges] == list(enumerate(want))
