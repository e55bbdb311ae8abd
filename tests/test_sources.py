import gzip
import random
import struct

from pyspark.sql import functions as F

from strandlake.operators import graph as G
from strandlake.sources import binary, clustered
from strandlake.sources import sequences as SQ
from strandlake.sources import store as ST
from strandlake.sources import variants as V
from strandlake.streaming import growth

CONTIG = "ATGCTCGCGCGCTCTCGCGCA"


def vcf(tmp_path, name, rows, samples=""):
    p = tmp_path / name
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO" + (f"\tFORMAT\t{samples}" if samples else "")
    p.write_text("##fileformat=VCFv4.2\n" + head + "\n" + "\n".join("\t".join(r) for r in rows) + "\n")
    return str(p)


def test_variants_with_samples(spark, tmp_path):
    path = vcf(tmp_path, "a.vcf", [("test", "5", ".", "T", "G", ".", "PASS", "VT=SNP", "GT", "1|0", "0|1", "1|1", "0|0")], "A\tB\tC\tD")
    ref = spark.createDataFrame([("test", CONTIG)], "name string, seq string")
    for k, seq in ((3, "TGCGCGC"), (4, "ATGCGCGCG"), (5, "ATGCGCGCGC"), (16, "ATGCGCGCGCGCTCTCGCGCA")):
        r = V.variant_sequences(V.read_vcf(spark, path), ref, k).collect()
        assert [(x["seq"], x["colors"]) for x in r] == [(seq, ["test", "A", "B", "C"])]


def test_variants_with_info_and_copies(spark, tmp_path):
    info = ";".join(f"{x}={2 if x == 'AC_AMR' else 0}" for x in V.INFO_KEYS)
    path = vcf(tmp_path, "b.vcf", [("test", "5", ".", "T", "C", ".", "PASS", info), ("test", "5", ".", "T", "<CN2>,<CN4>", ".", "PASS", "."), ("test", "9", ".", "C", "A,<DEL>,G", ".", "PASS", "."), ("test", "9", ".", "C", "A", ".", "q10", ".")])
    ref = spark.createDataFrame([("test", CONTIG)], "name string, seq string")
    out = V.variant_sequences(V.read_vcf(spark, path), ref, 3)
    got = [(x["seq"], x["colors"]) for x in out.orderBy("rec", "allele").collect()]
    assert got == [("TGCCCGC", ["test", "AC_AMR"]), ("TGCTTCGC", ["test"]), ("TGCTTTTCGC", ["test"]), ("CGCACGC", ["test"])]
    joined = {r["color"]: r["seq"] for r in V.joined_by_color(out).collect()}
    assert joined["AC_AMR"] == "TGCCCGC"
    assert joined["test"] == "TGCCCGC$TGCTTCGC$TGCTTTTCGC$CGCACGC"


def test_genotypes(spark):
    df = spark.createDataFrame([(g,) for g in "1|0 0|1 1|1 0|2 2|3 .|1 0|0 0/1 1/1 0|3 0|4".split()], "g string")
    got = [r[0] for r in df.select(V.is_carrier(F.col("g"))).collect()]
    assert got == [True] * 6 + [False] * 5
    assert [r[0] for r in df.select(V.is_carrier(F.col("g"), "strict")).collect()] == [True, True, True, False, False, True, False, True, True, False, False]


def test_fasta_and_fastq(spark, tmp_path):
    fa = tmp_path / "x.fa"
    fa.write_text(">one|grp first\nACGT\nAC\n>two\n\n>three\nGG\r\nTT\r\n")
    got = [(r["rec_ord"], r["name"], r["seq"]) for r in SQ.read_fasta(spark, str(fa)).orderBy("rec_ord").collect()]
    assert got == [(0, "one|grp", "ACGTAC"), (1, "two", ""), (2, "three", "GGTT")]
    colors = [(r["name"], r["color"], r["is_prefix"]) for r in SQ.header_colors(SQ.read_fasta(spark, str(fa)), "|").orderBy("rec_ord", F.desc("is_prefix")).collect()]
    assert colors == [("one|grp", "|grp", True), ("one|grp", "one", False), ("two", "two", False), ("three", "three", False)]
    fq = tmp_path / "r.fastq.gz"
    with gzip.open(fq, "wt") as f:
        f.write("@r1 x\nACGT\n+\n@III\n@r2\nGGG\n+r2\nIII\n")
    rows = SQ.read_sequences(spark, [str(fa), str(fq)]).where("file_ord = 1").orderBy("rec_ord").collect()
    assert [(r["name"], r["seq"]) for r in rows] == [("r1", "ACGT"), ("r2", "GGG")]


def test_matrix_files(spark, tmp_path):
    (tmp_path / "i.txt").write_text("3,1\n\n64\n")
    lists = SQ.read_index_lists(spark, str(tmp_path / "i.txt"))
    assert [list(r["colors"]) for r in lists.orderBy("row_id").collect()] == [[1, 3], [], [64]]
    ST.write_index_lists(lists, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1,3", "", "64"]
    (tmp_path / "m.bin").write_bytes(struct.pack(">6Q", 2, 1, 5, 2, 0, 1))
    assert [list(r["colors"]) for r in binary.read_raw_matrix(spark, str(tmp_path / "m.bin")).orderBy("row_id").collect()] == [[0, 2], [64]]
    (tmp_path / "s.bin").write_bytes(struct.pack(">3Q", 0, 8, 2) + struct.pack(">3Q", 2, 1, 7) + b"ACGT\0" + struct.pack(">Q", 0) + b"GG\0")
    assert {(r["kmer"], tuple(r["colors"])) for r in binary.read_string_sets(spark, str(tmp_path / "s.bin")).collect()} == {("ACGT", (1, 7)), ("GG", ())}


def test_binary_tables_in_batches(spark, monkeypatch):
    """Rows of different widths and empty ones, more than a batch of them, no rows at all, bytes the other way round."""
    rng = random.Random(5)
    rows = [(i, sorted(rng.sample(range(200), rng.choice([0, 1, 7, 60])))) for i in range(300)]
    monkeypatch.setattr(binary, "BATCH_WORDS", 40)
    monkeypatch.setattr(binary, "BATCH_ROWS", 17)
    want = {(i, tuple(c)) for i, c in rows}
    df = spark.createDataFrame(rows, "row_id long, colors array<int>").repartition(3)
    files = binary.packed_matrix(df, 200, 64)
    got = binary.matrix_rows(files).withColumn("row_id", F.col("row_id") + 64 * F.substring("file", -3, 3).cast("int"))
    assert files.count() == 5 and {(r["row_id"], tuple(r["colors"])) for r in got.collect()} == want
    named = df.withColumn("kmer", F.concat(F.lit("k"), F.col("row_id").cast("string")))
    assert {(int(r["kmer"][1:]), tuple(r["colors"])) for r in binary.string_rows(binary.packed_strings(named, 200, [3, 9], 64)).collect()} == want
    assert binary.string_rows(binary.packed_strings(named, 200, [], 64), 2).count() == 10
    assert binary.matrix_rows(binary.packed_matrix(df.limit(0), 200)).collect() == []
    odd = spark.createDataFrame([("a", struct.pack("<7Q", 3, 0, 2, 1 << 63, 4, 1, 0)), ("b", struct.pack("<Q", 0))], "path string, content binary")
    assert [(r["file"], r["row_id"], list(r["colors"])) for r in binary.matrix_rows(odd, swap_bytes=True).orderBy("row_id").collect()] == [("a", 0, []), ("a", 1, [63, 66]), ("a", 2, [])]


def test_store_and_streamed_growth(spark, tmp_path):
    recs = [(0, "a", "ACGTACGTAA"), (1, "b", "ACGTTTT"), (2, "a", "GGGACGT")]
    schema = "rec_ord long, color string, seq string"
    for i, r in enumerate(recs):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    base = str(tmp_path / "graph")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = growth.start(spark, stream, base, str(tmp_path / "ckpt"), 3)
    q.processAllAvailable()
    q.stop()
    tables = clustered.tables(spark, base)
    df = spark.createDataFrame(recs, schema)
    occ = G.windows(df, 3, keep=("rec_ord", "color"))
    assert {r[0] for r in tables["edges"].select("kmer").collect()} == {r[0] for r in occ.select("kmer").collect()}
    assert sorted(r[0] for r in tables["edges"].select("edge_id").collect()) == list(range(tables["edges"].count()))
    named = tables["annotation"].join(tables["colors"], "color_id").select("kmer", F.col("name").alias("color"))
    assert {tuple(r) for r in named.collect()} == {tuple(r) for r in occ.select("kmer", "color").distinct().collect()}
    ids = tables["annotation"].join(tables["edges"], "kmer").select("edge_id", "color_id")
    ST.write_lines(G.wide(tables["edges"], ids), 2, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == tables["edges"].count()


def test_fasta_header_with_a_sign(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one maps a->b\nACGT\nAC>GT\n>two\nGG\n")
    got = [(r["rec_ord"], r["name"], r["seq"]) for r in SQ.read_fasta(spark, str(path)).orderBy("rec_ord").collect()]
    assert got == [(0, "one", "ACGTAC>GT"), (1, "two", "GG")]


def test_variants_as_segments_give_the_windows_of_joined_strings(spark):
    rng = random.Random(3)
    rows = [("f", i, a, "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 5, 30]))), ["c", *[x for x in "AB" if rng.random() < 0.3]]) for i in range(60) for a in range(rng.choice([1, 1, 3]))]
    found = spark.createDataFrame(rows, "file string, rec int, allele int, seq string, colors array<string>").repartition(3)
    joined = V.joined_by_color(found)
    for k, band in ((3, 2), (9, 7), (20, 4096)):
        want = G.windows(joined, k, rooted=True, keep=("color",)).groupBy("color", "kmer").count().collect()
        parts = V.joined_segments(found, k, band)
        got = G.segment_windows(parts, k, rooted=True, keep=("color", "rec", "allele"))
        assert sorted(map(tuple, got.groupBy("color", "kmer").count().collect())) == sorted(map(tuple, want))
        order = {r["color"]: r["seq"] for r in joined.collect()}
        text = {}
        for r in parts.orderBy("rec", "allele").collect():
            text[r["color"]] = text.get(r["color"], "") + r["seq"]
        assert text == order
