from pyspark.sql import functions as F

from strandlake.plans import commands as CM

CONTIG = "ATGCTCGCGCGCTCTCGCGCA"


def test_from_files_to_answers(spark, tmp_path):
    fa, fb = tmp_path / "a.fa", tmp_path / "b.fa"
    fa.write_text(f">one|x\n{CONTIG}\n>two|x\nACGTACGTACGTTT\n")
    fb.write_text(">two\nACGTACGTACCC\n>three\nTTTTGGGGAAAA\n")
    vcf = tmp_path / "v.vcf"
    vcf.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\nref\t5\t.\tT\tG\t.\tPASS\tVT=SNP\tGT\t1|0\n")
    ref = tmp_path / "ref.fa"
    ref.write_text(f">ref\n{CONTIG}\n")
    base = str(tmp_path / "g")
    CM.build(spark, [str(fa), str(vcf)], base, 4, reference=str(ref), delimiter="|", fpp=0.05)
    got = {r["query"]: r for r in CM.map_kmers(spark, base, ["ATGCT", "ACGTA", "TGCGC", "AAAAA", "ACG"]).collect()}
    assert got["ATGCT"]["colors"].split(",") == ["|x", "one"]
    assert got["ACGTA"]["colors"].split(",") == ["|x", "two"]
    assert got["TGCGC"]["colors"].split(",") == ["ref", "A"]
    assert got["AAAAA"]["edge_id"] is None and got["AAAAA"]["words"] == "" and got["ACG"]["edge_id"] is None
    exact = {r["query"]: set(r["colors"].split(",")) for r in CM.map_kmers(spark, base, ["ATGCT", "ACGTA"]).collect()}
    fuzzy = {r["query"]: set(r["colors"].split(",")) for r in CM.map_kmers(spark, base, ["ATGCT", "ACGTA"], bloom=True).collect()}
    assert all(exact[q] <= fuzzy[q] for q in exact)
    assert CM.evaluate(spark, base).first()["fn_bits_post"] == 0
    CM.compress(spark, base)
    s = CM.stats(spark, base).first()
    assert s["n_cols"] == 5
    assert CM.query(spark, base).agg(F.sum(F.size("colors"))).first()[0] == s["set_bits"]
    assert CM.permutation(spark, base, 2).count() == 3
    out = str(tmp_path / "g2")
    CM.update(spark, base, [str(fb)], out)
    more = {r["query"]: r["colors"] for r in CM.map_kmers(spark, out, ["ACGTA", "TTTTG"]).collect()}
    assert more == {"ACGTA": "|x,two", "TTTTG": "three"}
    bits = spark.read.parquet(f"{out}/bloom_meta").join(spark.read.parquet(f"{out}/colors"), "color_id").where("name = 'three'").first()
    assert (bits["n_bits"], bits["num_hash"]) == (54, 5)  # 8 windows of 6.24 bits, and the next size of the ladder
    sample = CM.evaluate(spark, out, n=10, both=False).first()
    assert sample["fn_bits_post"] == 0 and 0 < sample["n_edges"] <= 20
    edges = spark.read.parquet(f"{out}/edges")
    assert sorted(r[0] for r in edges.select("edge_id").collect()) == list(range(edges.count()))
    assert CM.evaluate(spark, out).first()["fn_bits_post"] == 0
    exact = {r["query"]: set(r["colors"].split(",")) for r in CM.map_kmers(spark, out, ["ACGTA", "TTTTG"], bloom=True).collect()}
    assert {"|x", "two"} <= exact["ACGTA"] and "three" in exact["TTTTG"]
    assert CM.query(spark, out).count() == edges.count()
