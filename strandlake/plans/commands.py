"""Whole jobs over sequence files and saved tables: build, update, map, permutation, stats, compress, query.

    python -m strandlake.plans.commands build -k 20 -o GRAPH FILES...
    python -m strandlake.plans.commands map -i GRAPH KMERS...
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import bloom_math as B
from strandlake.functions import colorsets as C
from strandlake.functions import sequence as S
from strandlake.operators import bloom as BL
from strandlake.operators import graph as G
from strandlake.operators import permute as PM
from strandlake.operators import rows as R
from strandlake.operators import update as U
from strandlake.operators.lineage import few
from strandlake.sources import sequences as SQ
from strandlake.sources import store as ST
from strandlake.sources import variants as V

GRAPH = ["graph_meta", "edges", "colors", "annotation"]


def _kind(path: str) -> str:
    base = path.lower().removesuffix(".gz")
    return "vcf" if base.endswith(".vcf") else "fastq" if base.endswith((".fq", ".fastq")) else "fasta"


def coloured_records(spark: SparkSession, files: list[str], *, reference: str | None = None, k: int, delimiter: str | None = None, reverse: bool = False) -> DataFrame:
    """(rec_ord, color, is_prefix, rooted, start, seq, halo) of all files, rec_ord in the order of files, records and strands.

    Variants come as segments of their colour's joined sequences (see ``variants.joined_segments``), other records whole.
    """
    parts = []
    both = lambda df: G.with_reverse(df) if reverse else df.withColumn("strand", F.lit(0))
    for i, path in enumerate(files):
        kind = _kind(path)
        if kind == "vcf":
            if reference is None:
                raise ValueError("a VCF file needs a reference")
            found = V.variant_sequences(V.read_vcf(spark, path), SQ.read_fasta(spark, reference), k)
            contigs = found.select(F.col("colors")[0].alias("color")).distinct().withColumn("is_prefix", F.lit(True))
            named = V.joined_segments(found, k).join(few(contigs), "color", "left").withColumn("is_prefix", F.coalesce("is_prefix", F.lit(False)))
            whole = named.withColumn("text", F.concat("seq", "halo"))
            forth = whole.select("file", "color", "is_prefix", F.lit(0).alias("strand"), "rec", "allele", "seq", "halo")
            back = whole.select("file", "color", "is_prefix", F.lit(1).alias("strand"), (-F.col("rec")).alias("rec"), (-F.col("allele")).alias("allele"), S.reverse_complement(F.col("text")).alias("seq"), F.lit("").alias("halo"))
            pieces = (forth.unionByName(back) if reverse else forth).withColumn("later", ~F.col("is_prefix"))
            recs = G.dense_ids(pieces, ["file", "later", "color", "strand", "rec", "allele"], "rec_ord").select("rec_ord", "color", "is_prefix", F.lit(True).alias("rooted"), "seq", "halo")
        else:
            recs = SQ.file_colors(SQ.read_fastq(spark, path)) if kind == "fastq" else SQ.header_colors(SQ.read_fasta(spark, path), delimiter)
            recs = both(recs).select((F.col("rec_ord") * 2 + F.col("strand")).alias("rec_ord"), "color", "is_prefix", F.lit(False).alias("rooted"), "seq", F.lit("").alias("halo"))
        parts.append(recs.withColumn("file_ord", F.lit(i)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sizes = every.groupBy("file_ord").agg((F.max("rec_ord") + 1).alias("n"))
    before = sizes.select("file_ord", F.coalesce(F.sum("n").over(Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = every.join(F.broadcast(before), "file_ord")  # one row per file
    return placed.select((F.col("base") + F.col("rec_ord")).alias("rec_ord"), "color", "is_prefix", "rooted", F.lit(0).cast("long").alias("start"), "seq", "halo").where(F.length("seq") + F.length("halo") > k)


def _windows(records: DataFrame, k: int) -> DataFrame:
    keep = ("rec_ord", "color")
    padded = G.windows(records.where("not rooted"), k, keep=keep)
    return padded.unionByName(G.segment_windows(records.where("rooted"), k, rooted=True, keep=keep))


def _inner_windows(records: DataFrame, k: int) -> DataFrame:
    """Windows of the sequences themselves, without padding."""
    return G.segment_windows(records, k, rooted=True, keep=("rec_ord", "color"))


def _order():
    return G.occurrence_order(F.col("rec_ord"), F.col("pos"))


def _filters(records: DataFrame, colors: DataFrame, k: int, bits: float, hashes: int) -> dict[str, DataFrame]:
    """Filters hold the windows of the sequences themselves, without padding."""
    inner = _inner_windows(records, k).join(few(colors.select("color_id", F.col("name").alias("color"))), "color")
    meta = BL.sizes(inner, bits, hashes, ladder=True)
    return {"bloom_meta": meta, "bloom_bits": BL.build(inner, meta)}


def build(spark: SparkSession, files: list[str], base: str, k: int, *, reference: str | None = None, delimiter: str | None = None, reverse: bool = False, fpp: float | None = None, bits: float | None = None, hashes: int | None = None) -> None:
    """Graph, colours and annotation of files below ``base``, and Bloom filters if a rate or size is given."""
    records = coloured_records(spark, files, reference=reference, k=k, delimiter=delimiter, reverse=reverse)
    occ = _windows(records, k)
    edges = G.build_edges(occ, _order())
    first = records.groupBy(F.col("color").alias("name")).agg(F.min("rec_ord").alias("o"), F.max("is_prefix").alias("is_prefix"))
    colors = G.dense_ids(first.withColumn("later", ~F.col("is_prefix")), ["o", "later", "name"], "color_id").select(F.col("color_id").cast("int"), "name", "is_prefix")
    size, h = None, None
    if fpp is not None or bits is not None:
        size, h, _ = B.by_rate(fpp) if fpp is not None else B.by_bits(bits, hashes)
    ST.save({"graph_meta": ST.graph_meta(spark, k, size, h), "edges": edges, "colors": colors}, base)
    saved = ST.load(spark, base, ["edges", "colors"])
    ST.save({"annotation": G.annotate(occ, saved["edges"], saved["colors"], "color")}, base)
    if size is not None and h is not None:
        ST.save(_filters(records, saved["colors"], k, size, h), base)


def k_of(spark: SparkSession, base: str) -> int:
    return ST.load(spark, base, ["graph_meta"])["graph_meta"].first()["k"]


def _has(spark: SparkSession, base: str, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{table}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def update(spark: SparkSession, base: str, files: list[str], out: str, **options) -> None:
    """The graph below ``base`` with more files, written below ``out``, and its filters and rows where it has them.

    Filters keep their sizes; those of new colours get as many bits for each window as the graph was built with.
    """
    k, t = k_of(spark, base), ST.load(spark, base, GRAPH)
    records = coloured_records(spark, files, k=k, **options)
    edges, colors, annotation = U.update(t["edges"], t["colors"], t["annotation"], records, _windows(records, k), _order(), "color", "rec_ord")
    ST.save({"graph_meta": t["graph_meta"], "edges": edges, "colors": colors, "annotation": annotation}, out)
    saved = ST.load(spark, out, ["colors"])
    if _has(spark, base, "bloom_meta"):
        f = ST.load(spark, base, ["bloom_meta", "bloom_bits"])
        inner = _inner_windows(records, k).join(saved["colors"].select("color_id", F.col("name").alias("color")), "color")
        known = f["bloom_meta"].select("color_id")
        made = t["graph_meta"].first()
        fresh = BL.sizes(inner.join(known, "color_id", "left_anti"), made["bloom_bits"], made["bloom_hashes"], ladder=True)
        meta = f["bloom_meta"].unionByName(fresh)
        ST.save({"bloom_meta": meta, "bloom_bits": f["bloom_bits"].unionByName(BL.build(inner, meta)).distinct()}, out)
    if _has(spark, base, "rows"):
        compress(spark, out)


def map_kmers(spark: SparkSession, base: str, kmers: list[str], *, bloom: bool = False, cutoff: int = 50) -> DataFrame:
    """(query, edge_id, words, colors): colours from the annotation, or from path-corrected filters."""
    k, t = k_of(spark, base), ST.load(spark, base, GRAPH)
    queries = spark.createDataFrame([(x,) for x in kmers], "query string")
    annotation = corrected(spark, base, cutoff) if bloom else t["annotation"]
    n = t["colors"].count()
    hits = G.map_colors(queries, t["edges"], annotation, t["colors"], k)
    return hits.select("query", "edge_id", F.when(F.col("edge_id").isNotNull(), C.words_text(C.words(F.col("colors"), n))).otherwise("").alias("words"), F.array_join("color_names", ",").alias("colors"))


def corrected(spark: SparkSession, base: str, cutoff: int = 50) -> DataFrame:
    """(edge_id, color_id) of all edges from the filters; cutoff 0 leaves them as they are."""
    k, t = k_of(spark, base), ST.load(spark, base, ["edges", "bloom_meta", "bloom_bits"])
    solid = t["edges"].where(~F.col("kmer").contains("$"))
    raw = BL.probe(solid.select("kmer"), t["bloom_meta"], t["bloom_bits"]).join(t["edges"], "kmer").select("edge_id", "color_id")
    return raw if cutoff == 0 else BL.corrected(t["edges"], raw, k, cutoff)


def evaluate(spark: SparkSession, base: str, cutoff: int = 50, *, n: int | None = None, both: bool = True) -> DataFrame:
    """False positives and negatives of the filters before and after correction, of all edges or about ``n``.

    With ``n`` the steps of the walks are counted, and ``both`` says whether nodes are tested both ways (as for variants).
    """
    t = ST.load(spark, base, ["edges", "annotation"])
    if n is not None:
        return BL.evaluated(t["edges"], t["annotation"], corrected(spark, base, 0), k_of(spark, base), n, cutoff, both)
    return BL.evaluation(t["edges"], t["annotation"], corrected(spark, base, 0), corrected(spark, base, cutoff))


def compress(spark: SparkSession, base: str) -> None:
    """Rows of the annotation with a dictionary of distinct ones, below ``base``."""
    t = ST.load(spark, base, GRAPH)
    matrix = G.wide(t["edges"], t["annotation"]).select(F.col("edge_id").alias("row_id"), "colors")
    rows, sets = R.compress(matrix)
    ST.save({"rows": rows, "color_sets": sets}, base, "overwrite")


def merge(spark: SparkSession, bases: list[str], out: str) -> None:
    """Rows of several bases one behind the other, with one dictionary, below ``out``."""
    parts = [ST.load(spark, b, ["rows", "color_sets"]) for b in bases]
    rows, sets = R.merge([(t["rows"], t["color_sets"]) for t in parts])
    ST.save({"rows": rows, "color_sets": sets}, out)


def compress_lists(spark: SparkSession, files: list[str], out: str, *, verify: bool = False) -> DataFrame | None:
    """Index-list files, each compressed by itself and then merged, below ``out``; with ``verify`` the result's differences from the files."""
    rows, sets = R.merge([R.compress(SQ.read_index_lists(spark, f)) for f in files])
    ST.save({"rows": rows, "color_sets": sets}, out)
    if not verify:
        return None
    saved = ST.load(spark, out, ["rows", "color_sets"])
    return R.verified(saved["rows"], saved["color_sets"], R.concat([SQ.read_index_lists(spark, f) for f in files]))


def stats(spark: SparkSession, base: str) -> DataFrame:
    t = ST.load(spark, base, ["edges", "annotation", "colors"])
    matrix = G.wide(t["edges"], t["annotation"]).select(F.col("edge_id").alias("row_id"), "colors")
    return R.stats(matrix, t["colors"].count())


def permutation(spark: SparkSession, base: str, n: int) -> DataFrame:
    """Size model of the row trie for ``n`` random column orders and the present one."""
    t = ST.load(spark, base, ["annotation", "colors"])
    return PM.trie_sizes(t["annotation"], PM.random_permutations(t["colors"], n))


def query(spark: SparkSession, base: str, *, bloom: bool = False) -> DataFrame:
    """Colours of the first million rows, or of every edge from the filters."""
    if bloom:
        return corrected(spark, base, 0)
    t = ST.load(spark, base, ["rows", "color_sets"])
    return R.decode(R.first_rows(t["rows"]), t["color_sets"])


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["build", "update", "map", "permutation", "stats", "compress", "query", "evaluate", "merge", "compress-lists"])
    p.add_argument("inputs", nargs="*")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-k", type=int, default=3)
    p.add_argument("-r", "--reverse", action="store_true")
    p.add_argument("--reference")
    p.add_argument("--fasta-header-delimiter")
    p.add_argument("--bloom", action="store_true")
    p.add_argument("--bloom-false-pos-prob", type=float)
    p.add_argument("--bloom-bits-per-edge", type=float)
    p.add_argument("--bloom-hash-functions", type=int)
    p.add_argument("--bloom-test-num-kmers", type=int, help="evaluate about so many edges at even steps, and count the steps of their walks")
    p.add_argument("--one-way", action="store_true", help="test nodes one way only when evaluating a sample")
    p.add_argument("--verify", action="store_true", help="compare compressed rows with their files")
    p.add_argument("--num-permutations", type=int, default=0)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"strandlake {a.command}").getOrCreate()
    files = {"reference": a.reference, "delimiter": a.fasta_header_delimiter, "reverse": a.reverse}
    if a.command == "build":
        build(spark, a.inputs, a.output, a.k, fpp=a.bloom_false_pos_prob, bits=a.bloom_bits_per_edge, hashes=a.bloom_hash_functions, **files)
    elif a.command == "update":
        update(spark, a.input, a.inputs, a.output, **files)
    elif a.command == "compress":
        compress(spark, a.input)
    elif a.command == "merge":
        merge(spark, a.inputs, a.output)
    elif a.command == "compress-lists":
        report = compress_lists(spark, a.inputs, a.output, verify=a.verify)
        if report is not None:
            print(report.first().asDict())
    else:
        shown = {"map": lambda: map_kmers(spark, a.input, a.inputs, bloom=a.bloom), "permutation": lambda: permutation(spark, a.input, a.num_permutations), "stats": lambda: stats(spark, a.input), "query": lambda: query(spark, a.input, bloom=a.bloom), "evaluate": lambda: evaluate(spark, a.input, n=a.bloom_test_num_kmers, both=not a.one_way)}
        out = shown[a.command]()
        print("\t".join(out.columns))
        for row in out.toLocalIterator():  # every row, a partition at a time
            print("\t".join("" if v is None else ",".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))


if __name__ == "__main__":
    main()
