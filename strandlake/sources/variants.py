"""VCF records with their reference context as coloured sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.lineage import few

from .numbering import lines, numbered

# INFO keys that name population colours
INFO_KEYS = ["AC_AFR", "AC_EAS", "AC_AMR", "AC_ASJ", "AC_FIN", "AC_NFE", "AC_SAS", "AC_OTH"]


def read_vcf(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, rec, contig, pos, ref, alts, filters, info, samples array<struct<name, gt>>)."""
    found = lines(spark, paths).where(~F.startswith("value", F.lit("##")))
    heads = found.where(F.startswith("value", F.lit("#"))).select("file", F.slice(F.split("value", "\t"), 10, 1 << 20).alias("names"))
    rows = numbered(found.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)), "rec").withColumn("rec", F.col("rec").cast("int")).withColumn("f", F.split("value", "\t"))
    rows = rows.join(few(heads), "file", "left")
    entries = F.transform(F.filter(F.split(F.col("f")[7], ";"), lambda x: x != "."), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v")))
    keys = F.transform(entries, lambda x: x["k"])
    info = F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["k"]) == i + 1))  # the first of repeated keys counts
    fields = F.when(F.size("f") > 9, F.slice(F.col("f"), 10, 1 << 20)).otherwise(F.array().cast("array<string>"))
    samples = F.transform(F.arrays_zip(F.coalesce("names", F.array().cast("array<string>")).alias("name"), F.transform(fields, lambda x: F.split_part(x, F.lit(":"), F.lit(1))).alias("gt")), lambda z: F.struct(z["name"].alias("name"), z["gt"].alias("gt")))
    return rows.select("file", "rec", F.col("f")[0].alias("contig"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"), F.split(F.col("f")[6], ";").alias("filters"), info.alias("info"), samples.alias("samples"))


def allele_codes(gt: Column) -> Column:
    """Genotype as integers: (allele + 1) * 2, plus 1 where a phase mark stands before it; 0 for a missing allele."""
    marks = F.concat(F.array(F.lit("/")), F.regexp_extract_all(gt, F.lit(r"([/|])"), 1))
    alleles = F.split(gt, r"[/|]")
    return F.transform(F.arrays_zip(alleles.alias("a"), marks.alias("m")), lambda z: F.when(z["a"] == ".", 0).otherwise((z["a"].cast("int") + 1) * 2) + (z["m"] == "|").cast("int"))


def is_carrier(gt: Column, mode: str = "parity", alt: Column | None = None) -> Column:
    """``parity``: a phased genotype with an allele whose code has bit 4; ``strict``: it has allele ``alt``."""
    if mode == "strict":
        return F.array_contains(F.split(gt, r"[/|]"), (F.lit(1) if alt is None else alt).cast("string"))
    return F.aggregate(allele_codes(gt), F.lit(0), lambda a, x: a.bitwiseOR(x)).bitwiseAND(F.lit(5)) == 5


def usable_alts(alts: Column) -> Column:
    """Alleles before the first symbolic one that isn't a copy number."""
    bad = F.transform(alts, lambda a: F.startswith(a, F.lit("<")) & ~F.startswith(a, F.lit("<CN")))
    first = F.array_position(bad, True)
    return F.when(first > 0, F.slice(alts, F.lit(1), (first - 1).cast("int"))).otherwise(alts)


def allele(alt: Column, ref: Column) -> Column:
    """The allele's bases; <CNn> stands for n copies of the reference allele."""
    n = F.regexp_extract(alt, r"^<CN(\d+)", 1)
    return F.when(n != "", F.repeat(ref, n.cast("int"))).otherwise(alt)


def with_flanks(contig: Column, pos: Column, ref: Column, bases: Column, k: int) -> Column:
    """k bases to the left of the 1-based position, the allele, k to the right; clamped to the contig."""
    left = F.substring(contig, F.greatest(pos - k, F.lit(1)), F.least(F.lit(k), pos - 1))
    return F.concat(left, bases, F.substring(contig, pos + F.length(ref), F.lit(k)))


def variant_sequences(vcf: DataFrame, reference: DataFrame, k: int, *, info_keys: list[str] = INFO_KEYS, mode: str = "parity") -> DataFrame:
    """(file, rec, allele, seq, colors, n_prefix): one row for each passing allele.

    Colours are the contig (a class), the INFO keys with a value other than 0, and the
    samples that carry it. ``reference`` has name and seq.
    """
    passing = vcf.where(F.array_contains("filters", "PASS"))
    each = passing.select("*", F.posexplode(usable_alts(F.col("alts"))).alias("allele", "alt"))
    contigs = reference.select(F.col("name").alias("contig"), F.col("seq").alias("contig_seq"))
    joined = each.join(contigs, "contig")
    wanted = F.filter(F.array(*[F.lit(x) for x in info_keys]), lambda x: F.coalesce(F.split_part(F.element_at("info", x), F.lit(","), F.lit(1)).cast("double") != 0, F.lit(False)))
    carriers = F.transform(F.filter("samples", lambda s: is_carrier(s["gt"], mode, F.col("allele") + 1)), lambda s: s["name"])
    seq = with_flanks(F.col("contig_seq"), F.col("pos"), F.col("ref"), allele(F.col("alt"), F.col("ref")), k)
    return joined.select("file", "rec", "allele", seq.alias("seq"), F.concat(F.array("contig"), wanted, carriers).alias("colors"), F.lit(1).alias("n_prefix"))


def joined_by_color(variants: DataFrame) -> DataFrame:
    """(file, color, seq): a colour's sequences of one file, joined by $ in their order (rooted)."""
    each = variants.select("file", "rec", "allele", "seq", F.explode("colors").alias("color"))
    sorted_ = F.array_sort(F.collect_list(F.struct("rec", "allele", "seq")))
    return each.groupBy("file", "color").agg(F.array_join(F.transform(sorted_, lambda x: x["seq"]), "$").alias("seq"))


#: Records whose sequences are ordered in one task, for each colour.
BAND = 4096


def joined_segments(variants: DataFrame, k: int, band: int = BAND) -> DataFrame:
    """(file, color, rec, allele, start, seq, halo): the strings of ``joined_by_color``, a row for each of their sequences.

    ``seq`` has the $ that follows, ``halo`` the k letters after it, so ``graph.segment_windows`` (rooted) gives the windows
    of the joined strings; no row or task has a colour's sequences together. They are ordered within bands of
    records, and what a band's end leaves open comes from the bands behind it.
    """
    reach, rows_ahead = k + 1, k // 2 + 1  # a sequence is a letter and a $ at least
    each = variants.select("file", "rec", "allele", "seq", F.explode("colors").alias("color"), F.floor(F.col("rec") / band).alias("band"))
    inside = Window.partitionBy("file", "color", "band").orderBy("rec", "allele")
    after = F.array_join(F.collect_list(F.concat(F.lit("$"), F.substring("seq", 1, reach))).over(inside.rowsBetween(1, rows_ahead)), "")
    placed = each.withColumn("after", F.substring(after, 1, reach)).withColumn("i", F.row_number().over(inside))
    begins = placed.where("i = 1").select("file", "color", "band", F.substring(F.concat(F.lit("$"), "seq", "after"), 1, reach).alias("opening"))
    behind = Window.partitionBy("file", "color").orderBy("band").rowsBetween(1, rows_ahead)
    bands = begins.select("file", "color", "band", F.array_join(F.collect_list("opening").over(behind), "").alias("beyond"))  # a row a band
    whole = placed.join(few(bands), ["file", "color", "band"]).withColumn("after", F.substring(F.concat("after", "beyond"), 1, reach))
    return whole.select("file", "color", "rec", "allele", F.lit(0).cast("long").alias("start"), F.concat("seq", F.substring("after", 1, 1)).alias("seq"), F.substring("after", 2, k).alias("halo"))
