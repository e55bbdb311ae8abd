"""Column functions of the sequence algebra: encoding, padding, complements, k-mer parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet in tie-break order, its end mark, and the IUPAC complements
ALPHABET = "ACGTN$"
END = "$"
BASES = "ACGTRYKMBVDHUacgtrykmbvdhu"
COMPLEMENTS = "TGCAYRMKVBHDAtgcayrmkvbhda"


def fold_case(seq: Column) -> Column:
    """Upper-case the alphabet's letters; never ``upper``, which changes lengths of other characters."""
    return F.translate(seq, "acgtn", "ACGTN")


def encode(seq: Column, fold: bool = False) -> Column:
    """Characters outside the alphabet become N; case counts unless ``fold``."""
    return F.regexp_replace(fold_case(seq) if fold else seq, "[^ACGTN$]", "N")


def pad(encoded: Column, k: int, rooted: bool = False) -> Column:
    """k+1 end marks before and one behind, unless the sequence is rooted already."""
    return encoded if rooted else F.concat(F.lit(END * (k + 1)), encoded, F.lit(END))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def source_node(kmer: Column, k: int) -> Column:
    return F.substring(kmer, 1, k)


def target_node(kmer: Column, k: int) -> Column:
    return F.substring(kmer, 2, k)


def label(kmer: Column) -> Column:
    return F.right(kmer, F.lit(1))


def letter_rank(letter: Column) -> Column:
    """Place of a letter in the alphabet, from 1."""
    return F.instr(F.lit(ALPHABET), letter)


def is_dummy(kmer: Column) -> Column:
    return F.contains(kmer, F.lit(END))


def suffix_equal(a: Column, b: Column, start: Column) -> Column:
    """Equal lengths, and equal from ``start`` (0-based) on."""
    tail = lambda x: F.substring(x, start + 1, F.length(x))
    return (F.length(a) == F.length(b)) & (tail(a) == tail(b))


def colex_greater(a: Column, b: Column) -> Column:
    """Comparison from the last character backwards; a proper suffix is the smaller one."""
    return F.reverse(a) > F.reverse(b)


def file_type(name: Column) -> Column:
    """Upper-case kind of a sequence file by extension, .gz aside; "" without one, FASTA for others."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(name, r"(?i)\.gz$", ""), r"\.([^./]+)$", 1))
    return F.when(ext == "", "").when(ext == "vcf", "VCF").when(ext.isin("fq", "fastq"), "FASTQ").otherwise("FASTA")
