"""Saving and loading graphs, annotations, filters and row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import colorsets as C
from strandlake.operators.lineage import few

# Tables that a saved graph may have
TABLES = ["graph_meta", "edges", "colors", "annotation", "bloom_meta", "bloom_bits", "rows", "color_sets"]


def save(tables: dict[str, DataFrame], base: str, mode: str = "errorifexists") -> None:
    """Write tables as Parquet below ``base``; edges are kept in id order, so readers can skip by id."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        ordered = df.sortWithinPartitions("edge_id") if "edge_id" in df.columns else df
        ordered.write.mode(mode).parquet(f"{base}/{name}")


def load(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    """Read tables; a missing one raises."""
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def graph_meta(spark: SparkSession, k: int, bits: float | None = None, hashes: int | None = None) -> DataFrame:
    """k, and what filters of the graph are made with: bits for each element and hash functions, null without filters."""
    return spark.createDataFrame([(k, bits, hashes)], "k int, bloom_bits double, bloom_hashes int")


def from_precise(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(edge_id, colors) of each edge from (kmer, colors); k-mers outside the graph go, edges without a row are empty."""
    return edges.join(rows, "kmer", "left").select("edge_id", F.coalesce("colors", F.array().cast("array<int>")).alias("colors"))


def export_words(matrix: DataFrame, n_colors: int, path: str, permutation: DataFrame | None = None) -> None:
    """Rows in id order as packed words, columns permuted if asked for."""
    if permutation is not None:
        moved = matrix.select("edge_id", F.explode_outer("colors").alias("color_id")).join(few(permutation), "color_id", "left")
        matrix = moved.groupBy("edge_id").agg(F.array_sort(F.collect_list("new_id")).alias("colors"))
    matrix.select("edge_id", C.words(F.col("colors"), n_colors).alias("words")).repartitionByRange("edge_id").sortWithinPartitions("edge_id").write.parquet(path)


def write_lines(matrix: DataFrame, n_colors: int, path: str) -> None:
    """k-mer, tab, comma-joined unsigned words."""
    matrix.select(F.concat_ws("\t", "kmer", C.words_text(C.words(F.col("colors"), n_colors)))).write.text(path)


def write_index_lists(rows: DataFrame, path: str) -> None:
    """Comma-joined colours, one row a line, in row order."""
    rows.repartitionByRange("row_id").sortWithinPartitions("row_id").select(C.text(F.col("colors")).alias("value")).write.text(path)
