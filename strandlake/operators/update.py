"""Incremental growth of a graph and its annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import annotate, dense_ids


def new_edges(edges: DataFrame, occurrences: DataFrame, order: Column) -> DataFrame:
    """Edges that ``occurrences`` add; their ids go on behind the present ones."""
    fresh = occurrences.groupBy("kmer").agg(F.min(order).alias("__first")).join(edges.select("kmer"), "kmer", "left_anti")
    base = edges.agg((F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).alias("__base"))
    return dense_ids(fresh, "__first", "edge_id").join(F.broadcast(base)).select((F.col("edge_id") + F.col("__base")).alias("edge_id"), "kmer")


def new_colors(colors: DataFrame, records: DataFrame, name: str, order: str) -> DataFrame:
    """Colours that ``records`` add, classes (is_prefix, where records have it) among them; names that are known keep their ids."""
    prefix = F.max("is_prefix") if "is_prefix" in records.columns else F.lit(False)
    fresh = records.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("__first"), prefix.alias("is_prefix")).join(colors.select("name"), "name", "left_anti")
    base = colors.agg((F.coalesce(F.max("color_id"), F.lit(-1)) + 1).alias("__base"))
    numbered = dense_ids(fresh, ["__first", "name"], "__i")
    return numbered.join(F.broadcast(base)).select((F.col("__i") + F.col("__base")).cast("int").alias("color_id"), "name", "is_prefix")


def update(edges: DataFrame, colors: DataFrame, annotation: DataFrame, records: DataFrame, occurrences: DataFrame, order: Column, name: str, rec: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, colors, annotation) with the new records added; running it twice adds nothing."""
    all_edges = edges.unionByName(new_edges(edges, occurrences, order))
    all_colors = colors.unionByName(new_colors(colors, records, name, rec))
    more = annotate(occurrences, all_edges, all_colors, name)
    return all_edges, all_colors, annotation.unionByName(more).distinct()
