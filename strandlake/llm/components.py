"""Connected components of a link table by alternating large and small stars, and tiles for what is still apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_runs

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to its least neighbour.

    One exchange by the node: a node's repeated neighbours meet there, and so does its least one, so no
    more rows leave than distinct edges came.
    """
    way = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    back = F.struct(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    met = edges.select(F.inline(F.array(way, back) if large else F.array(way))).repartition("u").dropDuplicates(["u", "v"])
    met = met.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    if large:
        return met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # the row of the least neighbour stands for the node itself
    return met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from each id that has a link.

    ``links`` has longs a and b and is read once; loops and repeats don't matter. Each round is two exchanges by
    the node of rows of two numbers, and ends written in the checkpoint folder;
    the number of rounds grows with the logarithm of the number of nodes.
    """
    edges = links.where("a <> b").select("a", "b")
    state = None
    for _ in range(MAX_ROUNDS):
        edges = cut(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def tiled_apart(rows: DataFrame, tiles: Column) -> DataFrame:
    """Add ``tile``, ``other`` and ``piece`` to members of buckets (key, id, component, weight): a piece is a pair of tiles.

    Every two members of a bucket that are of different components share a piece. Tiles of a bucket's
    largest component come after those of the rest and don't meet each other. ``tiles`` says how many tiles
    ``n`` members of weight ``m`` make.
    """
    each = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("m"))
    sizes = each.groupBy("key").agg(F.max(F.struct("n", "m", "component")).alias("large"), F.sum("n").alias("all_n"), F.sum("m").alias("all_m"))
    large = sizes.select("key", F.col("large.component").alias("main"), F.col("large.n").alias("n"), F.col("large.m").alias("m"), "all_n", "all_m").withColumn("main_tiles", tiles)
    small = large.withColumn("n", F.col("all_n") - F.col("n")).withColumn("m", F.col("all_m") - F.col("m")).withColumn("tiles", tiles).select("key", "main", "main_tiles", "tiles")
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("main_tiles")).otherwise(F.col("tiles")))
    placed = rows.join(small, "key").withColumn("tile", (F.when(is_main, F.col("tiles")).otherwise(0) + own).cast("int"))
    met = F.when(is_main, F.col("tiles")).otherwise(F.col("tiles") + F.col("main_tiles"))
    paired = placed.where(met > 0).withColumn("other", F.explode(F.sequence(F.lit(0), (met - 1).cast("int"))))
    return paired.withColumn("piece", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))).drop("main", "main_tiles", "tiles")


def pieces(batches: Iterator[pa.RecordBatch], key: str = "piece") -> Iterator[pa.Table]:
    """Rows in order of ``key``, those of one value at a time, where there are two at least."""
    for table in whole_runs(batches, (key,), 1):
        value = table.column(key).to_numpy()
        head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        for lo, hi in zip(head.tolist(), np.append(head[1:], len(value)).tolist(), strict=True):
            if hi - lo > 1:
                yield table.slice(lo, hi - lo).combine_chunks()
