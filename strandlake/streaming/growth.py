"""A graph that grows with a stream of record batches.

Each micro-batch reads the clustered tables (see ``sources.clustered``) of the versions before it and writes a
version of its own with what is new, so what a batch writes follows the batch and not the graph, and a batch that is
run again after a failure gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators import graph as G
from strandlake.operators import update as U
from strandlake.operators.lineage import cut, few
from strandlake.sources import clustered

#: Versions between two full ones.
COMPACT_EVERY = 32


def grow(spark: SparkSession, base: str, records: DataFrame, version: int, k: int, fold: bool = False, buckets: int = clustered.BUCKETS) -> None:
    """Write version ``version``: what records (rec_ord, color, seq) add to the versions before it."""
    log, have = clustered.versions(spark, base, version), clustered.tables(spark, base, version)
    n_edges, n_colors = (log[-1]["n_edges"], log[-1]["n_colors"]) if log else (0, 0)
    buckets = log[-1]["buckets"] if log else buckets
    order = G.occurrence_order(F.col("rec_ord"), F.col("pos"), G.wide_order(records))
    folded = cut(G.windows(records, k, fold=fold, keep=("rec_ord", "color")).groupBy("kmer", "color").agg(F.min(order).alias("first")))
    first = folded.groupBy("kmer").agg(F.min("first").alias("first")).withColumn("bucket", clustered.bucket("kmer", buckets))
    fresh = G.dense_ids(first.join(have["edges"].select("kmer", "bucket"), ["bucket", "kmer"], "left_anti"), "first", "i")
    edges = cut(fresh.select((F.col("i") + n_edges).alias("edge_id"), "kmer"))
    colors = cut(U.new_colors(have["colors"], records.where(F.length("seq") > k), "color", "rec_ord"))
    named = have["colors"].unionByName(colors).select("color_id", F.col("name").alias("color"))
    pairs = folded.join(few(named), "color").select("kmer", "color_id").withColumn("bucket", clustered.bucket("kmer", buckets))
    pairs = pairs.join(have["annotation"], ["bucket", "kmer", "color_id"], "left_anti").drop("bucket")
    clustered.put(spark, base, version, False, k, buckets, {"edges": edges, "annotation": pairs, "colors": colors}, (n_edges + edges.count(), n_colors + colors.count()))
    if len(log) >= COMPACT_EVERY:
        clustered.compact(spark, base)


def start(spark: SparkSession, stream: DataFrame, base: str, checkpoint: str, k: int, fold: bool = False) -> StreamingQuery:
    """Run ``grow`` on every micro-batch of a streaming DataFrame with rec_ord, color and seq."""

    def each(batch: DataFrame, number: int) -> None:
        grow(batch.sparkSession, base, batch, number, k, fold)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
