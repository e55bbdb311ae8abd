"""Tables of k-mers clustered by hash, grown by deltas.

    BASE/edges/full-3, BASE/edges/delta-4, ...      bucket=B/ files of (edge_id, kmer)
    BASE/annotation/full-3, delta-4, ...            bucket=B/ files of (kmer, color_id)
    BASE/colors/full-3, delta-4, ...                (color_id, name, is_prefix)
    BASE/log/N                                      one row: what version N is

Files lie in a folder of their bucket, a hash of the k-mer, and are sorted by k-mer, so a lookup reads
the files of its buckets only, and in these the row groups that may have its k-mers. A version
adds rows that no earlier one has: reading is a union, and writing a version costs what it adds. A version counts
once its row of the log is there; writing it again gives it again. Compaction makes one full version of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Distinct k-mers of a lookup that are given to the scan as a filter.
LISTED = 1000
NAMES = ["edges", "annotation", "colors"]
LOG = "version long, full boolean, k int, buckets int, n_edges long, n_colors long"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def bucket(kmer, buckets: int):
    return F.pmod(F.xxhash64(kmer), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, base: str, before: int | None = None) -> list:
    """Rows of the log in order, from the last full version on."""
    if not exists(spark, f"{base}/log"):
        return []
    rows = sorted((r for r in spark.read.schema(LOG).parquet(f"{base}/log/*").collect() if before is None or r["version"] < before), key=lambda r: r["version"])  # a row a version
    full = max((i for i, r in enumerate(rows) if r["full"]), default=0)
    return rows[full:]


def tables(spark: SparkSession, base: str, before: int | None = None) -> dict[str, DataFrame]:
    """edges (edge_id, kmer, bucket), annotation (kmer, color_id, bucket) and colors of the last version, or of the last one before another."""
    log = versions(spark, base, before)
    schemas = {"edges": "edge_id long, kmer string, bucket int", "annotation": "kmer string, color_id int, bucket int", "colors": "color_id int, name string, is_prefix boolean"}
    out = {}
    for name in NAMES:
        out[name] = spark.createDataFrame([], schemas[name])
        for i, r in enumerate(log):  # bounded by compaction
            part = spark.read.schema(schemas[name]).parquet(f"{base}/{name}/{'full' if r['full'] else 'delta'}-{r['version']}").select(*out[name].columns)
            out[name] = out[name].unionByName(part) if i else part
    return out


def put(spark: SparkSession, base: str, version: int, full: bool, k: int, buckets: int, parts: dict[str, DataFrame], counts: tuple[int, int]) -> None:
    """Write one version: its tables, and then its row of the log."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    for name, df in parts.items():
        path = f"{base}/{name}/{'full' if full else 'delta'}-{version}"
        if name == "colors":
            df.coalesce(1).write.mode("overwrite").parquet(path)
        else:
            placed = df.withColumn("bucket", bucket("kmer", buckets)).repartitionByRange(n, "bucket", "kmer").sortWithinPartitions("bucket", "kmer")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
    spark.createDataFrame([(version, full, k, buckets, *counts)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{base}/log/{version}")


def compact(spark: SparkSession, base: str) -> None:
    """Make the last version a full one."""
    last, have = versions(spark, base)[-1], tables(spark, base)
    if not last["full"]:
        put(spark, base, last["version"], True, last["k"], last["buckets"], {n: df.drop("bucket") for n, df in have.items()}, (last["n_edges"], last["n_colors"]))


def looked_up(spark: SparkSession, base: str, queries: DataFrame, kmer: str = "query") -> DataFrame:
    """queries (any columns) with valid, edge_id (null on a miss), colors and color_names.

    The buckets of the queries are found first (a number a bucket comes to the driver) and only their files are read; up
    to LISTED k-mers go to the scan themselves.
    """
    log = versions(spark, base)
    have = tables(spark, base)
    k, buckets = log[-1]["k"], log[-1]["buckets"]
    wanted = queries.where(F.length(kmer) == k + 1).select(F.col(kmer).alias("kmer")).distinct()
    named = [r["kmer"] for r in wanted.limit(LISTED + 1).collect()]
    numbers = sorted(r["b"] for r in wanted.select(bucket("kmer", buckets).alias("b")).distinct().collect())  # a bucket each at most
    keep = F.col("bucket").isin(numbers) & (F.col("kmer").isin(named) if len(named) <= LISTED else F.lit(True))
    edges, pairs = (have[n].where(keep) for n in ("edges", "annotation"))
    found = edges.select("edge_id", "kmer").join(wanted, "kmer", "left_semi")
    sets = pairs.join(wanted, "kmer", "left_semi").join(have["colors"].select("color_id", "name"), "color_id").groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("color_id", "name"))).alias("__c"))
    rows = found.join(sets, "kmer", "left").select(F.col("kmer").alias("__kmer"), "edge_id", F.transform("__c", lambda x: x["color_id"]).alias("colors"), F.transform("__c", lambda x: x["name"]).alias("color_names"))
    out = queries.withColumn("valid", F.length(kmer) == k + 1).join(rows, F.col("valid") & (F.col(kmer) == F.col("__kmer")), "left").drop("__kmer")
    none = F.array()
    return out.withColumn("colors", F.coalesce("colors", none.cast("array<int>"))).withColumn("color_names", F.coalesce("color_names", none.cast("array<string>")))
