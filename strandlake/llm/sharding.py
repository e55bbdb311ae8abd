"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into logical partitions by a hash of their identity. The number of rows that each
partition sends to each shard is drawn exactly as a uniform permutation of all rows would
deal them (multivariate hypergeometric, row by row of the matrix). Each partition permutes
its rows and deals them by its line of the matrix; each shard permutes what it receives. The
result is a uniform shuffle whose shards differ by one row at most, and it depends on the
rows and the seed alone, not on how Spark splits the input, so a rerun or a lost executor
gives the same shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Logical partitions; the matrix has this many lines and the driver holds no more than it.
PARTITIONS = 512
#: Parts into which the slots of one shard are numbered side by side.
SLOT_BLOCKS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw of the number of good items among ``n`` taken from ``good + bad``."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    # walk outwards from the mode until the drawn mass is used up
    p = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u, left, right, p_left, p_right = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """counts[p, s] of rows that partition p sends to shard s; exact margins on both sides."""
    rng = np.random.default_rng(seed)
    left = list(capacities)
    out = np.zeros((len(rows), len(left)), np.int64)
    for p, n in enumerate(rows):
        rest, pool = n, sum(left)
        for s, room in enumerate(left):
            take = rest if pool == room else hypergeometric(rng, room, pool - room, rest)
            out[p, s] = take
            pool -= room
            rest -= take
        for s in range(len(left)):
            left[s] -= int(out[p, s])
    return out


def uniform_shards(df: DataFrame, identity: list[Column], n_shards: int = 16, seed: int = 11, partitions: int = PARTITIONS) -> DataFrame:
    """Add ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard) to each row.

    ``identity`` are the columns that tell rows apart; equal rows are interchangeable. Null
    identities are ordinary values, an empty table gives an empty result, columns of the same
    names as the new ones are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    key = lambda salt: F.xxhash64(F.lit(seed * 1000 + salt), *identity)
    base = df.withColumn("__part", F.pmod(key(1), F.lit(partitions)).cast("int"))
    sizes = dict(base.groupBy("__part").count().collect())  # at most `partitions` lines
    rows = [sizes.get(p, 0) for p in range(partitions)]
    total = sum(rows)
    capacities = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = np.cumsum(communication_matrix(rows, capacities, seed), axis=1)
    lines = spark.createDataFrame([(p, [int(x) for x in matrix[p]]) for p in range(partitions)], "__part int, __upto array<long>")
    by_part = Window.partitionBy("__part").orderBy(key(2), *identity)
    dealt = (
        base.withColumn("__rank", F.row_number().over(by_part) - 1)
        .join(F.broadcast(lines), "__part")
        .withColumn("shard", F.size(F.filter("__upto", lambda x: x <= F.col("__rank"))).cast("int"))
        .withColumn("__h", key(3))
        .withColumn("__block", (F.shiftrightunsigned("__h", 32) % SLOT_BLOCKS).cast("int"))
        .drop("__part", "__upto", "__rank")
    )
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__block").agg(F.count("*").alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    by_block = Window.partitionBy("shard", "__block").orderBy("__h", *identity)
    return (
        dealt.withColumn("__i", F.row_number().over(by_block) - 1)
        .join(F.broadcast(offsets), ["shard", "__block"])  # n_shards * SLOT_BLOCKS lines at most
        .withColumn("slot", F.col("__off") + F.col("__i"))
        .drop("__h", "__block", "__i", "__off")
    )


def op10(docs: DataFrame) -> DataFrame:
    """The contract's digest: law ``rows``; texts themselves are not shuffled, only their size and checksum.

    Texts are measured whole, however long; a null one counts as empty. Repeated rows and rows without a doc_id are placed
    one by one. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
