"""Column permutations: class indicators first, and random ones with a size model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import few


def prefix_first(colors: DataFrame) -> DataFrame:
    """(color_id, new_id): prefix colours ascending, then the others in their order."""
    order = Window.orderBy(~F.col("is_prefix"), "color_id")
    return colors.select("color_id", (F.row_number().over(order) - 1).cast("int").alias("new_id"))


def apply(annotation: DataFrame, permutation: DataFrame) -> DataFrame:
    """annotation with permuted colour ids."""
    return annotation.join(few(permutation), "color_id").select("edge_id", F.col("new_id").alias("color_id"))


def random_permutations(colors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(perm, color_id, new_id): number 0 is the order as it is, the others are orders of a hash that any SQL engine has."""
    spark = colors.sparkSession
    each = colors.select("color_id").crossJoin(spark.range(n + 1).select(F.col("id").cast("int").alias("perm")))
    key = F.when(F.col("perm") == 0, F.lit("")).otherwise(F.md5(F.concat_ws(":", F.lit(seed), "perm", "color_id")))
    order = Window.partitionBy("perm").orderBy(key, "color_id")
    return each.select("perm", "color_id", (F.row_number().over(order) - 1).cast("int").alias("new_id"))


def trie_sizes(annotation: DataFrame, permutations: DataFrame, key: str = "edge_id") -> DataFrame:
    """(perm, n_nodes, alpha_bits, beta_bits): shape of the binary prefix tree over each permutation's distinct rows.

    Labels count their bits and an end bit; an inner node has one branching bit for each row below it. Equal rows
    are folded before permuting. Rows that share their first colours form a group, told apart by the colour that
    comes next or by none: each next colour but the last in order is an inner node, at that colour's
    bit, with the rows that have it or a later one below it. So a group has as many entries as there are colours at most,
    and no task sees a permutation's rows together. Summed over the tree, labels have a bit for each leaf's end and
    the longer of its row and its branching bits, less the bits down to each inner node.
    """
    sets = annotation.groupBy(key).agg(F.array_sort(F.collect_set("color_id")).alias("colors")).groupBy("colors").agg(F.count("*").alias("n"))
    moved = sets.select("colors", "n", F.explode("colors").alias("color_id")).join(permutations, "color_id")
    rows = moved.groupBy("perm", "colors").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("new_id")).alias("row"))
    each = rows.select("perm", "n", "row", F.explode(F.sequence(F.lit(0), F.size("row"))).alias("j"))
    none = F.lit(2**31 - 1)  # after every colour
    following = F.when(F.col("j") < F.size("row"), F.get("row", F.col("j"))).otherwise(none)
    counted = each.groupBy("perm", F.slice("row", F.lit(1), F.col("j")).alias("begin"), following.alias("next")).agg(F.sum("n").alias("n"))
    groups = counted.groupBy("perm", "begin").agg(F.array_sort(F.collect_list(F.struct("next", "n"))).alias("ways"))
    t = F.size("ways")
    branches = F.slice("ways", F.lit(1), t - 1)
    below = F.transform("ways", lambda w, i: w["n"] * F.least(i + 1, t - 1))
    ends = F.get("ways", t - 1)["next"] == none
    deep = F.when(t > 1, F.get("ways", t - 2)["next"] + 1).when(F.size("begin") > 0, F.element_at("begin", -1) + 1).otherwise(0)
    added = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    shapes = groups.select(
        "perm",
        F.when(ends, 1).otherwise(0).alias("leaves"),
        (F.when(ends, deep + 1).otherwise(0) - added(F.transform(branches, lambda w: w["next"] + 1))).alias("alpha"),
        added(below).alias("beta"),
    )
    return shapes.groupBy("perm").agg((2 * F.sum("leaves") - 1).alias("n_nodes"), F.sum("alpha").alias("alpha_bits"), F.sum("beta").alias("beta_bits"))
