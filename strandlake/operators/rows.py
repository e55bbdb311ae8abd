"""Ordered tables of bit rows: (row_id, colors), ids dense from 0.

Equal rows can share one entry of a dictionary, color_sets(set_id, colors) and rows(row_id,
set_id). Edits are positional and give dense ids again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import colorsets as C

from .graph import dense_ids
from .lineage import cut, few


def compress(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with set_id, color_sets): each distinct row once, numbered by its first place."""
    first = rows.groupBy("colors").agg(F.min("row_id").alias("__first"))
    sets = dense_ids(first, "__first", "set_id").select("set_id", "colors")
    return rows.join(sets, "colors").select("row_id", "set_id"), sets


def decode(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return rows.join(sets, "set_id").select("row_id", "colors")


def merge(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows, color_sets) of several such tables, one behind the other; rows are never expanded.

    Only the dictionaries meet: equal sets become one, numbered by the first row that has it, and rows get the
    new numbers. The tables' sizes come to the driver, a number each.
    """
    firsts, numbered, before = None, None, 0
    for part, (rows, sets) in enumerate(parts):
        placed = rows.select(F.lit(part).alias("part"), (F.col("row_id") + before).alias("row_id"), F.col("set_id").alias("old"))
        first = placed.groupBy("part", "old").agg(F.min("row_id").alias("__first")).join(sets.select(F.col("set_id").alias("old"), "colors"), "old")
        firsts = first if firsts is None else firsts.unionByName(first)
        numbered = placed if numbered is None else numbered.unionByName(placed)
        before += rows.count()
    if firsts is None or numbered is None:
        raise ValueError("nothing to merge")
    firsts = cut(firsts)
    sets = cut(dense_ids(firsts.groupBy("colors").agg(F.min("__first").alias("__first")), "__first", "set_id").select("set_id", "colors"))
    mapped = few(firsts.join(sets, "colors").select("part", "old", "set_id"))
    return numbered.join(mapped, ["part", "old"]).select("row_id", "set_id"), sets


def verified(rows: DataFrame, sets: DataFrame, originals: DataFrame) -> DataFrame:
    """One row: how many rows there are, are missing, are too many, and have other colours than the originals (row_id, colors)."""
    back = decode(rows, sets).withColumnRenamed("colors", "__got")
    both = originals.select("row_id", F.array_sort("colors").alias("__want")).join(back, "row_id", "full")
    return both.agg(F.count("__want").alias("n_rows"), F.count_if(F.col("__got").isNull()).alias("n_missing"), F.count_if(F.col("__want").isNull()).alias("n_extra"), F.count_if(F.col("__got") != F.col("__want")).alias("n_different"))


def at(rows: DataFrame, row_id: int, before: int | None = None) -> DataFrame:
    """One row, or its colours below ``before``."""
    one = rows.where(F.col("row_id") == row_id)
    return one if before is None else one.withColumn("colors", C.clear_from(F.col("colors"), F.lit(before)))


def _edit(rows: DataFrame, hit: Column, new: Column) -> DataFrame:
    return rows.withColumn("colors", F.when(hit, new).otherwise(F.col("colors")))


def set_bit(rows: DataFrame, row_id: int, color: int) -> DataFrame:
    return _edit(rows, F.col("row_id") == row_id, C.set_bit(F.col("colors"), F.lit(color)))


def unset_bit(rows: DataFrame, row_id: int, color: int) -> DataFrame:
    return _edit(rows, F.col("row_id") == row_id, C.unset_bit(F.col("colors"), F.lit(color)))


def toggle_bit(rows: DataFrame, row_id: int, color: int) -> DataFrame:
    return _edit(rows, F.col("row_id") == row_id, C.toggle_bit(F.col("colors"), F.lit(color)))


def set_bits(rows: DataFrame, places: DataFrame, color: int) -> DataFrame:
    """Set one colour in every row named in ``places`` (row_id)."""
    marked = places.select("row_id").distinct().withColumn("__hit", F.lit(True))
    return _edit(rows.join(marked, "row_id", "left"), F.coalesce("__hit", F.lit(False)), C.set_bit(F.col("colors"), F.lit(color))).drop("__hit")


def insert(rows: DataFrame, more: DataFrame, place: int | None = None) -> DataFrame:
    """Splice ``more`` in before ``place``, or append it."""
    size = lambda df: df.agg(F.count("*").alias("__n"))
    if place is None:
        return rows.unionByName(more.join(F.broadcast(size(rows))).select((F.col("row_id") + F.col("__n")).alias("row_id"), "colors"))
    shifted = rows.join(F.broadcast(size(more))).select(F.when(F.col("row_id") >= place, F.col("row_id") + F.col("__n")).otherwise(F.col("row_id")).alias("row_id"), "colors")
    return shifted.unionByName(more.select((F.col("row_id") + place).alias("row_id"), "colors"))


def concat(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = insert(out, t)
    return out


def remove(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Drop the rows named in ``places`` (row_id) and close the gaps."""
    left = rows.join(places.select("row_id").distinct(), "row_id", "left_anti").withColumnRenamed("row_id", "__old")
    return dense_ids(left, "__old", "row_id").select("row_id", "colors")


def swap(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exchange rows pairwise; ``pairs`` has disjoint (a, b)."""
    moves = pairs.select(F.col("a").alias("row_id"), F.col("b").alias("__to")).unionByName(pairs.select(F.col("b").alias("row_id"), F.col("a").alias("__to")))
    return rows.join(moves, "row_id", "left").select(F.coalesce("__to", "row_id").alias("row_id"), "colors")


def stats(rows: DataFrame, n_colors: Column | int) -> DataFrame:
    """n_rows, n_cols, set_bits, density (%), n_unique."""
    n = F.lit(n_colors) if isinstance(n_colors, int) else n_colors
    by_set = rows.groupBy("colors").agg(F.count("*").alias("n"))
    out = by_set.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum(F.col("n") * F.size("colors")), F.lit(0)).cast("long").alias("set_bits"), F.count("*").alias("n_unique"))
    return out.select("n_rows", n.cast("long").alias("n_cols"), "set_bits", (F.lit(100.0) * F.col("set_bits") / (F.col("n_rows") * n)).alias("density"), "n_unique", F.greatest(F.col("n_unique") - 1, F.lit(0)).alias("n_internal"))


def pairwise(rows: DataFrame, fold, name: str) -> DataFrame:
    """``fold`` of each row with the row behind it."""
    other = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("colors").alias("__b"))
    return rows.join(other, "row_id").select("row_id", fold(F.col("colors"), F.col("__b")).alias(name))


def folded(rows: DataFrame, key: str, how: str) -> DataFrame:
    """(key, colors): colours that all rows of a group have (``how`` "and"), or that any has ("or"), by counting and not by lists."""
    each = rows.select(key, F.explode("colors").alias("c"))
    groups = rows.groupBy(key).agg(F.count("*").alias("__n"))
    kept = each.groupBy(key, "c").agg(F.count("*").alias("__m")).join(groups, key).where(F.lit(how == "or") | (F.col("__m") == F.col("__n")))
    sets = kept.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("colors"))
    return groups.select(key).join(sets, key, "left").withColumn("colors", F.coalesce("colors", F.array().cast("array<int>")))


def cooccurrence(annotation: DataFrame, key: str = "edge_id") -> DataFrame:
    """(a, b, n): how many rows carry both colours, a < b."""
    return cooccurrence_of_sets(annotation.groupBy(key).agg(F.array_sort(F.collect_set("color_id")).alias("colors")))


def cooccurrence_of_sets(rows: DataFrame) -> DataFrame:
    """The same from rows with their colours; equal rows are expanded once."""
    sets = rows.groupBy("colors").agg(F.count("*").alias("n"))
    a = sets.select("colors", "n", F.explode("colors").alias("a"))
    pairs = a.select("n", "a", F.explode(F.filter("colors", lambda c: c > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each table and rows (with repeats) that only one has; both go through one exchange."""
    sides = a.select("*", F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(b.select("*", F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    each = sides.groupBy(*a.columns).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    more = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    sums = {"n_left": F.sum("__l"), "n_right": F.sum("__r"), "only_left": more("__l", "__r"), "only_right": more("__r", "__l")}
    return each.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(name) for name, x in sums.items()])


def same_table(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns) and difference(a, b).where("only_left + only_right > 0").isEmpty()


def flatten(rows: DataFrame, n_colors: int) -> DataFrame:
    """Set bits of the whole matrix as one sparse vector: row * columns + colour."""
    return rows.select(F.explode("colors").alias("c"), "row_id").select((F.col("row_id") * n_colors + F.col("c")).alias("bit"))


def packed(rows: DataFrame, n_colors: int) -> DataFrame:
    return rows.select("row_id", C.words(F.col("colors"), n_colors).alias("words"))


def first_rows(rows: DataFrame, n: int = 1_000_000) -> DataFrame:
    """The first rows in order; a filter on the dense id, not a sort."""
    return rows.where(F.col("row_id") < n)


