"""The binary prefix tree over the rows of a table, as tables.

    nodes   (node_id, parent_id, side, split, label, size, ones)    split is null in leaves
    blocks  (node_id, block, before, ones)                          BLOCK rows of an inner node each

Rows are read as bits from colour 0 on. An inner node's rows agree up to its ``split``; there some have the bit and
go to the right child, in their order, the others to the left one. ``label`` has the colours between the parent's split
and the node's own (to the end, in a leaf). A block has the places of its ones and the number of ones before it in
the node, so the rank of any place is one block's work, and a row is found by going down from place to rank.

Nothing is built level by level: which splits a distinct row passes follows from the colours that rows with the same
first colours have next, a grouping; only distinct rows are taken through it. Rows meet their nodes by the
number of their set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dense_ids
from .lineage import cut, few

BLOCK = 4096
END = 2**31 - 1


def _paths(sets: DataFrame) -> DataFrame:
    """(set_id, colors, begin, split, bit) of the inner nodes that each distinct row passes."""
    each = sets.select("set_id", "colors", F.explode(F.sequence(F.lit(0), F.size("colors"))).alias("j"))
    following = F.when(F.col("j") < F.size("colors"), F.get("colors", F.col("j"))).otherwise(F.lit(END))
    each = cut(each.select("set_id", "colors", F.slice("colors", F.lit(1), F.col("j")).alias("begin"), following.alias("next")))
    ways = each.groupBy("begin").agg(F.array_sort(F.collect_set("next")).alias("ways")).where(F.size("ways") > 1)  # a way a colour at most
    splits = ways.select("begin", F.slice("ways", F.lit(1), F.size("ways") - 1).alias("splits"))
    passed = each.join(splits, "begin").select("set_id", "colors", "begin", "next", F.explode(F.filter("splits", lambda s: s <= F.col("next"))).alias("split"))
    return passed.select("set_id", "colors", "begin", "split", (F.col("split") == F.col("next")).cast("int").alias("bit"))


def build(rows: DataFrame, sets: DataFrame) -> dict[str, DataFrame]:
    """nodes and blocks of rows (row_id, set_id) with their dictionary (set_id, colors); ids of inner nodes first."""
    paths = cut(_paths(sets))
    inner = cut(dense_ids(paths.select("begin", "split").distinct(), ["split", "begin"], "node_id"))
    on_path = Window.partitionBy("set_id").orderBy("split")  # a row's splits: no more than colours
    placed = paths.join(inner, ["begin", "split"]).withColumn("parent_id", F.lag("node_id").over(on_path)).withColumn("side", F.lag("bit").over(on_path)).withColumn("above", F.coalesce(F.lag("split").over(on_path), F.lit(-1)))
    placed = cut(placed)
    counts = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    between = F.filter("colors", lambda c: (c > F.col("above")) & (c < F.col("split")))
    sized = placed.withColumn("between", between).join(counts, "set_id").groupBy("node_id").agg(F.first("parent_id").alias("parent_id"), F.first("side").alias("side"), F.first("split").alias("split"), F.first("between").alias("label"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("bit")).alias("ones"))
    last = placed.groupBy("set_id").agg(F.max(F.struct("split", "node_id", "bit")).alias("l"))
    leaves = sets.join(counts, "set_id").join(last, "set_id", "left").select("colors", "n", F.col("l.node_id").alias("parent_id"), F.col("l.bit").alias("side"), F.coalesce("l.split", F.lit(-1)).alias("above"), "set_id")
    n_inner = inner.count()
    leaf = leaves.select((F.col("set_id") + n_inner).alias("node_id"), "parent_id", "side", F.lit(None).cast("int").alias("split"), F.filter("colors", lambda c: c > F.col("above")).alias("label"), F.col("n").alias("size"), F.lit(0).cast("long").alias("ones"))
    nodes = sized.unionByName(leaf)
    members = rows.join(few(placed.select("set_id", "node_id", "bit")), "set_id").select("node_id", "row_id", "bit")
    ordered = cut(dense_ids(members, ["node_id", "row_id"], "i"))
    first = ordered.groupBy("node_id").agg(F.min("i").alias("first"))
    spots = ordered.join(few(first), "node_id").withColumn("at", F.col("i") - F.col("first"))
    packed = spots.groupBy("node_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.when(F.col("bit") == 1, (F.col("at") % BLOCK).cast("int")))).alias("ones"))
    before = Window.partitionBy("node_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return {"nodes": cut(nodes), "blocks": cut(packed.withColumn("before", F.coalesce(F.sum(F.size("ones")).over(before), F.lit(0))))}


def _rank(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add bit and rank1 (ones before the place) to rows with node_id and at."""
    inside = (F.col("at") % BLOCK).cast("int")
    joined = places.withColumn("block", F.floor(F.col("at") / BLOCK)).join(blocks, ["node_id", "block"])
    return joined.withColumn("bit", F.array_contains("ones", inside).cast("int")).withColumn("rank1", F.col("before") + F.size(F.filter("ones", lambda x: x < inside))).drop("block", "before", "ones")


def ranks(tree: dict[str, DataFrame], places: DataFrame) -> DataFrame:
    """places (node_id, at) with bit, rank0 and rank1: zeros and ones of the inner node before the place."""
    return _rank(places, tree["blocks"]).withColumn("rank0", F.col("at") - F.col("rank1"))


def is_leaf(split: Column) -> Column:
    return split.isNull()


def at(tree: dict[str, DataFrame], wanted: DataFrame, before: int | None = None) -> DataFrame:
    """(row_id, colors) of wanted rows (row_id), or their colours below ``before``, by going down from the root."""
    nodes = tree["nodes"]
    root = nodes.where("parent_id IS NULL").select("node_id", "split", "label")
    state = wanted.select("row_id", F.col("row_id").alias("at")).join(F.broadcast(root), F.lit(True)).select("row_id", "at", "node_id", "split", F.col("label").alias("colors"))  # one root
    children = cut(nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.col("side").alias("bit"), F.col("node_id").alias("child"), F.col("split").alias("deeper"), "label"))
    done = None
    while True:
        ended = is_leaf(F.col("split")) | (F.lit(False) if before is None else F.col("split") >= before)
        state = cut(state)
        found = state.where(ended).select("row_id", "colors")
        done = found if done is None else done.unionByName(found)
        going = state.where(~ended)
        if going.isEmpty():
            break
        down = _rank(going, tree["blocks"]).join(children, ["node_id", "bit"])
        own = F.when(F.col("bit") == 1, F.array("split")).otherwise(F.array().cast("array<int>"))
        state = down.select("row_id", F.when(F.col("bit") == 1, F.col("rank1")).otherwise(F.col("at") - F.col("rank1")).alias("at"), F.col("child").alias("node_id"), F.col("deeper").alias("split"), F.concat("colors", own, "label").alias("colors"))
    return done if before is None else done.withColumn("colors", F.filter("colors", lambda c: c < before))


def check(tree: dict[str, DataFrame]) -> DataFrame:
    """One row: nodes, leaves, rows of the root, and how many inner nodes contradict their children or their blocks."""
    nodes = tree["nodes"]
    below = nodes.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum(F.when(F.col("side") == 0, F.col("size"))).alias("zeros_below"), F.sum(F.when(F.col("side") == 1, F.col("size"))).alias("ones_below"), F.count("*").alias("children"))
    held = tree["blocks"].groupBy("node_id").agg(F.sum(F.size("ones")).alias("bits"))
    inner = nodes.where(~is_leaf(F.col("split"))).join(below, "node_id", "left").join(held, "node_id", "left")
    good = (F.col("children") == 2) & (F.col("ones_below") == F.col("ones")) & (F.col("zeros_below") == F.col("size") - F.col("ones")) & (F.col("bits") == F.col("ones"))
    wrong = inner.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("n_wrong"), F.coalesce(F.sum("size"), F.lit(0)).alias("beta_bits"))
    total = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(is_leaf(F.col("split"))).alias("n_leaves"), F.coalesce(F.max(F.when(F.col("parent_id").isNull(), F.col("size"))), F.lit(0)).alias("n_rows"))
    return total.join(F.broadcast(wrong))  # one row each
