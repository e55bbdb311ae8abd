"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame operators only. Documents' words are counted once; all that follows works on narrow rows.
Each source is cut into blocks of permuted documents, BLOCKS of them or as many as leave about
BLOCK_WORDS words in each. The source's target gives its block quota: how many blocks, in
permuted order and pass after pass, fill it (the last one in part).

The tree starts with the quotas of all sources and ends with those of each output shard: at
each node the units of all quotas are permuted and the left half of the shards gets the first of them,
which draws the sources' counts on both sides from the multivariate hypergeometric law. Each
shard then draws its quota of a source as the next blocks in that source's permuted order:
blocks of one pass are disjoint, so shards are too. What the shards drew is what documents are
taken for; within a shard they come in order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Blocks of a source, at least, and words of a block, about, where that gives more.
BLOCKS = 128
BLOCK_WORDS = 1_000_000
SHARDS = 16
#: Parts of a shard that are permuted side by side.
PARTS = 16
SEED = 5


def word_count(text: Column) -> Column:
    """Number of runs outside space and \\t to \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Target words of each source: weight shares of ``share`` times all words, none above ``cap`` times its size.

    ``sizes`` has source and source_size. Sources take the weights in turn by code point, null
    last. Water filling in closed form: sources in order of size for weight are full as long
    as the level reached by those after them is above their own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(filling), F.lit(0.0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(filling), F.lit(0.0)))
    levelled = ranked.withColumn("__level", level).withColumn("__full", F.col("__cap") <= F.col("__w") * F.col("__level"))
    final = F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level")))).over(everything)
    return levelled.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__w") * final.getField("__level"))).select("source", "source_size", "target")


def permuted_blocks(placed: DataFrame, seed: int) -> DataFrame:
    """Non-empty blocks (source, block, block_size, source_size, target) with their place ``at`` in the source's permuted order,
    the source's number of blocks ``n``, its block quota and ``rest``, the words wanted of the quota's last block."""
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).where("block_size > 0")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    words = F.round("target").cast("long")
    ordered = blocks.withColumn("at", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = ordered.withColumn("passes", F.floor(words / F.col("source_size")).cast("long")).withColumn("over", words - F.col("passes") * F.col("source_size"))
    own = Window.partitionBy("source")
    counted = ordered.withColumn("n", F.count("*").over(own)).withColumn("more", F.count_if(F.col("before") < F.col("over")).over(own))
    counted = counted.withColumn("quota", F.col("passes") * F.col("n") + F.col("more"))
    return counted.withColumn("rest", F.least("block_size", F.col("over") - F.col("before"))).drop("passes", "over", "before", "more")


def _halved(units: DataFrame, h: Column) -> DataFrame:
    """One level of the tree: each node's (lo, hi) units in order of ``h``, the first to the left half of its shards.

    Ranks are counted within 64 ranges of the hash; a small table has what lies before each range.
    """
    node = ["lo", "hi"]
    placed = units.withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 58))
    before = Window.partitionBy(*node).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*node, "range").agg(F.count("*").alias("c"))
    sizes = sizes.select(*node, "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"), F.sum("c").over(Window.partitionBy(*node)).alias("all"))
    within = Window.partitionBy(*node, "range").orderBy("h", "source", "unit")
    ranked = placed.withColumn("i", F.row_number().over(within) - 1).join(sizes, [*node, "range"])
    mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
    left = F.col("i") + F.col("off") < F.round(F.col("all") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return ranked.select("source", "unit", F.when(left, F.col("lo")).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(F.col("hi")).alias("hi"))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, quota): source quotas (source, quota) split among shards, level by level."""
    units = quotas.where("quota > 0").select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("unit"))
    out = cut(units.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards)))
    for depth in range((shards - 1).bit_length()):
        out = cut(_halved(out, F.xxhash64(F.lit(seed + 100 + depth), "source", "unit")))
    return out.groupBy("source", F.col("lo").alias("shard")).agg(F.count("*").alias("quota"))


def drawn_blocks(blocks: DataFrame, leaves: DataFrame) -> DataFrame:
    """(source, block, takes): for each block the shards that draw it, pass by pass.

    A source's quotas of the shards, one after the other, cover its permuted order from the
    beginning, again and again; ``words`` of a take is null where it is the whole block.
    """
    upto = Window.partitionBy("source").orderBy("shard")
    places = leaves.withColumn("end", F.sum("quota").over(upto)).withColumn("begin", F.col("end") - F.col("quota"))
    units = places.select("source", "shard", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("unit"))
    facts = blocks.groupBy("source").agg(F.first("n").alias("n"), F.first("quota").alias("all")).withColumnRenamed("source", "__s")
    met = units.join(facts, F.col("source").eqNullSafe(F.col("__s"))).select(F.col("source").alias("__s"), F.pmod("unit", "n").alias("__at"), F.floor(F.col("unit") / F.col("n")).alias("pass"), "shard", (F.col("unit") == F.col("all") - 1).alias("last"))
    own = blocks.join(met, F.col("source").eqNullSafe(F.col("__s")) & (F.col("at") == F.col("__at")))
    part = F.col("last") & (F.col("rest") > 0) & (F.col("rest") < F.col("block_size"))
    take = F.struct("pass", "shard", F.when(part, F.col("rest")).alias("words"))
    return own.groupBy("source", "block").agg(F.array_sort(F.collect_list(take)).alias("takes"))  # one take for each pass


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, identity: tuple[str, ...] = ("doc_id",), seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """(identity columns, source, size, source_size, target, passes, head_words, taken, shards): how often the mix takes each document.

    ``docs`` needs source, text and the identity columns, of which size and the order of documents
    depend on nothing else; other columns are not read, whatever their names. passes counts whole takes, head_words
    the words of one further take in part (or 0), shards has the output shard of each take. Each source's
    taken words equal its rounded target. Null and empty texts have size 0 and are never
    taken; texts are counted whole, however long; a null source is a source of its own, last in
    order; equal rows are interchangeable; an empty table gives no rows.
    """
    texts = F.xxhash64("text")
    names = [f"__k{i}" for i in range(len(identity))]
    sized = cut(docs.select(*[F.col(c).alias(n) for c, n in zip(identity, names, strict=True)], "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *identity, texts).alias("h")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n_blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("int")
    targets = source_targets(sizes, list(weights), share, cap).select(F.col("source").alias("__s"), "source_size", "target", n_blocks.alias("n_blocks"))
    targets = cut(targets)  # a row for each source
    placed = sized.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("block", F.pmod("h", "n_blocks").cast("int")).drop("n_blocks")
    blocks = cut(permuted_blocks(placed, seed))
    leaves = cut(split_tree(blocks.select("source", "quota").distinct(), shards, seed))
    drawn = cut(drawn_blocks(blocks, leaves).select(F.col("source").alias("__s"), F.col("block").alias("__b"), "takes"))
    joined = placed.join(drawn, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left").drop("__s", "__b")
    whole = F.filter("takes", lambda t: t["words"].isNull())
    part = F.filter("takes", lambda t: t["words"].isNotNull())
    joined = joined.withColumn("passes", F.coalesce(F.when(F.col("size") > 0, F.size(whole)), F.lit(0)).cast("long")).withColumn("rest", F.get(part, F.lit(0))["words"])
    # only the one block of a source that is drawn in part needs its documents in order
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "h"), "h", *names).rowsBetween(Window.unboundedPreceding, -1)
    full = joined.where("rest is null").withColumn("head_words", F.lit(0).cast("long"))
    split = joined.where("rest is not null").withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("head_words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).drop("before")
    both = full.unionByName(split)
    used = F.filter("takes", lambda t: (F.col("size") > 0) & (t["words"].isNull() | (F.col("head_words") > 0)))
    shown = F.coalesce(F.transform(used, lambda t: t["shard"]), F.array().cast("array<int>"))
    return both.select(*[F.col(n).alias(c) for c, n in zip(identity, names, strict=True)], "source", "size", "source_size", "target", "passes", "head_words", (F.col("passes") * F.col("size") + F.col("head_words")).alias("taken"), shown.alias("shards"))


def op4(docs: DataFrame) -> DataFrame:
    """The contract's digest; rows that share a doc_id but not the text are documents of their own."""
    out = mix_sources(docs)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: each is repeated as often as it is taken.

    A document of which the mix takes only some words comes whole if that is at least half
    of it, and not otherwise. Columns are those of ``docs``, whatever their names; rows that are alike in all
    columns (but maps) are interchangeable. Rows lie by shard and by part of a shard (a random deal of its rows to
    PARTS), and in random order in each; the order depends on the rows and the seed alone.
    """
    names = docs.columns
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.select(F.xxhash64(*plain).alias("__id"), "*")
    taken = mix_sources(rows.select("__id", "source", "text"), identity=("__id",), seed=seed)
    kept = F.when((F.col("head_words") > 0) & (F.col("head_words") * 2 < F.col("size")), F.slice("shards", F.lit(1), F.size("shards") - 1)).otherwise(F.col("shards"))
    homes = taken.where("taken > 0").groupBy("__id").agg(F.flatten(F.collect_list(kept)).alias("__shards"))
    once = rows.join(homes, "__id").withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy("__id"))).where("__n = 1")
    copies = once.select("*", F.posexplode("__shards").alias("__copy", "__shard")).withColumn("__slot", F.xxhash64(F.lit(seed + 3), "__id", "__copy"))
    dealt = copies.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed + 4), "__slot"), F.lit(PARTS)))
    return dealt.repartition("__shard", "__part").sortWithinPartitions("__shard", "__part", "__slot").select(*names)
