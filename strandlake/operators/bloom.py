"""Bloom-filter annotation: build, probe, occupancy, path correction, evaluation.

bloom_meta (color_id, n_bits, num_hash)    bloom_bits (color_id, bit)

Filters are sets of rows, so build is a distinct and a probe is a join by equal keys; the number of hash
functions is kept with the filters. Sizes count all windows of a colour, or its distinct
ones with ``sizing="distinct"``, or those of its first record with ``sizing="first"``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import bloom_math as B
from strandlake.functions import sequence as S

from .graph import degrees as graph_degrees
from .graph import next_edges, sampled, with_parts
from .lineage import cut


#: Steps of the ladder of sizes: so many to a doubling, and the most different sizes that a probe takes.
LADDER, MOST_SIZES = 4, 4096


def sizes(occurrences: DataFrame, factor: float, num_hash: int, *, color: str = "color_id", sizing: str = "windows", rec: str = "rec_ord", ladder: bool = False) -> DataFrame:
    """bloom_meta: n_bits = int(factor * elements + 1) for each colour; with ``ladder`` rounded up to a few common sizes."""
    if sizing == "distinct":
        n = occurrences.groupBy(color).agg(F.countDistinct("kmer").alias("n"))
    elif sizing == "first":
        per = occurrences.groupBy(color, rec).agg(F.count("*").alias("n"))
        n = per.groupBy(color).agg(F.min_by("n", rec).alias("n"))
    else:
        n = occurrences.groupBy(color).agg(F.count("*").alias("n"))
    bits = F.floor(F.lit(float(factor)) * F.col("n") + 1)
    if ladder:
        bits = F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2(bits) * LADDER) / LADDER))
    return n.select(F.col(color).alias("color_id"), bits.cast("long").alias("n_bits"), F.lit(num_hash).alias("num_hash"))


def build(pairs: DataFrame, meta: DataFrame, hashed=B.portable_hash) -> DataFrame:
    """bloom_bits of (kmer, color_id) pairs; hashing is done once per distinct pair."""
    joined = pairs.select("kmer", "color_id").distinct().join(meta, "color_id")
    each = joined.select("color_id", "n_bits", "kmer", F.explode(F.sequence(F.lit(0), F.col("num_hash") - 1)).alias("j"))
    return each.select("color_id", F.pmod(hashed(F.col("kmer"), F.col("j")), F.col("n_bits")).alias("bit")).distinct()


def sliced(meta: DataFrame, bits: DataFrame) -> DataFrame:
    """(n_bits, num_hash, bit, colors): all filters of one size together, a row for each bit that one of them has."""
    each = bits.join(meta, "color_id")
    return each.groupBy("n_bits", "num_hash", "bit").agg(F.array_sort(F.collect_set("color_id")).alias("colors"))


def probe(kmers: DataFrame, meta: DataFrame, bits: DataFrame, *, num_hash: int | None = None, colors: tuple[int, ...] | None = None, hashed=B.portable_hash) -> DataFrame:
    """(kmer, color_id) for every colour whose filter has all bits of the k-mer.

    A k-mer is asked once for each hash function and each size that filters have, by equal keys, whatever the number of
    colours; the colour lists that it finds are intersected. A colour without a filter never matches. ``num_hash``
    probes with another number of functions, ``colors`` with some filters. The sizes come to the driver; a graph of
    more than MOST_SIZES different ones needs filters on the ladder (see ``sizes``).
    """
    if colors is not None:
        meta = meta.where(F.col("color_id").isin(list(colors)))
    probes = meta if num_hash is None else meta.withColumn("num_hash", F.lit(num_hash))
    kinds = probes.where("num_hash > 0").select("n_bits", "num_hash").distinct().limit(MOST_SIZES + 1).collect()
    if len(kinds) > MOST_SIZES:
        raise ValueError("filters of so many sizes can't be probed together; build them with ladder=True")
    if not kinds:
        return kmers.select("kmer", F.lit(0).alias("color_id")).limit(0)
    most = max(r["num_hash"] for r in kinds)
    hashes = F.array(*[hashed(F.col("kmer"), F.lit(j)) for j in range(most)])
    size = F.explode(F.array(*[F.struct(F.lit(r["n_bits"]).cast("long").alias("n_bits"), F.lit(r["num_hash"]).cast("int").alias("num_hash")) for r in sorted(kinds)]))
    each = kmers.select("kmer").distinct().select("kmer", hashes.alias("h")).select("kmer", "h", size.alias("s"))
    asked = each.select("kmer", "s.n_bits", "s.num_hash", F.posexplode(F.slice("h", F.lit(1), F.col("s.num_hash"))).alias("j", "h"))
    at = asked.select("kmer", "n_bits", "num_hash", "j", F.pmod("h", "n_bits").alias("bit"))
    hits = at.join(sliced(probes, bits), ["n_bits", "num_hash", "bit"]).groupBy("kmer", "n_bits", "num_hash").agg(F.collect_list("colors").alias("lists"))  # a list a hash function at most
    full = hits.where(F.size("lists") == F.col("num_hash"))
    both = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return full.select("kmer", F.explode(both).alias("color_id"))


def occupancy(meta: DataFrame, bits: DataFrame) -> DataFrame:
    """(color_id, n_set, occupancy): set bits over the bits of all whole words."""
    n = bits.groupBy("color_id").agg(F.count("*").alias("n_set"))
    words = 64 * (F.floor(F.col("n_bits") / 64) + 1)
    return meta.join(n, "color_id", "left").select("color_id", "n_bits", F.coalesce("n_set", F.lit(0)).alias("n_set"), (F.coalesce("n_set", F.lit(0)) / words).alias("occupancy"))


def chains(edges: DataFrame, k: int) -> DataFrame:
    """(edge_id, unitig, place, cyclic): maximal non-branching paths of non-dummy edges.

    Links join an edge to the one that follows through a node with one way in and one out.
    Heads are found by pointer doubling, so the number of joins is the logarithm of the
    longest path. A cycle starts at its least edge.
    """
    degree = graph_degrees(edges, k).where((F.col("out_degree") == 1) & (F.col("in_degree") == 1)).select(F.col("edge_id").alias("b"))
    solid = edges.where(~S.is_dummy(F.col("kmer")))
    follow = next_edges(solid, k).where(F.col("next_id").isNotNull()).select(F.col("edge_id").alias("a"), F.col("next_id").alias("b")).join(degree, "b", "left_semi")
    solid, links = cut(solid.select("edge_id")), cut(follow)
    rounds = solid.count().bit_length() + 1

    def climb(before: DataFrame) -> DataFrame:
        state = solid.select("edge_id").join(before.select(F.col("b").alias("edge_id"), F.col("a").alias("up")), "edge_id", "left")
        state = state.select("edge_id", F.coalesce("up", "edge_id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"), F.least("edge_id", F.coalesce("up", "edge_id")).alias("least"))
        state, last = cut(state), None
        for _ in range(rounds):
            above = state.select(F.col("edge_id").alias("up"), F.col("up").alias("up2"), F.col("place").alias("more"), F.col("least").alias("least2"))
            state = state.join(above, "up").select("edge_id", F.col("up2").alias("up"), (F.col("place") + F.col("more")).alias("place"), F.least("least", "least2").alias("least"))
            state = cut(state)
            now = state.agg(F.sum("up"), F.max("place")).first()
            if last is not None and now[0] == last[0] and now[1] == last[1]:
                break
            last = now
        return state

    first = climb(links)
    heads = links.select(F.col("b").alias("up")).distinct()
    cyclic = first.join(heads, "up", "left_semi").select("least").distinct()
    if cyclic.isEmpty():
        return first.select("edge_id", F.col("up").alias("unitig"), "place", F.lit(False).alias("cyclic"))
    opened = climb(links.join(cyclic.withColumnRenamed("least", "b"), "b", "left_anti"))
    marks = cyclic.select(F.col("least").alias("up"), F.lit(True).alias("c"))
    return opened.join(marks, "up", "left").select("edge_id", F.col("up").alias("unitig"), "place", F.coalesce("c", F.lit(False)).alias("cyclic"))


#: Edges of a path that one task walks, beside those that walks can reach from them.
SEGMENT = 4096


def _fold(rows: list[int], cyclic: bool, cutoff: int, wanted: list[bool], entered: bool) -> list[tuple[int, int]]:
    """Corrected rows along one path and the steps taken, where wanted; rows are bit masks.

    Each try to go on is a step; backwards, the try to leave the path counts if it is ``entered`` through a node with one way.
    """
    n, out = len(rows), []
    for i, cur in enumerate(rows):
        steps = 0
        for step in (1, -1) if cur and wanted[i] else ():
            at, quiet = i, 0
            while quiet < cutoff:
                quiet += 1
                at += step
                if not 0 <= at < n:
                    if not cyclic:
                        steps += step > 0 or entered
                        break
                    at %= n
                steps += 1
                new = cur & rows[at]
                if not new:
                    break
                if new != cur:
                    cur, quiet = new, 0
        out.append((cur, steps))
    return out


def corrected_rows(edges: DataFrame, raw: DataFrame, k: int, cutoff: int = 50, starts: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """(edge_id, colors, steps) after path correction with both node tests, of all edges or of ``starts`` (edge_id).

    Each edge keeps the colours that its unitig's edges share, read outwards until ``cutoff`` edges in a row change nothing
    or nothing would be left. Dummies keep none. A walk loses a colour at least every ``cutoff`` edges, so it ends
    within cutoff times the colours of the fullest row. Unitigs are cut into segments that have so many edges more on both
    sides; long circles are laid out with their ends repeated. Only segments with edges that are asked for are walked.
    """
    sets = cut(raw.groupBy("edge_id").agg(F.array_sort(F.collect_set("color_id")).alias("colors")))
    halo = cutoff * (sets.agg(F.max(F.size("colors"))).first()[0] or 0)
    lines = cut(chains(edges, k))
    one_way = graph_degrees(edges, k).where((F.col("out_degree") == 1) & (F.col("in_degree") == 1)).select(F.col("edge_id").alias("unitig"), F.lit(True).alias("entered"))
    lengths = lines.groupBy("unitig").agg((F.max("place") + 1).alias("n")).join(one_way, "unitig", "left")
    rows = lines.join(lengths, "unitig")
    whole = (F.col("n") <= segment) | (F.col("cyclic") & (F.col("n") <= halo))
    turns = F.when(F.col("cyclic") & ~whole, F.array(F.lit(0).cast("long"), F.col("n"), -F.col("n"))).otherwise(F.array(F.lit(0).cast("long")))
    laid = rows.withColumn("whole", whole).withColumn("turn", F.explode(turns)).withColumn("q", F.col("place") + F.col("turn"))
    number = lambda x: F.floor(x / segment)
    low, high = F.greatest(F.lit(0), number(F.col("q") - halo)), F.least(number(F.col("n") - 1), number(F.col("q") + halo))
    spread = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    parts = laid.withColumn("part", F.explode(spread)).withColumn("own", (F.col("turn") == 0) & (F.col("whole") | (number(F.col("q")) == F.col("part"))))
    if starts is not None:
        named = starts.select("edge_id").distinct().withColumn("named", F.lit(True))
        parts = parts.join(named, "edge_id", "left").withColumn("own", F.col("own") & F.col("named").isNotNull())
        parts = parts.join(parts.where("own").select("unitig", "part").distinct(), ["unitig", "part"], "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        first = pdf.iloc[0]
        masks = [sum(1 << int(c) for c in cs) if cs is not None else 0 for cs in pdf["colors"]]
        walked = _fold(masks, bool(first["cyclic"] and first["whole"]), cutoff, pdf["own"].tolist(), bool(first["entered"]))
        kept = [(e, [c for c in range(m.bit_length()) if m >> c & 1], n) for e, own, (m, n) in zip(pdf["edge_id"], pdf["own"], walked, strict=True) if own]
        return pd.DataFrame(kept, columns=["edge_id", "colors", "steps"])

    ready = parts.join(sets, "edge_id", "left").select("unitig", "part", "edge_id", "q", "own", "cyclic", "whole", F.coalesce("entered", F.lit(False)).alias("entered"), "colors")
    return ready.groupBy("unitig", "part").applyInPandas(walk, "edge_id long, colors array<int>, steps long")


def corrected(edges: DataFrame, raw: DataFrame, k: int, cutoff: int = 50, segment: int = SEGMENT) -> DataFrame:
    """(edge_id, color_id) of ``corrected_rows``."""
    return corrected_rows(edges, raw, k, cutoff, segment=segment).select("edge_id", F.explode("colors").alias("color_id"))


def corrected_one_way(edges: DataFrame, raw: DataFrame, k: int, cutoff: int) -> DataFrame:
    """(edge_id, color_id) of ``corrected_rows_one_way``."""
    return corrected_rows_one_way(edges, raw, k, cutoff).select("edge_id", F.explode("colors").alias("color_id"))


def corrected_rows_one_way(edges: DataFrame, raw: DataFrame, k: int, cutoff: int = 50, starts: DataFrame | None = None) -> DataFrame:
    """(edge_id, colors, steps) after correction that tests the way out forwards and the way in backwards only.

    Paths may merge, so every edge (or those of ``starts``) walks by itself: one join with the neighbour table for
    each step, over the edges that still walk. Edges without colours aren't walked and have no row.
    """
    solid = edges.where(~S.is_dummy(F.col("kmer")))
    sets = solid.select("edge_id").join(raw.groupBy("edge_id").agg(F.array_sort(F.collect_set("color_id")).alias("colors")), "edge_id")
    solid, sets = cut(solid), cut(sets)
    degree = graph_degrees(edges, k)
    follow = next_edges(solid, k).where(F.col("next_id").isNotNull())
    forward = follow.join(degree.where("out_degree = 1").select(F.col("edge_id").alias("next_id")), "next_id").select(F.col("edge_id").alias("at"), F.col("next_id").alias("to"))
    parts = with_parts(solid, k)
    behind = parts.groupBy(F.col("dst").alias("src")).agg(F.min_by("edge_id", S.letter_rank(F.substring("kmer", 1, 1))).alias("to"))
    single = degree.where("in_degree = 1").select("edge_id")
    backward = parts.join(single, "edge_id", "left_semi").join(behind, "src", "left").select(F.col("edge_id").alias("at"), "to")
    state = sets if starts is None else sets.join(starts.select("edge_id").distinct(), "edge_id", "left_semi")
    state = state.select("edge_id", F.col("edge_id").alias("at"), "colors", F.lit(0).cast("long").alias("steps"))
    for ways, counted in ((forward, F.lit(True)), (backward, F.col("known").isNotNull())):
        table = cut(ways.join(sets.select(F.col("edge_id").alias("to"), F.col("colors").alias("there")), "to", "left").withColumn("known", F.lit(True)))
        walking, finished = state.select("edge_id", F.col("edge_id").alias("at"), "colors", F.lit(0).alias("quiet"), "steps"), None
        while True:
            seen = walking.join(table, "at", "left")
            new = F.array_intersect("colors", F.coalesce("there", F.array().cast("array<int>")))
            tries = (F.col("quiet") < cutoff) & counted
            seen = seen.withColumn("new", new).withColumn("stop", (F.col("quiet") >= cutoff) | F.col("to").isNull() | (F.size("new") == 0)).withColumn("steps", F.col("steps") + tries.cast("long"))
            seen = cut(seen)
            ended = seen.where("stop").select("edge_id", "colors", "steps")
            finished = ended if finished is None else finished.unionByName(ended)
            walking = seen.where("not stop").select("edge_id", F.col("to").alias("at"), F.array_sort("new").alias("colors"), F.when(F.size("new") < F.size("colors"), 0).otherwise(F.col("quiet") + 1).alias("quiet"), "steps")
            if walking.isEmpty():
                break
        state = finished
    return state.select("edge_id", "colors", "steps")


def evaluated(edges: DataFrame, exact: DataFrame, raw: DataFrame, k: int, n: int, cutoff: int = 50, both: bool = True) -> DataFrame:
    """``evaluation`` of about n edges at even steps (dummies left out), and the steps that correcting them takes.

    Only walks from these edges are made.
    """
    some = cut(sampled(edges, n))
    rows = cut(corrected_rows(edges, raw, k, cutoff, some) if both else corrected_rows_one_way(edges, raw, k, cutoff, some))
    report = evaluation(some, exact, raw, rows.select("edge_id", F.explode("colors").alias("color_id")))
    return report.join(F.broadcast(rows.agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("n_steps"))))  # one row each


def evaluation(edges: DataFrame, exact: DataFrame, raw: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row: edges and bits, false positives before and after correction, false negatives after it."""
    mark = lambda df, name: df.select("edge_id", "color_id", F.lit(1).alias(name))
    solid = edges.where(~S.is_dummy(F.col("kmer"))).select("edge_id")
    all_pairs = mark(exact, "e").join(mark(raw, "r"), ["edge_id", "color_id"], "full").join(mark(fixed, "c"), ["edge_id", "color_id"], "full")
    pairs = solid.join(all_pairs, "edge_id").select("edge_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("e", "r", "c")])
    by_edge = pairs.groupBy("edge_id").agg(F.sum("e").alias("bits"), F.sum(F.expr("int(r = 1 and e = 0)")).alias("fp_pre"), F.sum(F.expr("int(c = 1 and e = 0)")).alias("fp_post"), F.sum(F.expr("int(c = 0 and e = 1)")).alias("fn_post"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = solid.join(by_edge, "edge_id", "left").agg(F.count("*").alias("n_edges"), total("bits").alias("n_bits_exact"), total("fp_pre").alias("fp_bits_pre"), total("fp_post").alias("fp_bits_post"), total("fn_post").alias("fn_bits_post"), F.count_if(F.col("fp_pre") > 0).alias("fp_edges_pre"), F.count_if(F.col("fp_post") > 0).alias("fp_edges_post"), F.count_if(F.col("fn_post") > 0).alias("fn_edges_post"))
    return out.withColumn("fp_per_edge_pre", F.col("fp_bits_pre") / F.col("n_edges")).withColumn("fp_per_edge_post", F.col("fp_bits_post") / F.col("n_edges"))
