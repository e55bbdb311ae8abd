"""Colored k-mer graphs as tables: windows, edges, colours, lookups and neighbours.

records     (rec_ord, color names or color, seq)
edges       (edge_id, kmer)         ids dense from 0 in order of first occurrence
annotation  (edge_id, color_id)     or wide: (edge_id, colors array<int>)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import colorsets as C
from strandlake.functions import sequence as S

from .lineage import cut, few, short

#: Characters of a sequence that one row carries to the window generator.
CHUNK = 256
#: Bits of an occurrence's order that hold its place in the record.
PLACE = 1 << 31


def _slide(rows: DataFrame, keep: tuple[str, ...], e: int) -> DataFrame:
    """(*keep, kmer, pos) of the windows of e characters of ``__s``, places counted from ``__at``.

    Sequences are encoded and so have a byte a letter: they are cut as bytes, where any place is reached at once; cutting
    characters would count them from the start each time. Chunks overlap by e - 1.
    """
    begins = F.sequence(F.lit(0), F.length("__s") - e, F.lit(CHUNK))
    cut_out = F.transform(begins, lambda b: F.struct(b.alias("b"), F.substring(F.col("__s").cast("binary"), b + 1, F.lit(CHUNK + e - 1)).alias("c")))
    chunks = rows.where(F.length("__s") >= e).select(*keep, "__at", F.explode(cut_out).alias("__x")).select(*keep, (F.col("__at") + F.col("__x.b")).alias("__b"), F.col("__x.c").alias("__c"))
    placed = chunks.select(*keep, "__b", "__c", F.explode(F.sequence(F.lit(0), F.octet_length("__c") - e)).alias("__p"))
    return placed.select(*keep, F.substring("__c", F.col("__p") + 1, F.lit(e)).cast("string").alias("kmer"), (F.col("__b") + F.col("__p")).cast("long").alias("pos"))


def windows(records: DataFrame, k: int, *, seq: str = "seq", fold: bool = False, rooted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kmer, pos, *keep): every window of k+1 characters of the encoded, padded sequences.

    Sequences shorter than k+1 give none. Long ones are cut into chunks that overlap by k
    before the windows are made: the work is linear in their length. A sequence of many rows goes to ``segment_windows``.
    """
    ready = records.where(F.length(seq) > k).select(*keep, S.pad(S.encode(F.col(seq), fold), k, rooted).alias("__s"), F.lit(0).cast("long").alias("__at"))
    return _slide(ready, keep, k + 1)


def segment_windows(segments: DataFrame, k: int, *, fold: bool = False, rooted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same windows of sequences that come as segments (start, seq, halo), each row by itself.

    ``halo`` is the k letters that follow a segment, fewer at the sequence's end, so a window lies in the
    segment that it begins in, and long sequences are the work of many tasks. Places are those in the whole padded sequence.
    """
    text = F.concat("seq", F.substring("halo", 1, k))
    end = F.octet_length("halo") < k
    ready = segments.where(F.col("start") + F.length(text) > k).where((F.length("seq") > 0) | (F.col("start") == 0))
    encoded = S.encode(text, fold)
    if rooted:
        return _slide(ready.select(*keep, encoded.alias("__s"), F.col("start").alias("__at")), keep, k + 1)
    first = F.col("start") == 0
    padded = F.concat(F.when(first, S.END * (k + 1)).otherwise(""), encoded, F.when(end, S.END).otherwise(""))
    return _slide(ready.select(*keep, padded.alias("__s"), F.when(first, F.lit(0)).otherwise(F.col("start") + k + 1).cast("long").alias("__at")), keep, k + 1)


def with_reverse(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Each record, and again as its reverse complement; strand 0 and 1."""
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col(seq).alias("s")), F.struct(F.lit(1).alias("strand"), S.reverse_complement(F.col(seq)).alias("s")))
    return records.withColumn("__x", F.explode(both)).withColumn("strand", F.col("__x.strand")).withColumn(seq, F.col("__x.s")).drop("__x")


def occurrence_order(rec_ord: Column, pos: Column, wide: bool = False) -> Column:
    """First-seen order as one number; for files and strands fold them into rec_ord first.

    A long holds record numbers below 2^32 and places below 2^31; ``wide`` (see ``wide_order``) is a decimal for all others.
    """
    if wide:
        return rec_ord.cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)") + pos.cast("decimal(13,0)")
    return rec_ord.cast("long") * PLACE + pos


def wide_order(records: DataFrame, rec_ord: str = "rec_ord", length: Column | None = None) -> bool:
    """Whether the record numbers (or lengths, if given) need the wide form of ``occurrence_order``: a look at the narrow columns."""
    longest = F.lit(0) if length is None else F.max(length)
    seen = records.agg(F.max(F.abs(F.col(rec_ord).cast("decimal(20,0)"))).alias("most"), longest.alias("longest")).first()
    return (seen["most"] or 0) >= 1 << 31 or (seen["longest"] or 0) >= PLACE - 1024


def dense_ids(df: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """Add dense ids from 0 in the order of columns whose values are distinct together.

    One exchange by ranges sorts the rows over all tasks; each row is numbered within its task and the tasks' counts are
    added up (one number a task comes to the driver).
    """
    by = [order] if isinstance(order, str) else order
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    task, inside = F.call_function("shiftright", F.col("__m"), F.lit(33)), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in sorted(ranged.groupBy(task.alias("t")).count().collect()):  # a row a task
        offsets.append((r["t"], before))
        before += r["count"]
    table = df.sparkSession.createDataFrame(offsets, "__t long, __off long")
    return ranged.withColumn("__t", task).join(F.broadcast(table), "__t").withColumn(name, (F.col("__off") + inside).cast("long")).drop("__t", "__off", "__m")  # a row a task


def build_edges(occurrences: DataFrame, order: Column) -> DataFrame:
    """Distinct k-mers with dense ids in first-seen order."""
    first = occurrences.groupBy("kmer").agg(F.min(order).alias("__first"))
    return dense_ids(first, "__first", "edge_id").select("edge_id", "kmer")


def color_table(records: DataFrame, name: str, order: str, prefix: Column | None = None) -> DataFrame:
    """(color_id, name, is_prefix): ids dense in first-seen order."""
    first = records.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("__first"))
    ids = dense_ids(first, ["__first", "name"], "color_id")
    return ids.select(F.col("color_id").cast("int"), "name", (F.lit(False) if prefix is None else prefix).alias("is_prefix"))


def annotate(occurrences: DataFrame, edges: DataFrame, colors: DataFrame, name: str) -> DataFrame:
    """(edge_id, color_id), distinct."""
    pairs = occurrences.select("kmer", F.col(name).alias("name")).distinct()
    return pairs.join(colors.select("name", "color_id"), "name").join(edges, "kmer").select("edge_id", "color_id")


def color_sets_by_kmer(occurrences: DataFrame, colors: DataFrame, name: str) -> DataFrame:
    """(kmer, colors): one shuffle; pairs are made distinct before and after it."""
    named = occurrences.select("kmer", F.col(name).alias("name")).distinct().join(colors.select("name", "color_id"), "name")
    return named.groupBy("kmer").agg(F.array_sort(F.collect_set("color_id")).alias("colors"))


def wide(edges: DataFrame, annotation: DataFrame) -> DataFrame:
    """(edge_id, kmer, colors): edges without a row get the empty set."""
    sets = annotation.groupBy("edge_id").agg(F.array_sort(F.collect_set("color_id")).alias("colors"))
    return edges.join(sets, "edge_id", "left").withColumn("colors", F.coalesce("colors", F.array().cast("array<int>")))


def with_parts(edges: DataFrame, k: int) -> DataFrame:
    kmer = F.col("kmer")
    return edges.withColumn("src", S.source_node(kmer, k)).withColumn("dst", S.target_node(kmer, k)).withColumn("label", S.label(kmer))


def degrees(edges: DataFrame, k: int) -> DataFrame:
    """(edge_id, kmer, out_degree, in_degree) of each edge's source node."""
    parts = with_parts(edges, k)
    incoming = parts.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("in_degree"))
    out = parts.withColumn("out_degree", F.count("*").over(Window.partitionBy("src")))
    return out.join(incoming, "src", "left").select("edge_id", "kmer", "out_degree", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def next_edges(edges: DataFrame, k: int) -> DataFrame:
    """(edge_id, next_id): the first edge, in alphabet order, out of each edge's target node; null if none."""
    parts = with_parts(edges, k)
    first = parts.groupBy(F.col("src").alias("dst")).agg(F.min_by("edge_id", S.letter_rank(F.col("label"))).alias("next_id"))
    return parts.join(first, "dst", "left").select("edge_id", "next_id")


def previous_edges(edges: DataFrame, k: int) -> DataFrame:
    """(edge_id, prev_id): the first edge, in alphabet order of its first letter, into each edge's source node."""
    parts = with_parts(edges, k)
    first = parts.groupBy(F.col("dst").alias("src")).agg(F.min_by("edge_id", S.letter_rank(F.substring("kmer", 1, 1))).alias("prev_id"))
    return parts.join(first, "src", "left").select("edge_id", "prev_id")


def map_kmers(queries: DataFrame, edges: DataFrame, k: int, kmer: str = "query") -> DataFrame:
    """Add valid (length k+1) and edge_id (null on a miss). Queries are looked up as they stand; where edges are few they stay where they are."""
    at = edges.select(F.col("edge_id"), F.col("kmer").alias("__kmer"))
    at = F.broadcast(at) if short(at) else at
    valid = F.length(kmer) == k + 1
    return queries.withColumn("valid", valid).join(at, F.col("valid") & (F.col(kmer) == F.col("__kmer")), "left").drop("__kmer")


def map_colors(queries: DataFrame, edges: DataFrame, annotation: DataFrame, colors: DataFrame, k: int, kmer: str = "query") -> DataFrame:
    """Add edge_id, colors and color_names."""
    hits = map_kmers(queries, edges, k, kmer)
    found = hits.where(F.col("edge_id").isNotNull()).select("edge_id").distinct().join(annotation, "edge_id").join(colors.select("color_id", "name"), "color_id")
    sets = found.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("color_id", "name"))).alias("__c"))
    out = hits.join(sets, "edge_id", "left").withColumn("__c", F.coalesce("__c", F.array().cast("array<struct<color_id:int,name:string>>")))
    return out.withColumn("colors", F.transform("__c", lambda x: x["color_id"])).withColumn("color_names", F.transform("__c", lambda x: x["name"])).drop("__c")


def map_rows(queries: DataFrame, matrix: DataFrame, colors: DataFrame, k: int, kmer: str = "query") -> DataFrame:
    """The same from rows (edge_id, kmer, colors): one join with the queries; each distinct set is named once.

    Few rows of few colours get their names first, and queries stay where they are.
    """
    at = matrix.select("edge_id", F.col("kmer").alias("__kmer"), "colors")
    valid = F.length(kmer) == k + 1
    each = matrix.select("colors").distinct().select("colors", F.explode("colors").alias("color_id")).join(colors.select("color_id", "name"), "color_id")
    named = each.groupBy("colors").agg(F.array_sort(F.collect_list(F.struct("color_id", "name"))).alias("__n")).select("colors", F.transform("__n", lambda x: x["name"]).alias("color_names"))
    none = F.array()
    match = F.col("valid") & (F.col(kmer) == F.col("__kmer"))
    if short(matrix, F.size("colors")):
        out = queries.withColumn("valid", valid).join(F.broadcast(at.join(named, "colors", "left")), match, "left").drop("__kmer")
    else:
        out = queries.withColumn("valid", valid).join(at, match, "left").drop("__kmer").join(few(named), "colors", "left")
    return out.withColumn("colors", F.coalesce("colors", none.cast("array<int>"))).withColumn("color_names", F.coalesce("color_names", none.cast("array<string>")))


def has_color(queries: DataFrame, edges: DataFrame, annotation: DataFrame, color_id: int) -> DataFrame:
    """Queries (kmer) whose edge carries one colour."""
    wanted = annotation.where(F.col("color_id") == color_id).join(edges, "edge_id").select("kmer")
    return queries.join(wanted, "kmer", "left_semi")


def sampled(edges: DataFrame, n: int) -> DataFrame:
    """About n edges at even steps, dummies left out."""
    total = edges.agg(F.count("*").alias("__total"))
    step = F.greatest(F.lit(1), F.floor(F.col("__total") / n))
    return edges.join(F.broadcast(total)).where((F.col("edge_id") % step == 0) & ~S.is_dummy(F.col("kmer"))).drop("__total")


def packed_rows(matrix: DataFrame, n_colors: int) -> DataFrame:
    """(kmer, words as text): the printed form of a matrix row."""
    return matrix.select("kmer", C.words_text(C.words(F.col("colors"), n_colors)).alias("words"))
