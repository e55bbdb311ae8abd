"""Readers of sequence files: FASTA and FASTQ (gzip or not), and index lists of bit rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import colorsets as C
from strandlake.functions import sequence as S
from strandlake.operators.lineage import few

from .numbering import lines, numbered


def _records(spark: SparkSession, paths: list[str] | str, separator: str) -> DataFrame:
    """Pieces between separators; files are split where they can be."""
    return lines(spark, paths, separator).where(F.length(F.trim("value")) > 0)


def read_fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, rec_ord, name, seq); a header is a line that begins with >, the name what stands up to its first white space.

    A record is a row; ``read_fasta_segments`` is for sequences that don't fit one.
    """
    pieces = numbered(_records(spark, paths, "\n>"), "rec_ord")
    parts = F.split(F.regexp_replace("value", "^>", ""), r"\r?\n")
    name = F.regexp_extract(parts[0], r"^(\S*)", 1)
    seq = F.regexp_replace(F.array_join(F.slice(parts, 2, F.size(parts)), ""), r"\s", "")
    return pieces.select("file", "rec_ord", name.alias("name"), seq.alias("seq"))


#: Letters of a segment.
SEGMENT = 1 << 16
PIECES = "file string, block long, rec long, name string, at long, piece string, halo string, open boolean"


def _pieces(text: DataFrame, k: int, segment: int) -> DataFrame:
    """Each block's lines as pieces of sequences: rec counts the block's headers (0: before the first), at letters within rec.

    A block's lines come in order. Every header starts a piece, every block ends with one. ``halo`` has the letters of the
    block behind a piece, k at most; ``open`` marks pieces that the block's end leaves short of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        waiting: list[list] = []  # the last pieces of out, whose halo isn't full
        key, rec, name, at, held, size = None, 0, None, 0, [], 0

        def add(body: str) -> None:
            nonlocal at, waiting
            for row in waiting:
                row[6] += body[: k - len(row[6])]
            waiting = [row for row in waiting if len(row[6]) < k]
            row = [*key, rec, name, at, body, "", False]
            out.append(row)
            waiting.append(row)
            at += len(body)

        def put() -> None:
            nonlocal held, size
            body, held, size = "".join(held), [], 0
            for lo in range(0, len(body), segment):  # a long line
                add(body[lo : lo + segment])
            if not body:
                add(body)

        def close() -> None:
            nonlocal waiting
            put()
            for row in waiting:
                row[7] = True
            waiting = []

        def batch() -> pa.RecordBatch:
            nonlocal out
            n = len(out) - len(waiting)
            cols = list(zip(*out[:n], strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            out = out[n:]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for rows in batches:
            for file, block, value in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != key:
                    if key is not None:
                        close()
                    key, rec, name, at = (file, block), 0, None, 0
                if value.startswith(">"):
                    if rec or held or at:
                        put()
                    rec, name, at, waiting = rec + 1, value[1:].split(None, 1)[0] if value[1:2].strip() else "", 0, []
                    continue
                letters = "".join(value.split())
                held.append(letters)
                size += len(letters)
                if size >= segment:
                    put()
            yield batch()
        if key is not None:
            close()
            yield batch()

    return text.select("file", "block", "value").mapInArrow(run, PIECES)


def read_fasta_segments(spark: SparkSession, paths: list[str] | str, k: int, segment: int = SEGMENT) -> DataFrame:
    """(file, rec_ord, name, start, seq, halo): sequences in segments of about ``segment`` letters, each with the k letters that follow.

    A sequence may be longer than a row, a task or a block of the file: lines are read block by block and
    never moved. What a block leaves open (the record that goes on into it, how long that is so far, the letters
    beyond its end) comes from the table of blocks. ``graph.segment_windows`` makes the windows. Records without
    letters are one empty segment; letters before a file's first header belong to no record and are left out.
    """
    text = lines(spark, paths)
    pieces = _pieces(text, k, segment)
    # one row a block: its headers, letters before the first and after the last header, and its first k letters
    length = F.col("at") + F.length("piece")
    front = F.when((F.col("rec") == 0) & (F.col("at") == 0), F.substring(F.concat("piece", "halo"), 1, k))
    blocks = pieces.groupBy("file", "block").agg(
        F.max("rec").alias("n"),
        F.coalesce(F.max(F.when(F.col("rec") == 0, length)), F.lit(0)).alias("head"),
        F.max(F.when(F.col("open"), length)).alias("tail"),
        F.coalesce(F.max(front), F.lit("")).alias("opening"),
        F.max(F.when(F.col("open"), F.col("name"))).alias("open_name"),
    )
    order = Window.partitionBy("file").orderBy("block")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("grp", F.count_if(F.col("n") > 0).over(so_far))
    blocks = blocks.withColumn("run", F.sum("tail").over(Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.collect_list(F.struct("n", "opening")).over(order.rowsBetween(1, max(k, 1)))  # a block has a letter or a header, so k blocks are enough
    beyond = F.aggregate(ahead, F.struct(F.lit("").alias("s"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"], F.concat(a["s"], x["opening"])).otherwise(a["s"]).alias("s"), (a["go"] & (x["n"] == 0)).alias("go")))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.lag("run").over(order), F.lit(0)).alias("carried"), F.last("open_name", ignorenulls=True).over(earlier).alias("carried_name"), beyond["s"].alias("beyond"))
    joined = pieces.join(few(blocks), ["file", "block"])
    first = F.col("rec") == 0
    out = joined.select(
        "file",
        (F.col("before") + F.col("rec") - 1).alias("rec_ord"),
        F.when(first, F.col("carried_name")).otherwise(F.col("name")).alias("name"),
        (F.col("at") + F.when(first, F.col("carried")).otherwise(0)).alias("start"),
        F.col("piece").alias("seq"),
        F.when(F.col("open"), F.substring(F.concat("halo", "beyond"), 1, k)).otherwise(F.col("halo")).alias("halo"),
    )
    return out.where((F.col("rec_ord") >= 0) & ((F.col("start") == 0) | (F.length("seq") > 0)))


def read_fastq(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, rec_ord, name, seq); qualities are dropped.

    Records are cut before each line that begins with @. A quality line may begin so too; the
    piece it starts has no third line with a + and is left out.
    """
    pieces = _records(spark, paths, "\n@").withColumn("l", F.split(F.regexp_replace("value", "^@", ""), r"\r?\n"))
    whole = numbered(pieces.where((F.size("l") >= 3) & F.startswith(F.get("l", F.lit(2)), F.lit("+"))), "rec_ord")
    return whole.select("file", "rec_ord", F.regexp_extract(F.col("l")[0], r"^(\S*)", 1).alias("name"), F.col("l")[1].alias("seq"))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files by their type, with file_ord in the order given."""
    found = None
    for i, path in enumerate(paths):
        base = path.lower().removesuffix(".gz")
        reader = read_fastq if base.endswith((".fq", ".fastq")) else read_fasta
        rows = reader(spark, path).withColumn("file_ord", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no files given")
    return found


def header_colors(records: DataFrame, delimiter: str | None = None) -> DataFrame:
    """Add color and is_prefix: the whole name, or what stands from the delimiter on (first, as a class) and before it."""
    if not delimiter:
        return records.withColumn("color", F.col("name")).withColumn("is_prefix", F.lit(False))
    at = F.instr(F.col("name"), delimiter)
    parts = F.when(at > 0, F.array(F.struct(F.substring("name", at, F.length("name")).alias("c"), F.lit(True).alias("p")), F.struct(F.substring("name", F.lit(1), at - 1).alias("c"), F.lit(False).alias("p")))).otherwise(F.array(F.struct(F.col("name").alias("c"), F.lit(False).alias("p"))))
    return records.withColumn("__x", F.explode(parts)).withColumn("color", F.col("__x.c")).withColumn("is_prefix", F.col("__x.p")).drop("__x")


def file_colors(records: DataFrame) -> DataFrame:
    """Reads of a FASTQ file share its path as their colour."""
    return records.withColumn("color", F.col("file")).withColumn("is_prefix", F.lit(False))


def read_index_lists(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(row_id, colors) of text files with the comma-separated set bits of one row a line."""
    return numbered(lines(spark, paths), "row_id", per_file=False).select("row_id", C.from_text(F.col("value")).alias("colors"))


def typed_files(names: DataFrame, column: str = "name") -> DataFrame:
    return names.withColumn("file_type", S.file_type(F.col(column)))
