"""Queries over the driver's tables, each with the SQL that any engine can answer it by.

Documents are the sequences (``source`` is the colour, ``doc_id`` the record order), k is 7.
Colour lists come as comma-joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import bloom_math as B
from strandlake.functions import colorsets as C
from strandlake.functions import sequence as S
from strandlake.operators import bloom as BL
from strandlake.operators import graph as G
from strandlake.operators import permute as PM
from strandlake.operators import rows as R
from strandlake.operators import runs as RU
from strandlake.operators import trie as T
from strandlake.operators import update as U
from strandlake.operators.lineage import cut, few, new_folder
from strandlake.sources import binary as BI
from strandlake.sources import clustered as CL
from strandlake.sources import sequences as SQ
from strandlake.sources import store as ST
from strandlake.sources import variants as V
from strandlake.streaming import growth as GR

K = 7
E = K + 1
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- shared plans -----------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, seq): short texts left out; small files are spread over the cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.col("text").alias("seq")).where(F.length("seq") >= E)
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def occurrences(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    found = records(spark, sf_dir)
    return G.windows(found if only is None else found.where(only), K, fold=True, keep=("doc_id", "source"))


def summary(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """(kmer, first, colours by name): the one pass over all windows that most queries start from.

    Windows are folded by (kmer, source) first, so what is shuffled is a row per distinct pair and task.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    if G.wide_order(docs, "doc_id"):  # numbers beyond 64 bits
        return occurrences(spark, sf_dir, only).groupBy("kmer", "source").agg(F.min(G.occurrence_order(F.col("doc_id"), F.col("pos"), True)).alias("first"), F.count("*").alias("n"))
    found = records(spark, sf_dir)
    return RU.folded_windows(found if only is None else found.where(only), E, rec_ord="doc_id", name="source")


def edges(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    first = summary(spark, sf_dir, only).groupBy("kmer").agg(F.min("first").alias("first"))
    return G.dense_ids(first, "first", "edge_id").select("edge_id", "kmer")


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third number of a source's name marks a class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") >= E)
    return G.color_table(docs, "source", "doc_id", F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 3 == 0)


def color_sets(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """(kmer, first, colors): the matrix without numbers, for all that doesn't show them."""
    named = summary(spark, sf_dir, only).join(few(colors(spark, sf_dir)), F.col("source") == F.col("name"))
    return named.groupBy("kmer").agg(F.min("first").alias("first"), F.array_sort(F.collect_set("color_id")).alias("colors"))


def matrix(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """(edge_id, kmer, colors)."""
    return G.dense_ids(color_sets(spark, sf_dir, only), "first", "edge_id").select("edge_id", "kmer", "colors")


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("edge_id", F.explode("colors").alias("color_id"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select(F.col("edge_id").alias("row_id"), "colors")


def shown(df: DataFrame) -> DataFrame:
    return df.select("row_id", C.text(F.col("colors")).alias("colors"))


RECORDS_SQL = r"""rec AS (SELECT doc_id, source, regexp_replace(translate(text,'acgtn','ACGTN'),'[^ACGTN$]','N','g') AS enc FROM documents WHERE length(text) >= 8)"""
WINDOWS_SQL = RECORDS_SQL + r""", pad AS (SELECT doc_id, source, repeat('$',8)||enc||'$' AS s FROM rec),
win AS MATERIALIZED (SELECT source, kmer, min(doc_id * 2147483648 + p) AS first, count(*) AS n FROM (SELECT doc_id, source, p, substr(s, (p+1)::INT, 8) AS kmer FROM (SELECT doc_id, source, s, unnest(range(0, length(s)-7)) AS p FROM pad)) GROUP BY ALL)"""
COLORS_SQL = r"""colors AS (SELECT (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INT AS color_id, source AS name, regexp_extract(source,'(\d+)$',1)::INT % 3 = 0 AS is_prefix FROM documents WHERE length(text) >= 8 GROUP BY source)"""
GRAPH_SQL = WINDOWS_SQL + ", " + COLORS_SQL + r""", edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(first)) - 1 AS edge_id, kmer FROM win GROUP BY kmer),
anno AS MATERIALIZED (SELECT DISTINCT edge_id, color_id FROM win JOIN edges USING (kmer) JOIN colors ON source = name),
mat AS MATERIALIZED (SELECT edge_id AS row_id, list(color_id ORDER BY color_id) AS cs FROM anno GROUP BY edge_id)"""
PARTS_SQL = GRAPH_SQL + r""", parts AS (SELECT edge_id, kmer, substr(kmer,1,7) AS src, substr(kmer,2,7) AS dst, substr(kmer,8,1) AS label, instr('ACGTN$', substr(kmer,8,1)) AS rank, instr('ACGTN$', substr(kmer,1,1)) AS rank1 FROM edges)"""
TEXT = "array_to_string({}, ',')"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


# --- sequences --------------------------------------------------------------


@query(_with(RECORDS_SQL, "SELECT doc_id, enc AS encoded FROM rec"))
def seq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", S.encode(F.col("seq"), True).alias("encoded"))


@query(_with(RECORDS_SQL, "SELECT doc_id, reverse(translate(enc,'ACGTRYKMBVDHUacgtrykmbvdhu','TGCAYRMKVBHDAtgcayrmkvbhda')) AS revcomp FROM rec"))
def seq_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", S.reverse_complement(S.encode(F.col("seq"), True)).alias("revcomp"))


@query(_with(RECORDS_SQL, "SELECT doc_id, md5(repeat('$',8)||enc||'$') AS padded_md5 FROM rec"))
def seq_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.md5(S.pad(S.encode(F.col("seq"), True), K)).alias("padded_md5"))


@query(_with(WINDOWS_SQL, "SELECT kmer, sum(n)::BIGINT AS n FROM win GROUP BY kmer"))
def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).groupBy("kmer").agg(F.count("*").alias("n"))


@query(_with(WINDOWS_SQL, "SELECT kmer, count(*) AS n, sum(p)::BIGINT AS places, count(DISTINCT doc_id) AS n_records FROM (SELECT doc_id, p, substr(s, (p+1)::INT, 8) AS kmer FROM (SELECT doc_id, s, unnest(range(0, length(s)-7)) AS p FROM pad)) GROUP BY kmer"))
def fasta_long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FASTA, read again as segments of 1,000 letters, and the windows of these."""
    folder = new_folder(spark, "fasta")
    lines = F.array_join(F.regexp_extract_all(S.encode(F.col("seq"), True), F.lit(".{1,70}"), F.lit(0)), "\n")
    records(spark, sf_dir).select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), lines)).write.text(folder)
    parts = SQ.read_fasta_segments(spark, folder, K, 1000)
    found = G.segment_windows(parts, K, keep=("name",)).groupBy("kmer", "name").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))
    return found.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.count("*").alias("n_records"))


@query(
    r"""WITH base AS (SELECT doc_id, source, regexp_replace(translate(text,'acgtn','ACGTN'),'[^ACGTN$]','N','g') AS enc, reverse(translate(regexp_replace(translate(text,'acgtn','ACGTN'),'[^ACGTN$]','N','g'),'ACGT','TGCA')) AS rc FROM documents WHERE length(text) >= 8),
both_ AS (SELECT 0 AS strand, repeat('$',8)||enc||'$' AS s FROM base UNION ALL SELECT 1, repeat('$',8)||rc||'$' FROM base)
SELECT strand, kmer, count(*) AS n FROM (SELECT strand, substr(s, (p+1)::INT, 8) AS kmer FROM (SELECT strand, s, unnest(range(0, length(s)-7)) AS p FROM both_)) GROUP BY ALL"""
)
def kmer_windows_stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = records(spark, sf_dir).select(S.encode(F.col("seq"), True).alias("seq"))
    return G.windows(G.with_reverse(encoded), K, keep=("strand",)).groupBy("strand", "kmer").agg(F.count("*").alias("n"))


@query("SELECT name, CASE WHEN ext = '' THEN '' WHEN ext = 'vcf' THEN 'VCF' WHEN ext IN ('fq','fastq') THEN 'FASTQ' ELSE 'FASTA' END AS file_type FROM (SELECT name, lower(regexp_extract(regexp_replace(name, '(?i)\\.gz$', ''), '\\.([^./]+)$', 1)) AS ext FROM (SELECT DISTINCT source || e AS name FROM documents, (VALUES ('.fa'),('.VCF.gz'),('.fq'),('.fastq.GZ'),('.gz'),(''),('.txt')) v(e)))".replace("\\\\", "\\"))
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    endings = F.explode(F.array(*[F.lit(x) for x in (".fa", ".VCF.gz", ".fq", ".fastq.GZ", ".gz", "", ".txt")]))
    return SQ.typed_files(names.withColumn("e", endings).select(F.concat("source", "e").alias("name")))


@query(r"""SELECT name, x.c AS color, x.p AS is_prefix FROM (SELECT name, unnest(CASE WHEN instr(name,'|') > 0 THEN [{'c': substr(name, instr(name,'|')), 'p': true}, {'c': substr(name, 1, instr(name,'|')-1), 'p': false}] ELSE [{'c': name, 'p': false}] END) AS x FROM (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang ELSE source END AS name FROM documents)) t""")
def header_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.select(F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("|"), "lang")).otherwise(F.col("source")).alias("name")).distinct()
    return SQ.header_colors(names, "|").select("name", "color", "is_prefix")


@query(_with(PARTS_SQL, "SELECT edge_id, kmer, row_number() OVER (ORDER BY reverse(kmer)) AS colex_rank FROM edges"))
def colex_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = edges(spark, sf_dir)
    ordered = first.withColumn("o", F.aggregate(F.sequence(F.lit(1), F.lit(E)), F.lit(0).cast("long"), lambda a, i: a * 128 + F.ascii(F.substring(F.reverse("kmer"), i, F.lit(1)))))
    return G.dense_ids(ordered, "o", "r").select("edge_id", "kmer", (F.col("r") + 1).alias("colex_rank"))


@query(_with(PARTS_SQL, "SELECT a.edge_id, (length(a.kmer) = length(b.kmer) AND substr(a.kmer,5) = substr(b.kmer,5)) AS equal_from_4, reverse(a.kmer) > reverse(b.kmer) AS colex_greater FROM edges a JOIN edges b ON b.edge_id = a.edge_id + 1"))
def seq_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = edges(spark, sf_dir)
    b = a.select((F.col("edge_id") - 1).alias("edge_id"), F.col("kmer").alias("other"))
    return a.join(b, "edge_id").select("edge_id", S.suffix_equal(F.col("kmer"), F.col("other"), F.lit(4)).alias("equal_from_4"), S.colex_greater(F.col("kmer"), F.col("other")).alias("colex_greater"))


# --- graph ------------------------------------------------------------------


@query(_with(PARTS_SQL, "SELECT edge_id, kmer, src, label FROM parts"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_parts(edges(spark, sf_dir), K).select("edge_id", "kmer", "src", "label")


@query(_with(PARTS_SQL, "SELECT count(*) AS n_edges, min(edge_id) AS first_edge, max(edge_id) AS last_edge FROM edges"))
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.min("edge_id").alias("first_edge"), F.max("edge_id").alias("last_edge"))


@query(_with(PARTS_SQL, "SELECT edge_id, kmer FROM edges WHERE contains(kmer, '$')"))
def dummy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(S.is_dummy(F.col("kmer")))


DEGREES_SQL = "SELECT edge_id, kmer, count(*) OVER (PARTITION BY p.src) AS out_degree, coalesce(d.n, 0) AS in_degree FROM parts p LEFT JOIN (SELECT dst, count(*) AS n FROM parts GROUP BY dst) d ON d.dst = p.src"


@query(_with(PARTS_SQL, DEGREES_SQL))
def edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir), K)


@query(_with(PARTS_SQL, f"SELECT edge_id, out_degree = 1 AS only_outgoing, in_degree = 1 AS only_incoming FROM ({DEGREES_SQL})"))
def unary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir), K).select("edge_id", (F.col("out_degree") == 1).alias("only_outgoing"), (F.col("in_degree") == 1).alias("only_incoming"))


@query(_with(PARTS_SQL, "SELECT p.edge_id, f.next_id FROM parts p LEFT JOIN (SELECT src, arg_min(edge_id, rank) AS next_id FROM parts GROUP BY src) f ON f.src = p.dst"))
def next_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.next_edges(edges(spark, sf_dir), K)


@query(_with(PARTS_SQL, "SELECT p.edge_id, f.prev_id FROM parts p LEFT JOIN (SELECT dst, arg_min(edge_id, rank1) AS prev_id FROM parts GROUP BY dst) f ON f.dst = p.src"))
def prev_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.previous_edges(edges(spark, sf_dir), K)


# --- annotation and lookups -------------------------------------------------


@query(_with(GRAPH_SQL, f"SELECT kmer, {TEXT.format('cs')} AS colors FROM mat JOIN edges ON edge_id = row_id"))
def annotation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color_sets(spark, sf_dir).select("kmer", C.text(F.col("colors")).alias("colors"))


@query(_with(GRAPH_SQL, "SELECT kmer, bit_or(1::BIGINT << color_id)::VARCHAR AS words FROM anno JOIN edges USING (edge_id) GROUP BY kmer"))
def annotation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.packed_rows(matrix(spark, sf_dir), 64)


@query(_with(COLORS_SQL, "SELECT count(*) AS n_colors, count(*) FILTER (is_prefix) AS n_prefix FROM colors"))
def color_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colors(spark, sf_dir).agg(F.count("*").alias("n_colors"), F.count_if("is_prefix").alias("n_prefix"))


@query(_with(COLORS_SQL, "SELECT color_id, name, is_prefix FROM colors"))
def color_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colors(spark, sf_dir)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of 8 letters of whole texts, as they stand and encoded, and of 7 encoded ones (a wrong length)."""
    return RU.distinct_runs(records(spark, sf_dir), (E,), (E, K))


def _pieces_sql(column: str, n: int) -> str:
    chunks = f"SELECT unnest(list_transform(range(1, length({column}) - {n - 2}, 256), lambda b: substr({column}, b, {255 + n}))) AS c FROM rec JOIN documents USING (doc_id)"
    return f"SELECT unnest(list_transform(range(1, length(c) - {n - 2}), lambda p: substr(c, p, {n}))) AS query FROM ({chunks})"


PROBES_SQL = f"probes AS (SELECT DISTINCT query FROM ({_pieces_sql('text', 8)} UNION ALL {_pieces_sql('enc', 8)} UNION ALL {_pieces_sql('enc', 7)}))"


@query(_with(GRAPH_SQL + ", " + PROBES_SQL, "SELECT query, length(query) = 8 AS valid, edge_id FROM probes LEFT JOIN edges ON kmer = query"))
def map_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.map_kmers(_probes(spark, sf_dir), edges(spark, sf_dir), K)


@query(_with(GRAPH_SQL + ", " + PROBES_SQL, "SELECT query, edge_id, coalesce(string_agg(color_id::VARCHAR, ',' ORDER BY color_id), '') AS colors, coalesce(string_agg(name, ',' ORDER BY color_id), '') AS color_names FROM probes LEFT JOIN edges ON kmer = query LEFT JOIN anno USING (edge_id) LEFT JOIN colors USING (color_id) GROUP BY query, edge_id"))
def map_kmer_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.map_rows(_probes(spark, sf_dir), matrix(spark, sf_dir), colors(spark, sf_dir), K)
    return out.select("query", "edge_id", C.text(F.col("colors")).alias("colors"), F.array_join("color_names", ",").alias("color_names"))


@query(_with(GRAPH_SQL, "SELECT kmer FROM edges JOIN anno USING (edge_id) WHERE color_id = 3"))
def find_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).where(C.test(F.col("colors"), F.lit(3))).select("kmer")


@query(_with(GRAPH_SQL, "SELECT edge_id, kmer FROM edges WHERE edge_id % greatest(1, (SELECT count(*) FROM edges) // 100) = 0 AND NOT contains(kmer, '$')"))
def sampled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sampled(edges(spark, sf_dir), 100)


# --- matrix rows ------------------------------------------------------------


@query(_with(GRAPH_SQL, "SELECT row_id, len(cs)::INT AS popcount, len(cs) > 0 AS nonzero FROM mat"))
def row_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("row_id", C.popcount(F.col("colors")).alias("popcount"), C.is_nonzero(F.col("colors")).alias("nonzero"))


@query(_with(GRAPH_SQL, f"SELECT a.row_id, {TEXT.format('list_sort(list_intersect(a.cs, b.cs))')} AS both_rows FROM mat a JOIN mat b ON b.row_id = a.row_id + 1"))
def row_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairwise(rows(spark, sf_dir), lambda a, b: C.text(C.both(a, b)), "both_rows")


@query(_with(GRAPH_SQL, f"SELECT a.row_id, {TEXT.format('list_sort(list_distinct(list_concat(a.cs, b.cs)))')} AS either_row FROM mat a JOIN mat b ON b.row_id = a.row_id + 1"))
def row_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairwise(rows(spark, sf_dir), lambda a, b: C.text(C.either(a, b)), "either_row")


@query(_with(GRAPH_SQL, "SELECT a.row_id, a.cs = b.cs AS same FROM mat a JOIN mat b ON b.row_id = a.row_id + 1"))
def row_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairwise(rows(spark, sf_dir), lambda a, b: a == b, "same")


@query(_with(GRAPH_SQL, "SELECT a.color_id AS a, b.color_id AS b, count(*) AS n FROM anno a JOIN anno b ON a.edge_id = b.edge_id AND a.color_id < b.color_id GROUP BY ALL"))
def color_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cooccurrence_of_sets(color_sets(spark, sf_dir))


@query(_with(GRAPH_SQL, "SELECT count(*) AS n_rows, (SELECT count(*) FROM colors) AS n_cols, sum(len(cs))::BIGINT AS set_bits, 100.0::DOUBLE * sum(len(cs))::BIGINT / (count(*) * (SELECT count(*) FROM colors)) AS density, count(DISTINCT cs) AS n_unique, greatest(count(DISTINCT cs) - 1, 0) AS n_internal FROM mat"))
def matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = colors(spark, sf_dir).agg(F.count("*").alias("__colors"))
    bits = color_sets(spark, sf_dir).groupBy("colors").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.size("colors")).cast("long").alias("set_bits"), F.count("*").alias("n_unique"))
    return bits.join(F.broadcast(n)).select("n_rows", F.col("__colors").alias("n_cols"), "set_bits", (F.lit(100.0) * F.col("set_bits") / (F.col("n_rows") * F.col("__colors"))).alias("density"), "n_unique", F.greatest(F.col("n_unique") - 1, F.lit(0)).alias("n_internal"))


@query(_with(PARTS_SQL, "SELECT (SELECT count(*) FROM mat) AS n_rows, (SELECT count(DISTINCT cs) FROM mat) AS n_unique_rows, (SELECT count(DISTINCT src) FROM parts) AS n_unique_nodes"))
def unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.with_parts(color_sets(spark, sf_dir), K)
    return m.agg(F.count("*").alias("n_rows"), F.countDistinct("colors").alias("n_unique_rows"), F.countDistinct("src").alias("n_unique_nodes"))


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('cs')} AS colors FROM mat"))
def rows_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through the dictionary of distinct rows and back."""
    coded, sets = R.compress(rows(spark, sf_dir))
    return shown(R.decode(coded, sets))


@query(_with(GRAPH_SQL + ", parts AS (SELECT row_id // 2 AS row_id, cs FROM mat WHERE row_id % 2 = 0 UNION ALL SELECT row_id // 2 + (SELECT count(*) FROM mat WHERE row_id % 2 = 0), cs FROM mat WHERE row_id % 2 = 1 UNION ALL SELECT row_id + (SELECT count(*) FROM mat), cs FROM mat), sets AS (SELECT cs, row_number() OVER (ORDER BY min(row_id)) - 1 AS set_id FROM parts GROUP BY cs)", f"SELECT row_id, set_id, {TEXT.format('cs')} AS colors FROM parts JOIN sets USING (cs)"))
def rows_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even rows, odd rows and all rows, each with a dictionary of its own, merged by their dictionaries."""
    r = cut(rows(spark, sf_dir))
    half = lambda odd: r.where(F.col("row_id") % 2 == odd).select(F.floor(F.col("row_id") / 2).alias("row_id"), "colors")
    coded, sets = R.merge([R.compress(part) for part in (half(0), half(1), r)])
    return coded.join(sets, "set_id").select("row_id", "set_id", C.text(F.col("colors")).alias("colors"))


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('cs')} AS colors FROM mat"))
def trie_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row read from the prefix tree, going down from its place by ranks."""
    coded, sets = R.compress(rows(spark, sf_dir))
    coded, sets = cut(coded), cut(sets)
    return shown(T.at(T.build(coded, sets), coded.select("row_id")))


@query(_with(GRAPH_SQL, "SELECT row_id * (SELECT count(*) FROM colors) + c AS bit FROM (SELECT row_id, unnest(cs) AS c FROM mat)"))
def matrix_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flatten(rows(spark, sf_dir), colors(spark, sf_dir).count())


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('list_filter(cs, lambda c: c < 9)')} AS below_9, list_min(list_filter(cs, lambda c: c >= 5)) AS next_from_5, list_max(cs) AS highest, list_min(cs) AS lowest, list_contains(cs, 4) AS has_4 FROM mat"))
def index_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("colors")
    return rows(spark, sf_dir).select("row_id", C.text(C.clear_from(c, F.lit(9))).alias("below_9"), C.next_bit(c, F.lit(5)).alias("next_from_5"), C.highest(c).alias("highest"), C.lowest(c).alias("lowest"), C.test(c, F.lit(4)).alias("has_4"))


BITS_SQL = ", bits AS (SELECT row_id, list_transform(range(0, 20), lambda i: CASE WHEN list_contains(cs, i::INT) THEN 1 ELSE 0 END) AS b FROM mat)"


@query(_with(GRAPH_SQL + BITS_SQL, f"SELECT row_id, {TEXT.format('list_concat(list_concat(b[1:3], [0,0]), b[4:20])')} AS zeros_in, {TEXT.format('list_concat(b[1:5], b[10:20])')} AS range_out, {TEXT.format('list_transform(range(0,20), lambda i: b[20 - i])')} AS turned FROM bits"))
def bit_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.array_contains("colors", i.cast("int")).cast("int"))
    b = rows(spark, sf_dir).select("row_id", bits.alias("b"))
    v = F.col("b")
    return b.select("row_id", C.text(C.insert_zeros(v, F.lit(3), F.lit(2))).alias("zeros_in"), C.text(C.remove_range(v, F.lit(5), F.lit(9))).alias("range_out"), C.text(C.rearrange_bits(v, F.sequence(F.lit(19), F.lit(0), F.lit(-1)))).alias("turned"))


@query(_with(GRAPH_SQL + BITS_SQL, f"SELECT row_id, {TEXT.format('list_concat(list_concat(b[1:3], [1,0,1]), b[4:20])')} AS range_in, {TEXT.format('list_concat(list_concat(b[1:2], b[4:5]), list_concat(b[7:7], b[9:20]))')} AS bits_out, {TEXT.format('list_concat(list_concat(b[1:1], b[5:5]), list_concat(b[3:4], list_concat(b[2:2], b[6:20])))')} AS swapped FROM bits"))
def bit_splices_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range put in, single bits taken out, two bits exchanged."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.array_contains("colors", i.cast("int")).cast("int"))
    b = rows(spark, sf_dir).select("row_id", bits.alias("b"))
    v, places, more = F.col("b"), F.array(*map(F.lit, (2, 5, 7))), F.array(*map(F.lit, (1, 0, 1)))
    return b.select("row_id", C.text(C.insert_range(v, F.lit(3), more)).alias("range_in"), C.text(C.remove_bits(v, places)).alias("bits_out"), C.text(C.swap_bits(v, F.lit(1), F.lit(4))).alias("swapped"))


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('cs')} AS colors FROM mat UNION ALL SELECT row_id + (SELECT count(*) FROM mat), {TEXT.format('cs')} FROM mat"))
def rows_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return shown(R.concat([r, r]))


@query(_with(GRAPH_SQL, f"SELECT CASE WHEN row_id >= 10 THEN row_id + (SELECT count(*) FROM mat) ELSE row_id END AS row_id, {TEXT.format('cs')} AS colors FROM mat UNION ALL SELECT row_id + 10, {TEXT.format('cs')} FROM mat"))
def rows_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return shown(R.insert(r, r, 10))


@query(_with(GRAPH_SQL, f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {TEXT.format('cs')} AS colors FROM mat WHERE row_id % 3 <> 0"))
def rows_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return shown(R.remove(r, r.where(F.col("row_id") % 3 == 0)))


@query(_with(GRAPH_SQL, f"SELECT CASE WHEN row_id < 20 THEN row_id + 100 WHEN row_id BETWEEN 100 AND 119 THEN row_id - 100 ELSE row_id END AS row_id, {TEXT.format('cs')} AS colors FROM mat"))
def rows_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"))
    return shown(R.swap(rows(spark, sf_dir), pairs))


@query(_with(GRAPH_SQL, f"SELECT row_id, CASE WHEN row_id = 7 THEN {TEXT.format('list_sort(list_distinct(list_append(cs, 5)))')} WHEN row_id = 8 THEN {TEXT.format('list_filter(cs, lambda c: c <> 5)')} WHEN row_id = 9 THEN CASE WHEN list_contains(cs, 5) THEN {TEXT.format('list_filter(cs, lambda c: c <> 5)')} ELSE {TEXT.format('list_sort(list_append(cs, 5))')} END ELSE {TEXT.format('cs')} END AS colors FROM mat"))
def rows_set_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.toggle_bit(R.unset_bit(R.set_bit(rows(spark, sf_dir), 7, 5), 8, 5), 9, 5))


@query(_with(GRAPH_SQL, f"SELECT row_id, CASE WHEN row_id % 4 = 1 THEN {TEXT.format('list_sort(list_distinct(list_append(cs, 25)))')} ELSE {TEXT.format('cs')} END AS colors FROM mat"))
def rows_set_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return shown(R.set_bits(r, r.where(F.col("row_id") % 4 == 1), 25))


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('cs')} AS colors FROM mat WHERE row_id < 1000000"))
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.first_rows(rows(spark, sf_dir)))


@query(_with(GRAPH_SQL, f"SELECT e.edge_id, {TEXT.format('CASE WHEN e.edge_id % 2 = 0 THEN cs ELSE [] END')} AS colors FROM edges e JOIN mat ON row_id = e.edge_id"))
def rows_from_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row table from an annotation that lacks every second k-mer and has one that is not in the graph."""
    m = matrix(spark, sf_dir)
    kept = m.where(F.col("edge_id") % 2 == 0).select("kmer", "colors").unionByName(spark.sql("SELECT 'XXXXXXXX' AS kmer, array(1) AS colors"))
    return ST.from_precise(m.select("edge_id", "kmer"), kept).select("edge_id", C.text(F.col("colors")).alias("colors"))


# --- permutations -----------------------------------------------------------

PERMUTATION_SQL = "perm AS (SELECT color_id, (row_number() OVER (ORDER BY NOT is_prefix, color_id) - 1)::INT AS new_id FROM colors)"


@query(_with(COLORS_SQL + ", " + PERMUTATION_SQL, "SELECT color_id, new_id FROM perm"))
def color_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PM.prefix_first(colors(spark, sf_dir))


@query(_with(GRAPH_SQL + ", " + PERMUTATION_SQL, "SELECT edge_id, string_agg(new_id::VARCHAR, ',' ORDER BY new_id) AS colors FROM anno JOIN perm USING (color_id) GROUP BY edge_id"))
def rows_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = PM.apply(annotation(spark, sf_dir), PM.prefix_first(colors(spark, sf_dir)))
    return moved.groupBy("edge_id").agg(C.text(F.array_sort(F.collect_list("color_id"))).alias("colors"))


TRIE_SQL = r"""perms AS (SELECT perm, color_id, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN '' ELSE md5('42:' || perm || ':' || color_id) END, color_id) - 1 AS new_id FROM colors, (SELECT unnest(range(0, 6))::INT AS perm)),
sets AS MATERIALIZED (SELECT row_number() OVER () AS s, cs, count(*) AS n FROM mat GROUP BY cs),
bitrows AS MATERIALIZED (SELECT s, perm, any_value(n) AS n, string_agg(CASE WHEN list_contains(cs, color_id) THEN '1' ELSE '0' END, '' ORDER BY new_id) AS b FROM sets, perms GROUP BY s, perm),
begins AS MATERIALIZED (SELECT s, perm, n, b, d, substr(b, 1, d::INT) AS p FROM (SELECT *, unnest(range(0, length(b))) AS d FROM bitrows)),
inner_nodes AS MATERIALIZED (SELECT perm, d, p, sum(n) AS n FROM begins GROUP BY perm, d, p HAVING count(DISTINCT substr(b, d::INT + 1, 1)) = 2),
leaf AS (SELECT perm, s, greatest(max(length(rtrim(b, '0'))), coalesce(max(i.d) + 1, 0)) + 1 AS bits FROM begins LEFT JOIN inner_nodes i USING (perm, d, p) GROUP BY perm, s)"""


@query(_with(GRAPH_SQL + ", " + TRIE_SQL, "SELECT l.perm, 2 * l.n - 1 AS n_nodes, (l.bits - i.bits)::BIGINT AS alpha_bits, i.n::BIGINT AS beta_bits FROM (SELECT perm, count(*) AS n, sum(bits) AS bits FROM leaf GROUP BY perm) l JOIN (SELECT perm, sum(d + 1) AS bits, sum(n) AS n FROM inner_nodes GROUP BY perm) i USING (perm)"))
def perm_trie_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PM.trie_sizes(annotation(spark, sf_dir), PM.random_permutations(colors(spark, sf_dir), 5))


@query(_with(GRAPH_SQL + ", " + TRIE_SQL, "SELECT 2 * l.n - 1 AS n_nodes, l.n AS n_leaves, (SELECT count(*) FROM mat) AS n_rows, 0::BIGINT AS n_wrong, i.n::BIGINT AS beta_bits FROM (SELECT count(*) AS n FROM leaf WHERE perm = 0) l, (SELECT sum(n) AS n FROM inner_nodes WHERE perm = 0) i"))
def trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree's nodes and bits, and whether they agree with each other."""
    coded, sets = R.compress(rows(spark, sf_dir))
    return T.check(T.build(cut(coded), cut(sets)))


@query(_with(GRAPH_SQL + ", each AS (SELECT substr(kmer, 1, 7) AS src, edge_id, color_id FROM edges JOIN anno USING (edge_id)), n AS (SELECT src, count(DISTINCT edge_id) AS n FROM each GROUP BY src), m AS (SELECT src, color_id, count(*) AS m FROM each GROUP BY ALL)", "SELECT src, coalesce(string_agg(color_id::VARCHAR, ',' ORDER BY color_id) FILTER (m = n), '') AS in_all, string_agg(color_id::VARCHAR, ',' ORDER BY color_id) AS in_any FROM m JOIN n USING (src) GROUP BY src"))
def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the edges out of each node, folded by and and by or."""
    m = cut(color_sets(spark, sf_dir).select(S.source_node(F.col("kmer"), K).alias("src"), "colors"))
    every, some = (R.folded(m, "src", how).withColumnRenamed("colors", name) for how, name in (("and", "a"), ("or", "o")))
    return every.join(some, "src").select("src", C.text(F.col("a")).alias("in_all"), C.text(F.col("o")).alias("in_any"))


# --- Bloom filters ----------------------------------------------------------

HASHES, FACTOR = 3, 5.0
BLOOM_SQL = (
    GRAPH_SQL
    + r""", meta AS (SELECT color_id, floor(5.0 * count(*) + 1)::BIGINT AS n_bits FROM anno GROUP BY color_id),
hashed AS MATERIALIZED (SELECT edge_id, kmer, j, ('0x' || substr(md5(j || ':' || kmer), 1, 15))::BIGINT AS h FROM edges, (VALUES (0),(1),(2)) v(j)),
bits AS MATERIALIZED (SELECT DISTINCT color_id, h % n_bits AS bit FROM anno JOIN hashed USING (edge_id) JOIN meta USING (color_id)),
raw AS MATERIALIZED (SELECT edge_id, color_id FROM (SELECT edge_id, m.color_id, h % n_bits AS bit FROM hashed, meta m) p JOIN bits USING (color_id, bit) GROUP BY edge_id, color_id HAVING count(*) = 3)"""
)


def _filters(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bloom_meta, bloom_bits) of rows with kmer and colors, sized by each colour's distinct k-mers."""
    pairs = m.select("kmer", F.explode("colors").alias("color_id"))
    meta = BL.sizes(pairs, FACTOR, HASHES)  # pairs are distinct
    return meta, BL.build(pairs, meta)


def _raw(m: DataFrame, meta: DataFrame, bits: DataFrame) -> DataFrame:
    return BL.probe(m.select("kmer"), meta, bits).join(m.select("edge_id", "kmer"), "kmer").select("edge_id", "color_id")


#: What path correction keeps: each edge walks forwards, then backwards, over nodes with one way in and one out.
WALK_SQL = (
    PARTS_SQL.replace(GRAPH_SQL, BLOOM_SQL)
    + f""", degree AS MATERIALIZED ({DEGREES_SQL}),
solid AS MATERIALIZED (SELECT * FROM parts WHERE NOT contains(kmer, '$')),
link AS MATERIALIZED (SELECT p.edge_id AS a, f.next_id AS b FROM solid p JOIN (SELECT src, arg_min(edge_id, rank) AS next_id FROM solid GROUP BY src) f ON f.src = p.dst JOIN degree d ON d.edge_id = f.next_id WHERE d.out_degree = 1 AND d.in_degree = 1),
mask AS MATERIALIZED (SELECT edge_id AS e, bit_or(1::BIGINT << color_id) AS m FROM raw JOIN solid USING (edge_id) GROUP BY edge_id),
ahead (e, here, m, quiet, i) AS (SELECT e, e, m, 0, 0 FROM mask UNION ALL SELECT w.e, l.b, w.m & o.m, CASE WHEN w.m & o.m = w.m THEN w.quiet + 1 ELSE 0 END, w.i + 1 FROM ahead w JOIN link l ON l.a = w.here JOIN mask o ON o.e = l.b WHERE w.quiet < 50 AND w.m & o.m <> 0),
turned AS MATERIALIZED (SELECT e, arg_max(m, i) AS m FROM ahead GROUP BY e),
back (e, here, m, quiet, i) AS (SELECT e, e, m, 0, 0 FROM turned UNION ALL SELECT w.e, l.a, w.m & o.m, CASE WHEN w.m & o.m = w.m THEN w.quiet + 1 ELSE 0 END, w.i + 1 FROM back w JOIN link l ON l.b = w.here JOIN mask o ON o.e = l.a WHERE w.quiet < 50 AND w.m & o.m <> 0),
fixed AS MATERIALIZED (SELECT e AS edge_id, color_id FROM (SELECT e, arg_max(m, i) AS m FROM back GROUP BY e) x, colors WHERE (m >> color_id) & 1 = 1)"""
)


@query("SELECT p, -log2(p) / ln(2.0::DOUBLE) AS bits, ceil(-log2(p) / ln(2.0::DOUBLE) * ln(2.0::DOUBLE) - 1e-12)::INT AS hashes, exp(p * 10 * -(ln(2.0::DOUBLE) * ln(2.0::DOUBLE))) AS rate_for_10p FROM (SELECT n_nationkey, 1.0::DOUBLE / (n_nationkey + 2) AS p FROM nation)")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.lit(1.0) / (F.col("n_nationkey") + 2)).alias("p"))
    bits = B.bits_for_rate(F.col("p"))
    return p.select("p", bits.alias("bits"), B.hashes_for_bits(bits).alias("hashes"), B.rate_for_bits(F.col("p") * 10).alias("rate_for_10p"))


@query(_with(BLOOM_SQL, "SELECT color_id, bit FROM bits"))
def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filters(cut(color_sets(spark, sf_dir)))[1]


@query(_with(BLOOM_SQL, "SELECT color_id, n_bits, count(bit) AS n_set, count(bit) / (64.0::DOUBLE * (n_bits // 64 + 1)) AS occupancy FROM meta LEFT JOIN bits USING (color_id) GROUP BY color_id, n_bits"))
def bloom_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BL.occupancy(*_filters(cut(color_sets(spark, sf_dir))))


@query(_with(BLOOM_SQL, "SELECT edge_id, string_agg(color_id::VARCHAR, ',' ORDER BY color_id) AS colors FROM raw GROUP BY edge_id"))
def bloom_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    raw = _raw(m, *_filters(m))
    return raw.groupBy("edge_id").agg(C.text(F.array_sort(F.collect_list("color_id"))).alias("colors"))


@query(_with(BLOOM_SQL, "SELECT kmer, string_agg(color_id::VARCHAR, ',' ORDER BY color_id) AS colors FROM raw JOIN edges USING (edge_id) WHERE color_id % 3 = 0 GROUP BY kmer"))
def bloom_query_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third filter asked alone."""
    m = cut(color_sets(spark, sf_dir))
    some = tuple(range(0, colors(spark, sf_dir).count(), 3))
    raw = BL.probe(m.select("kmer"), *_filters(m), colors=some)
    return raw.groupBy("kmer").agg(C.text(F.array_sort(F.collect_list("color_id"))).alias("colors"))


@query(
    "WITH RECURSIVE "
    + WALK_SQL
    + """ SELECT count(*) AS n_edges, sum(bits)::BIGINT AS n_bits_exact, sum(pre)::BIGINT AS fp_bits_pre, sum(post)::BIGINT AS fp_bits_post, sum(fn)::BIGINT AS fn_bits_post, count(*) FILTER (pre > 0) AS fp_edges_pre, count(*) FILTER (post > 0) AS fp_edges_post, count(*) FILTER (fn > 0) AS fn_edges_post, sum(pre)::BIGINT / count(*)::DOUBLE AS fp_per_edge_pre, sum(post)::BIGINT / count(*)::DOUBLE AS fp_per_edge_post
FROM (SELECT edge_id, count(x.e) AS bits, count(*) FILTER (x.r = 1 AND x.e IS NULL) AS pre, count(*) FILTER (x.c = 1 AND x.e IS NULL) AS post, count(*) FILTER (x.e = 1 AND x.c IS NULL) AS fn FROM solid LEFT JOIN (SELECT edge_id, color_id, e, r, c FROM (SELECT *, 1 AS e FROM anno) FULL JOIN (SELECT *, 1 AS r FROM raw) USING (edge_id, color_id) FULL JOIN (SELECT *, 1 AS c FROM fixed) USING (edge_id, color_id)) x USING (edge_id) GROUP BY edge_id)"""
)
def bloom_fpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation before and after path correction."""
    m = matrix(spark, sf_dir)
    raw = cut(_raw(m, *_filters(m)))
    e = m.select("edge_id", "kmer")
    return BL.evaluation(e, m.select("edge_id", F.explode("colors").alias("color_id")), raw, BL.corrected(e, raw, K))


SAMPLE = 500
#: Tries of a walk: its moves, and one more where it didn't end for want of change; backwards only through a node with one way in and out.
STEPS_SQL = f""", chosen AS MATERIALIZED (SELECT edge_id FROM solid WHERE edge_id % greatest(1, (SELECT count(*) FROM edges) // {SAMPLE}) = 0),
tries AS (SELECT e, max(i) + (CASE WHEN arg_max(quiet, i) < 50 THEN 1 ELSE 0 END) AS n FROM ahead GROUP BY e UNION ALL SELECT e, n + (CASE WHEN q < 50 AND d.out_degree = 1 AND d.in_degree = 1 THEN 1 ELSE 0 END) AS n FROM (SELECT e, max(i) AS n, arg_max(quiet, i) AS q, arg_max(here, i) AS h FROM back GROUP BY e) b JOIN degree d ON d.edge_id = b.h)"""


@query(
    "WITH RECURSIVE "
    + WALK_SQL
    + STEPS_SQL
    + """ SELECT count(*) AS n_edges, sum(bits)::BIGINT AS n_bits_exact, sum(pre)::BIGINT AS fp_bits_pre, sum(post)::BIGINT AS fp_bits_post, sum(fn)::BIGINT AS fn_bits_post, count(*) FILTER (pre > 0) AS fp_edges_pre, count(*) FILTER (post > 0) AS fp_edges_post, count(*) FILTER (fn > 0) AS fn_edges_post, sum(pre)::BIGINT / count(*)::DOUBLE AS fp_per_edge_pre, sum(post)::BIGINT / count(*)::DOUBLE AS fp_per_edge_post, (SELECT sum(n)::BIGINT FROM tries JOIN chosen ON edge_id = e) AS n_steps
FROM (SELECT edge_id, count(x.e) AS bits, count(*) FILTER (x.r = 1 AND x.e IS NULL) AS pre, count(*) FILTER (x.c = 1 AND x.e IS NULL) AS post, count(*) FILTER (x.e = 1 AND x.c IS NULL) AS fn FROM chosen LEFT JOIN (SELECT edge_id, color_id, e, r, c FROM (SELECT *, 1 AS e FROM anno) FULL JOIN (SELECT *, 1 AS r FROM raw) USING (edge_id, color_id) FULL JOIN (SELECT *, 1 AS c FROM fixed) USING (edge_id, color_id)) x USING (edge_id) GROUP BY edge_id)"""
)
def bloom_sampled_fpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation at even steps through the edges, with the steps that the walks take."""
    m = matrix(spark, sf_dir)
    raw = cut(_raw(m, *_filters(m)))
    return BL.evaluated(m.select("edge_id", "kmer"), m.select("edge_id", F.explode("colors").alias("color_id")), raw, K, SAMPLE)


@query("WITH RECURSIVE " + WALK_SQL + " SELECT edge_id, string_agg(color_id::VARCHAR, ',' ORDER BY color_id) AS colors FROM fixed GROUP BY edge_id")
def bloom_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-corrected rows, cutoff 50."""
    m = matrix(spark, sf_dir)
    fixed = BL.corrected(m.select("edge_id", "kmer"), _raw(m, *_filters(m)), K, segment=8)  # so that paths of this graph are cut, too
    return fixed.groupBy("edge_id").agg(C.text(F.array_sort(F.collect_list("color_id"))).alias("colors"))


# --- updates and variants ---------------------------------------------------


@query(
    "WITH "
    + WINDOWS_SQL.replace("SELECT source, kmer, min(doc_id * 2147483648 + p) AS first", "SELECT doc_id % 2 AS half, source, kmer, min(doc_id * 2147483648 + p) AS first")
    + ", base AS (SELECT row_number() OVER (ORDER BY min(first)) - 1 AS edge_id, kmer FROM win WHERE half = 0 GROUP BY kmer), fresh AS (SELECT row_number() OVER (ORDER BY min(first)) - 1 + (SELECT count(*) FROM base) AS edge_id, kmer FROM win WHERE half = 1 AND kmer NOT IN (SELECT kmer FROM base) GROUP BY kmer), alle AS (SELECT * FROM base UNION ALL SELECT * FROM fresh), "
    + "c0 AS (SELECT row_number() OVER (ORDER BY min(doc_id), source) - 1 AS color_id, source AS name FROM rec WHERE doc_id % 2 = 0 GROUP BY source), c1 AS (SELECT row_number() OVER (ORDER BY min(doc_id), source) - 1 + (SELECT count(*) FROM c0) AS color_id, source AS name FROM rec WHERE doc_id % 2 = 1 AND source NOT IN (SELECT name FROM c0) GROUP BY source), cols AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1) "
    + "SELECT edge_id, kmer, string_agg(color_id::VARCHAR, ',' ORDER BY color_id) AS colors FROM (SELECT DISTINCT edge_id, alle.kmer, color_id FROM win JOIN alle USING (kmer) JOIN cols ON name = source) GROUP BY edge_id, kmer"
)
def graph_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of the even documents, grown by the odd ones."""
    docs = records(spark, sf_dir)
    even, odd = F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1
    first = summary(spark, sf_dir, even)
    base = G.build_edges(first, F.col("first"))
    base_colors = G.color_table(docs.where(even), "source", "doc_id")
    base_rows = G.annotate(first, base, base_colors, "source")
    all_edges, _, rows_ = U.update(base, base_colors, base_rows, docs.where(odd), summary(spark, sf_dir, odd), F.col("first"), "source", "doc_id")
    sets = rows_.groupBy("edge_id").agg(C.text(F.array_sort(F.collect_set("color_id"))).alias("colors"))
    return all_edges.join(sets, "edge_id")


@query(_sql["graph_update"])
def graph_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph as versions of clustered tables: the even documents, what the odd ones add, and nothing that comes again."""
    docs = records(spark, sf_dir).select(F.col("doc_id").alias("rec_ord"), F.col("source").alias("color"), "seq")
    base = new_folder(spark, "graph")
    for version, part in enumerate((F.col("rec_ord") % 2 == 0, F.col("rec_ord") % 2 == 1, F.col("rec_ord") % 2 == 1)):
        GR.grow(spark, base, docs.where(part), version, K, fold=True)
    t = CL.tables(spark, base)
    sets = t["annotation"].groupBy("kmer").agg(C.text(F.array_sort(F.collect_list("color_id"))).alias("colors"))
    return t["edges"].select("edge_id", "kmer").join(sets, "kmer").select("edge_id", "kmer", "colors")


@query(_with(GRAPH_SQL + ", asked AS (SELECT DISTINCT item_id, substr(e, p::INT, 8) AS query FROM (SELECT item_id, e, unnest(range(1, length(e) - 6)) AS p FROM (SELECT item_id, regexp_replace(translate(text,'acgtn','ACGTN'),'[^ACGTN$]','N','g') AS e FROM benchmark)))", "SELECT item_id, query, edge_id, coalesce(string_agg(color_id::VARCHAR, ',' ORDER BY color_id), '') AS colors, coalesce(string_agg(name, ',' ORDER BY color_id), '') AS color_names FROM asked LEFT JOIN edges ON kmer = query LEFT JOIN anno USING (edge_id) LEFT JOIN colors USING (color_id) GROUP BY item_id, query, edge_id"))
def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the benchmark's texts, looked up in clustered tables of the documents' graph."""
    base = new_folder(spark, "graph")
    GR.grow(spark, base, records(spark, sf_dir).select(F.col("doc_id").alias("rec_ord"), F.col("source").alias("color"), "seq"), 0, K, fold=True)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("seq"))
    asked = G.windows(items, K, fold=True, rooted=True, keep=("item_id",)).select("item_id", F.col("kmer").alias("query")).distinct()
    found = CL.looked_up(spark, base, asked)
    return found.select("item_id", "query", "edge_id", C.text(F.col("colors")).alias("colors"), F.array_join("color_names", ",").alias("color_names"))


#: Variants that are derived from documents: a substitution in each at a place that its number gives, in one of four forms.
ALTS = ["G", "<CN2>,<CN4>", "A,<DEL>,G", "C"]


VCF_SQL = (
    RECORDS_SQL
    + """, v AS (SELECT doc_id, enc, doc_id % length(enc) + 1 AS pos, [['G'], ['<CN2>', '<CN4>'], ['A'], ['C']][(doc_id % 4 + 1)::INT] AS alts FROM rec WHERE doc_id % 5 <> 0),
a AS (SELECT *, substr(enc, pos::INT, 1) AS ref, unnest(range(0, len(alts))) AS allele FROM v),
vs AS (SELECT doc_id, 'd' || doc_id AS contig, allele::INT AS allele, substr(enc, greatest(pos - 3, 1)::INT, least(3, pos - 1)::INT) || CASE WHEN alts[allele + 1] LIKE '<CN%' THEN repeat(ref, regexp_extract(alts[allele + 1], '^<CN(\\d+)', 1)::INT) ELSE alts[allele + 1] END || substr(enc, (pos + 1)::INT, 3) AS seq, list_concat(list_concat(['d' || doc_id], CASE WHEN doc_id % 3 = 0 THEN ['AC_AMR'] ELSE [] END), list_concat(CASE WHEN doc_id % 2 = 0 THEN ['A'] ELSE [] END, CASE WHEN doc_id % 7 < 3 THEN ['B'] ELSE [] END)) AS cl FROM a)"""
)
VCF_FILES = 8


def _vcf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as VCF files, read again and set into their reference's bases, with 3 on both sides."""
    contigs = records(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), S.encode(F.col("seq"), True).alias("seq"))
    d = F.col("doc_id")
    pos = d % F.length("seq") + 1
    gt = lambda yes, a, b: F.when(yes, a).otherwise(b)
    fields = ["name", pos.cast("string"), F.lit("."), F.substring("seq", pos.cast("int"), F.lit(1)), F.get(F.array(*map(F.lit, ALTS)), (d % 4).cast("int")), F.lit("."), gt(d % 5 == 0, "q10", "PASS"), gt(d % 3 == 0, "AC_AMR=2;AC_AFR=0", "."), F.lit("GT"), gt(d % 2 == 0, "1|0", "0|0"), gt(d % 7 < 3, "0|1", "0/1")]
    lines = contigs.select((d % VCF_FILES).alias("g"), "doc_id", F.concat_ws("\t", *fields).alias("value"))
    head = spark.range(VCF_FILES).select(F.col("id").alias("g"), F.lit(-1).cast("long").alias("doc_id"), F.lit("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB").alias("value"))
    folder = new_folder(spark, "vcf")
    lines.unionByName(head).repartition(VCF_FILES, "g").sortWithinPartitions("g", "doc_id").drop("doc_id").write.partitionBy("g").text(folder)  # a file has its head first and its records in order
    return V.variant_sequences(V.read_vcf(spark, folder), contigs.select("name", "seq"), 3)


@query(_with(VCF_SQL, "SELECT contig, allele, seq, array_to_string(cl, ',') AS colors FROM vs"))
def vcf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vcf_variants(spark, sf_dir).select(F.get("colors", F.lit(0)).alias("contig"), "allele", "seq", F.array_join("colors", ",").alias("colors"))


@query(_with(VCF_SQL + f", j AS (SELECT g, color, string_agg(seq, '$' ORDER BY doc_id, allele) AS s FROM (SELECT doc_id % {VCF_FILES} AS g, doc_id, allele, seq, unnest(cl) AS color FROM vs) GROUP BY g, color)", "SELECT g, color, kmer, count(*) AS n FROM (SELECT g::INT AS g, color, substr(s, p::INT, 4) AS kmer FROM (SELECT g, color, s, unnest(range(1, length(s) - 2)) AS p FROM j)) GROUP BY ALL"))
def vcf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4 letters of each colour's variants in a file, one behind the other with $ between them."""
    parts = V.joined_segments(_vcf_variants(spark, sf_dir), 3, band=16).withColumn("g", F.regexp_extract("file", r"g=(\d+)", 1).cast("int"))
    return G.segment_windows(parts, 3, rooted=True, keep=("g", "color")).groupBy("g", "color", "kmer").agg(F.count("*").alias("n"))


# --- files written and read again -------------------------------------------


def _fasta(found: DataFrame) -> DataFrame:
    """Records (name, enc) as FASTA text, 70 letters a line."""
    lines = F.array_join(F.regexp_extract_all("enc", F.lit(".{1,70}"), F.lit(0)), "\n")
    return found.select(F.concat(F.lit(">"), "name", F.lit(" a > b\n"), lines).alias("value"))


def _fastq(found: DataFrame, *keep: str) -> DataFrame:
    """Records (name, enc) as FASTQ text; qualities of every second one begin with @."""
    quality = F.repeat(F.when(F.col("name").cast("long") % 2 == 0, "@").otherwise("I"), F.length("enc"))
    return found.select(*keep, F.concat(F.lit("@"), "name", F.lit(" x\n"), "enc", F.lit("\n+\n"), quality).alias("value"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", "source", F.col("doc_id").cast("string").alias("name"), S.encode(F.col("seq"), True).alias("enc"))


@query(_with(RECORDS_SQL, "SELECT (doc_id % 3 = 1)::INT AS file_ord, strand, doc_id::VARCHAR AS name, md5(CASE WHEN strand = 0 THEN enc ELSE reverse(translate(enc,'ACGT','TGCA')) END) AS seq_md5, length(enc) AS n_letters FROM rec, (VALUES (0), (1)) t(strand)"))
def sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA files of two thirds of the documents and FASTQ files of the rest, read together, both strands."""
    folder, fastq = new_folder(spark, "files"), F.col("doc_id") % 3 == 1
    _fasta(_named(spark, sf_dir).where(~fastq)).write.text(f"{folder}/some.fa")
    _fastq(_named(spark, sf_dir).where(fastq)).write.text(f"{folder}/some.fq")
    found = G.with_reverse(SQ.read_sequences(spark, [f"{folder}/some.fa", f"{folder}/some.fq"]))
    return found.select("file_ord", "strand", "name", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("n_letters"))


@query(_with(WINDOWS_SQL, "SELECT source AS color, kmer, n FROM win"))
def fastq_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTQ folder for each source; the files name the colours of their windows."""
    folder = new_folder(spark, "reads")
    _fastq(_named(spark, sf_dir), "source").write.partitionBy("source").text(folder)
    found = SQ.file_colors(SQ.read_fastq(spark, folder)).withColumn("color", F.regexp_extract("color", "source=([^/]*)", 1))
    return G.windows(found, K, keep=("color",)).groupBy("color", "kmer").agg(F.count("*").alias("n"))


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('cs')} AS colors FROM mat"))
def index_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lists of set bits in text files; a row's number is its line's."""
    folder = new_folder(spark, "lists")
    ST.write_index_lists(rows(spark, sf_dir), folder)
    return shown(SQ.read_index_lists(spark, folder))


@query(_sql["index_list_files"])
def raw_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed into binary matrices of 512 rows, and read from these."""
    files = BI.packed_matrix(rows(spark, sf_dir), colors(spark, sf_dir).count(), 512)
    part = F.regexp_extract("file", r"(\d+)$", 1).cast("long")
    return shown(BI.matrix_rows(files).withColumn("row_id", part * 512 + F.col("row_id")))


@query(_with(GRAPH_SQL, f"SELECT kmer, {TEXT.format('cs')} AS colors FROM mat JOIN edges ON edge_id = row_id"))
def string_set_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers with their colours packed into binary string sets of 512 rows, and read from these."""
    m = matrix(spark, sf_dir).withColumnRenamed("edge_id", "row_id")
    named = colors(spark, sf_dir)
    files = BI.packed_strings(m, named.count(), [r[0] for r in named.where("is_prefix").select("color_id").collect()], 512)
    return BI.string_rows(files).select("kmer", C.text(F.col("colors")).alias("colors"))


@query(_sql["index_list_files"])
def rows_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of rows that were packed into words."""
    packed = R.packed(rows(spark, sf_dir), colors(spark, sf_dir).count())
    return shown(packed.select("row_id", C.from_words(F.col("words")).alias("colors")))


@query(_with(GRAPH_SQL + ", " + PERMUTATION_SQL + ", n AS (SELECT count(*) AS n FROM colors), word AS (SELECT edge_id, new_id // 64 AS w, bit_or(1::UBIGINT << (new_id % 64)::UBIGINT) AS word FROM anno JOIN perm USING (color_id) GROUP BY ALL), place AS (SELECT edge_id, unnest(range(0, ((n + 63) // 64)::BIGINT)) AS w FROM edges, n)", "SELECT edge_id, string_agg(coalesce(word, 0)::VARCHAR, ',' ORDER BY w) AS words FROM place LEFT JOIN word USING (edge_id, w) GROUP BY edge_id"))
def words_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows with class colours first, exported and read again."""
    folder, named = new_folder(spark, "words"), cut(colors(spark, sf_dir))
    ST.export_words(matrix(spark, sf_dir), named.count(), folder, PM.prefix_first(named))
    return spark.read.parquet(folder).select("edge_id", C.words_text(F.col("words")).alias("words"))


@query(_with(GRAPH_SQL, f"SELECT row_id, {TEXT.format('cs')} AS colors FROM mat WHERE row_id < 1000"))
def first_rows_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 rows of a table with a dictionary."""
    coded, sets = R.compress(rows(spark, sf_dir))
    return shown(R.decode(R.first_rows(coded, 1000), sets))


SAVED = {"graph_meta": "1", "edges": "(SELECT count(*) FROM edges)", "colors": "(SELECT count(*) FROM colors)", "annotation": "(SELECT count(*) FROM anno)", "bloom_meta": "(SELECT count(*) FROM meta)", "bloom_bits": "(SELECT count(*) FROM bits)", "rows": "(SELECT count(*) FROM mat)", "color_sets": "(SELECT count(DISTINCT cs) FROM mat)"}


@query(_with(BLOOM_SQL, " UNION ALL ".join(f"SELECT '{name}' AS name, {n}::BIGINT AS n_left, {n}::BIGINT AS n_right, 0::BIGINT AS only_left, 0::BIGINT AS only_right" for name, n in SAVED.items())))
def saved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of a graph, saved, loaded, and compared with what they were."""
    m = cut(matrix(spark, sf_dir))
    meta, bits = _filters(m)
    coded, sets = R.compress(m.select(F.col("edge_id").alias("row_id"), "colors"))
    kept = {"graph_meta": ST.graph_meta(spark, K, FACTOR, HASHES), "edges": m.select("edge_id", "kmer"), "colors": colors(spark, sf_dir), "annotation": m.select("edge_id", F.explode("colors").alias("color_id")), "bloom_meta": meta, "bloom_bits": bits, "rows": coded, "color_sets": sets}
    base = new_folder(spark, "saved")
    ST.save(kept, base)
    found = None
    for name, df in ST.load(spark, base, list(SAVED)).items():
        one = R.difference(kept[name], df).select(F.lit(name).alias("name"), "*")
        found = one if found is None else found.unionByName(one)
    return found
