"""Queries of the corpus operators, their SQL, and the pipeline query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, embdedup, fim, langid, lexical, minhash, mixing, pii, quality, sharding, suffix, superkmer


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op1(_documents(spark, sf_dir))


def op2_multiprobe_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op2(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op3(_documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(_documents(spark, sf_dir))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_nn_descent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.op6(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.op7(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8(_documents(spark, sf_dir))


def op9_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.op9(_documents(spark, sf_dir))


def op10_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op10(_documents(spark, sf_dir))


def op11_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op11(_documents(spark, sf_dir))


def op12_lookaround_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op12(_documents(spark, sf_dir))


def op13_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op13(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe_round_trip, op2_multiprobe_nearest, op3_sketch_near_dedup, op4_source_mix, op5_quality_fm, op6_nn_descent_dedup, op7_suffix_array_dedup, op8_language_id, op9_super_kmer_dedup, op10_uniform_shards, op11_pii_candidates, op12_lookaround_fim, op13_quantised_search]
    return {f.__name__: f for f in found}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p+3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

OP6_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, m.vec_id = m.c AS kept FROM (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = m.vec_id"""

OP7_SQL = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
f AS (SELECT k, min(doc_id * 1000000000 + p) AS o FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE doc_id * 1000000000 + p > o),
cut AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM hit),
num AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut),
run AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM num GROUP BY ALL),
gap AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM run),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) || any_value(substr(h, 2 * last + 1)) AS k FROM gap JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS last FROM run GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP9_SQL = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p+34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, p + o AS i FROM hit, range(0, 35) t(o)),
rest AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(rest.s, '')) AS kept_sha256 FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN rest USING (doc_id)"""


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')) AS n, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a+1:b], '') AS middle, array_to_string(u[b+1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {TERMS} AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
df AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, n),
m AS (SELECT doc_id, 75 + (25 * len(d.w) * n) // l AS m FROM d, total),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(c * df.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN df USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that have one; the others are held against plain versions in tests/llm."""
    return {"op3_sketch_near_dedup": OP3_SQL, "op6_nn_descent_dedup": OP6_SQL, "op7_suffix_array_dedup": OP7_SQL, "op9_super_kmer_dedup": OP9_SQL, "op12_lookaround_fim": OP12_SQL, "op13_quantised_search": OP13_SQL}
