import duckdb
import pytest

from strandlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else int(x) if isinstance(x, bool) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["annotation_exact", "edge_degrees", "map_kmer_colors", "rows_insert", "bloom_fpp", "bloom_corrected", "perm_trie_size", "graph_update", "vcf_variants", "vcf_windows", "sequence_files", "fastq_colors", "index_list_files", "raw_matrix_rows", "string_set_rows", "words_exported", "saved_tables", "bloom_query_columns", "bit_splices_inner", "header_colors", "matrix_stats"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = catalogue.oracle_sql()[name]
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(con.execute(f"select {', '.join(cols)} from ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5430
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
