from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strandlake.llm import bpe, mixing
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, "src1", None), (9002, "123 !!", "en", "src1", 6), (9003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == cp.COLUMNS
    start, language, single, passages, mixture, tokens = seen
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in language} == {9001, 9002, 9003}
    dup = plain.near_duplicates([(r["doc_id"], r["text"]) for r in language], 5)
    assert {r["doc_id"] for r in single} == {d for d, (_, _, kept) in dup.items() if kept}
    masks = plain.repeated_bytes([(r["doc_id"], r["text"]) for r in single])
    before = {r["doc_id"]: r["text"] for r in single}
    for r in passages:
        text, mask, at = before[r["doc_id"]], masks[r["doc_id"]], 0
        kept = []
        for c in text:
            n = len(c.encode())
            if not mask[at : at + n].all():
                kept.append(c)
            at += n
        assert r["text"] == "".join(kept)
        assert r["n_chars"] == len(r["text"])
    keyed = spark.read.parquet(str(tmp_path / "2")).select(F.xxhash64(*cp.COLUMNS).alias("key"), "*")
    doc_of = {r["key"]: r["doc_id"] for r in keyed.select("key", "doc_id").collect()}
    want = mixing.mix_sources(keyed, identity=("key",)).collect()
    times = {doc_of[r["key"]]: r["passes"] + (r["head_words"] > 0 and 2 * r["head_words"] >= r["size"]) for r in want}
    drawn = {}
    for r in mixture:
        drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + 1
    assert drawn == {d: n for d, n in times.items() if n}
    assert all(n <= 2 for n in drawn.values())
    t = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in passages}
    assert len(tokens) == len(mixture)
    for r in tokens:
        assert list(r["ids"]) == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 100
    assert "doc_id" in out.columns
