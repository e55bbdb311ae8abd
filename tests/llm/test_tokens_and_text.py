import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import bpe, langid, quality

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_is_the_library():
    t, c, rng = library(), bpe.codec(PATH), random.Random(2)
    alphabet = [*"abcdeABC ,.'!?0123\n\t éßüÉΣς$%<|>\x1c ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the", "日", "😀", "é"]
    texts = ["", "a" * 5000, "$" * 900, "the" * 300, "x" * 48, "x" * 49] + ["".join(rng.choices(alphabet, k=rng.randint(0, 90))) for _ in range(400)]
    for text, ids in zip(texts, c.encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want
        assert c.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_matrix_and_heap_merge_alike():
    c, rng = bpe.codec(PATH), random.Random(7)
    ws = ["".join(rng.choices("abcdefthein", k=rng.randint(2, 48))).encode() for _ in range(300)]
    assert c.merge_words(ws) == [c.merge_long(w) for w in ws]


def test_op1_rows(spark):
    rows = [(1, "Hello wörld's"), (2, None), (3, ""), (1, "Hello wörld's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    t = library()
    for r in bpe.op1(docs).collect():
        ids = t.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.op1(docs.limit(0)).collect() == []
    full = bpe.encode_documents(docs).where("doc_id = 1").first()
    assert list(full["ids"]) == t.encode(rows[0][1], add_special_tokens=False).ids


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 !! \n", "de", "s", 0), (9003, "", None, None, None)], docs.schema)
    got = langid.op8(docs.unionByName(odd)).join(docs.unionByName(odd).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() + 3
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] > 9000)
    held = [r for r in got if r["held_out"] and r["lang"] and r["doc_id"] < 9000]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.op8(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.op8(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()} == {"und"}
    stays = langid.identified(docs.unionByName(odd))
    assert stays.columns == docs.columns
    assert {9001, 9002, 9003}.isdisjoint(r["doc_id"] for r in stays.select("doc_id").collect())


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0)], docs.schema)
    got = quality.op5(docs.unionByName(odd), labels).collect()
    assert len(got) == docs.count() + 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.93 * len(held)
    assert quality.op5(docs.limit(0), labels).collect() == []
    assert len(quality.op5(docs.limit(5), labels.limit(0)).collect()) == 5
