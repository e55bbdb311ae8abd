"""From raw documents to tokens: language, near duplicates, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, langid, minhash, mixing, suffix
from strandlake.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels teach; ``lang`` becomes the language found.

    Null, empty and letterless texts go, as do noise and languages that no label names (see
    ``langid.identified``). Texts are judged whole, however long; rows that are alike stay or go together; an
    empty table stays empty; further columns are dropped.
    """
    return langid.identified(docs.select(*COLUMNS))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that of the least doc_id.

    Null and empty texts have no near duplicates and stay; rows that are alike in doc_id and
    text count once; rows that share only the doc_id are documents of their own (see
    ``minhash.one_of_each``). An empty table stays empty; further columns are dropped.
    """
    return minhash.one_of_each(docs.select(*COLUMNS))


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats 100 bytes or more of an earlier text; no document goes; n_chars follows the text.

    Null texts stay null and keep their n_chars; what is earlier among equal or null ids is
    said in ``suffix.op7``. Texts are cut whole, however long; an empty table stays empty; further columns are dropped.
    """
    return suffix.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def _mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out as the mix draws them, shard by shard, shuffled.

    Null and empty texts are never drawn; a null source is a source of its own; rows that are
    alike are interchangeable (see ``mixing.mixed_documents``). An empty table stays empty; further columns are dropped.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each drawn document, with checksums of ids and of the decoded text.

    Null and empty texts have no tokens; texts are encoded whole, however long; each copy of a row has its own line;
    an empty table stays empty; further columns are dropped.
    """
    out = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), keep_decoded=False)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", _language), ("near_duplicates", _near_duplicates), ("passages", _passages), ("mixture", _mixture), ("tokens", _tokens)]

#: Language scores, sketches, suffix arrays and BPE merges have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
