"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pair sum is taken in
time linear in the features as half of (sum v x)^2 - sum v^2 x^2 for each factor. Features are
the document's words hashed to BUCKETS, statistics of its structure, and its stated length.
The machine is fitted by Adagrad on a bounded sample of labelled rows, in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, column, lower_ascii, span_hashes, text_slices, word_spans
from .langid import hash_share

BUCKETS = 1 << 16
FACTORS = 8
#: Labelled documents that the machine is fitted on, at most (about).
TRAIN_DOCUMENTS = 12_000
EPOCHS = 8
THRESHOLD = 0.7

_class = np.zeros(256, np.int8)  # 1 capital, 2 small, 3 digit, 4 other sign, 5 beyond ASCII, 6 full stop, 7 newline
_class[33:127] = 4
_class[65:91], _class[97:123], _class[48:58], _class[128:], _class[46], _class[10] = 1, 2, 3, 5, 6, 7
STRUCTURE = 14


def features(texts: pa.Array, stated: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, document, bucket and value of each hashed word, dense features)."""
    for lo, hi, data, offs in text_slices(texts):
        n_docs = hi - lo
        start, end, first = word_spans(data, offs)
        low = lower_ascii(data)
        bucket = (span_hashes(low, start, end) & U64(BUCKETS - 1)).astype(np.int64)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(n_docs), n_words)
        key = np.sort(doc << 16 | bucket)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(key)))
        key = key[head]
        d, b = key >> 16, key & (BUCKETS - 1)
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(d, value * value, n_docs))
        value = value / np.maximum(norm[d], 1e-9)
        size = np.diff(offs)
        owner = np.repeat(np.arange(n_docs), size)
        kinds = np.bincount(owner * 8 + _class[data], minlength=n_docs * 8).reshape(n_docs, 8)
        share = kinds / np.maximum(size, 1)[:, None]
        words = np.maximum(n_words, 1)
        distinct = np.bincount(d, minlength=n_docs)
        most = np.zeros(n_docs)
        np.maximum.at(most, d, count)
        length = np.bincount(doc, (end - start).astype(float), n_docs)
        long_words = np.bincount(doc, (end - start) > 14, n_docs)
        dense = np.stack([np.log1p(size), np.log1p(n_words), length / words, share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], kinds[:, 6] / words, kinds[:, 7] / words, distinct / words, most / words, long_words / words, np.log1p(np.maximum(np.nan_to_num(stated[lo:hi]), 0))], axis=1)
        yield lo, hi, d, b, value.astype(np.float32), dense


def pack(rows: DataFrame) -> list:
    """Features of the labelled sample, brought to the driver (TRAIN_DOCUMENTS rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bs, xs, ds = [], [], []
            for lo, hi, d, b, x, dense in features(column(batch, "text"), column(batch, "n_chars").to_numpy(zero_copy_only=False).astype(float)):
                at = np.searchsorted(d, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    bs.append(b[at[i] : at[i + 1]].astype(np.uint16).tobytes())
                    xs.append(x[at[i] : at[i + 1]].tobytes())
                    ds.append(dense[i].tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality"), *(pa.array(v, pa.binary()) for v in (bs, xs, ds))], names=["doc_id", "quality", "b", "x", "dense"])

    return rows.select("doc_id", "quality", "text", "n_chars").mapInArrow(run, "doc_id long, quality int, b binary, x binary, dense binary").orderBy("doc_id", "quality", "b").collect()


def raw_scores(m: dict, n: int, doc: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of n documents and their factor sums, by the sum-of-squares identity."""
    vx = m["v"][feature] * x[:, None]
    at = np.searchsorted(doc, np.arange(n + 1))
    sums = np.add.reduceat(np.concatenate([vx, np.zeros((1, vx.shape[1]), vx.dtype)]), at[:-1], axis=0)
    squares = np.add.reduceat(np.append((vx * vx).sum(axis=1), 0), at[:-1])
    linear = np.add.reduceat(np.append(m["w"][feature] * x, 0), at[:-1])
    return m["w0"] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def with_dense(m: dict, n: int, d: np.ndarray, b: np.ndarray, x: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features of a batch, sorted by document."""
    z = np.clip((dense - m["mean"]) / m["std"], -4, 4) * m["scale"]
    doc = np.concatenate([d, np.repeat(np.arange(n), STRUCTURE)])
    feature = np.concatenate([b, np.tile(np.arange(BUCKETS, BUCKETS + STRUCTURE), n)])
    value = np.concatenate([x, z.ravel().astype(np.float32)])
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], value[order]


def fit(labelled: DataFrame) -> dict:
    """Machine from rows with doc_id, text, n_chars and quality (0 or 1).

    A hash of doc_id and text chooses the sample. Rows that share these and the label are one example, so however often
    one comes, the sample has TRAIN_DOCUMENTS of them at most (about).
    """
    rows = labelled.where(F.col("quality").isin(0, 1)).withColumn("__text", F.xxhash64("text"))
    total = rows.count()
    share = min(1.0, TRAIN_DOCUMENTS / max(total, 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(23), "doc_id", "__text"), F.lit(1_000_000)) < int(share * 1_000_000))
    alike = chosen.groupBy("doc_id", "__text", "quality")
    sample = pack(alike.agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars")))
    rng = np.random.default_rng(3)
    m = {"w0": 0.0, "w": np.zeros(BUCKETS + STRUCTURE, np.float32), "v": rng.normal(0, 0.02, (BUCKETS + STRUCTURE, FACTORS)).astype(np.float32), "mean": np.zeros(STRUCTURE), "std": np.ones(STRUCTURE), "scale": 0.5}
    if not sample:
        return m
    y = np.array([r["quality"] for r in sample], np.float32)
    dense = np.stack([np.frombuffer(r["dense"]) for r in sample])
    m["mean"], m["std"] = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    m["w0"] = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    g_w, g_v, g_0 = np.full_like(m["w"], 1e-3), np.full_like(m["v"], 1e-3), 1e-3
    bs = [np.frombuffer(r["b"], np.uint16).astype(np.int64) for r in sample]
    xs = [np.frombuffer(r["x"], np.float32) for r in sample]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            n = len(some)
            d = np.repeat(np.arange(n), [len(bs[i]) for i in some])
            doc, f, x = with_dense(m, n, d, np.concatenate([bs[i] for i in some]), np.concatenate([xs[i] for i in some]), dense[some])
            z, sums = raw_scores(m, n, doc, f, x)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]).astype(np.float32) / n
            e = err[doc] * x
            used, at = np.unique(f, return_inverse=True)
            d_w = np.bincount(at, e, len(used)) + 1e-6 * m["w"][used]
            d_v = np.zeros((len(used), FACTORS), np.float32)
            np.add.at(d_v, at, e[:, None] * (sums[doc] - m["v"][f] * x[:, None]))
            d_v += 1e-5 * m["v"][used]
            d_0 = float(err.sum())
            g_0 += d_0 * d_0
            g_w[used] += d_w * d_w
            g_v[used] += d_v * d_v
            m["w0"] -= 0.1 * d_0 / np.sqrt(g_0)
            m["w"][used] -= (0.1 * d_w / np.sqrt(g_w[used])).astype(np.float32)
            m["v"][used] -= 0.03 * d_v / np.sqrt(g_v[used])
    return m


def score(docs: DataFrame, machine: dict) -> DataFrame:
    """Add score (0 to 1). Needs text and n_chars; null and empty texts are scored as texts without words."""
    df = docs.drop("score")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(machine)  # BUCKETS + STRUCTURE rows of FACTORS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, d, b, x, dense in features(column(batch, "text"), column(batch, "n_chars").to_numpy(zero_copy_only=False).astype(float)):
                z, _ = raw_scores(m, hi - lo, *with_dense(m, hi - lo, d, b, x, dense))
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: labels learned only from rows whose remainder is not 2.

    A label of 0 or 1 and its document are an example, once however often they come; contradictory labels are two; other labels aren't any. Null and
    empty texts are scored as texts without words, long ones whole; rows that are alike score alike. A null doc_id has no
    remainder: its held_out is null and no label is its own. Without any example scores mean nothing. Other columns
    are not read; an empty table gives no rows.
    """
    held = hash_share(F.col("doc_id"), 4) == 2
    allowed = labels.select("doc_id", "quality").where(~held)
    machine = fit(docs.select("doc_id", "text", "n_chars").join(allowed, "doc_id"))
    out = score(docs.select("doc_id", "text", "n_chars", held.alias("held_out")), machine)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
