"""Language identification: words first, character n-grams for unseen words.

Per language the model has log frequencies of words and of character n-grams. A known word
scores by its frequency in each language; an unseen one falls back to the n-grams of length
ORDER, and to shorter ones as long as none of that length is known. A text's language is the one
of the highest sum over all its words. How well the texts that were learned support a text is
kept beside it (see ``Scorer``), so that a text in none of the languages can be rejected.

Words and n-grams are 64-bit hashes throughout. A slice of texts is one array of code points:
words are found, hashed, made distinct and looked up (in sorted arrays) by a few passes of numpy.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, column, freed, gram_hashes, mix, ranges, small_batches, span_hashes

#: Documents that the model is fitted on for each language, at most.
TRAIN_DOCUMENTS = 5_000
ORDER = 5
#: Characters of text that one pass takes; longer texts are cut where a word ends.
SLICE = 1 << 19
#: Support below which ``identified`` rejects a text.
LEAST_SUPPORT = 0.45


def hash_share(docs_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(docs_id.cast("string"), F.lit(""))), F.lit(parts))


@functools.cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def text_pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, lower-case pieces) of about SLICE characters together; a run of more than SLICE letters is cut."""
    rows: list[int] = []
    pieces: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        low = (text or "").lower()
        at = 0
        while at < len(low):
            end = min(len(low), at + SLICE)
            if end < len(low):
                cut = end
                while cut > at and low[cut - 1].isalpha():
                    cut -= 1
                end = cut if cut > at else end
            rows.append(row)
            pieces.append(low[at:end])
            held += end - at
            at = end
            if held >= SLICE:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if rows:
        yield rows, pieces


class Words:
    """Runs of letters of some pieces of text: ``row`` of each, and the distinct words by ``hash``, at ``which`` of them each is."""

    def __init__(self, rows: list[int], pieces: list[str]) -> None:
        data = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.zeros(len(data) + 2, bool)
        letter[1:-1] = letter_table()[np.minimum(data, 0x10FFFF)]
        start, end = np.flatnonzero(letter[1:-1] & ~letter[:-2]), np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
        begins = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
        self.row = np.array(rows, np.int64)[np.searchsorted(begins, start, side="right") - 1]
        self.hash, first, self.which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        self.data, self.start, self.length = data, start[first], (end - start)[first]

    def grams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words ``some`` with < and > around them, back to back; where each begins, and its length."""
        size = self.length[some] + 2
        begin = np.cumsum(size) - size
        padded = np.empty(int(size.sum()), np.uint32)
        padded[begin], padded[begin + size - 1] = ord("<"), ord(">")
        inside = np.ones(len(padded), bool)
        inside[begin] = inside[begin + size - 1] = False
        padded[inside] = self.data[ranges(self.start[some], self.length[some])]
        return padded, begin, size


def feature_of(h: np.ndarray, size: int) -> np.ndarray:
    """Words (size 0) and n-grams of each length keep apart."""
    return mix(h ^ U64((size + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(lang, size, feature, n): size 0 for words, else the n-gram's length; counted per slice, then summed."""

    def summed(features: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(features, return_inverse=True)
        return own, np.bincount(at, n, len(own)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = column(batch, "lang").to_pylist()
            texts = column(batch, "text").to_pylist()
            for lang in sorted(set(named)):
                for rows, pieces in text_pieces([t for t, x in zip(texts, named, strict=True) if x == lang]):
                    w = Words(rows, pieces)
                    n = np.bincount(w.which, minlength=len(w.hash))
                    found = [(0, *summed(feature_of(w.hash, 0), n))] if len(n) else []
                    padded, begin, size = w.grams(np.arange(len(w.hash)))
                    for g in range(1, ORDER + 1):
                        count = np.maximum(size - g + 1, 0)
                        at = ranges(begin, count)
                        if len(at):
                            found.append((g, *summed(feature_of(gram_hashes(padded, g)[at], g), np.repeat(n, count))))
                    for g, f, n_f in found:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(f), np.int64))), pa.array(np.full(len(f), g), pa.int32()), pa.array(f.view(np.int64)), pa.array(n_f)], names=["lang", "size", "feature", "n"])

    counted = small_batches(labelled).select("lang", "text").mapInArrow(freed(run), "lang string, size int, feature long, n long")
    return counted.groupBy("lang", "size", "feature").agg(F.sum("n").alias("n"))


def sampled(docs: DataFrame) -> DataFrame:
    """Rows with text and lang: all of a language, or a hash-chosen share that leaves about TRAIN_DOCUMENTS of them."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg((F.lit(TRAIN_DOCUMENTS) / F.count("*")).alias("share"))
    chosen = F.pmod(F.xxhash64(F.lit(17), "doc_id", F.octet_length("text")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    return rows.join(F.broadcast(share), "lang").where(chosen)  # a row for each language


def fit(docs: DataFrame) -> dict:
    """Model from the sample: languages that have a word in it, and scores by sorted features.

    The driver gets the distinct words and n-grams of TRAIN_DOCUMENTS documents a language, as
    Arrow columns of numbers; how many there are doesn't depend on the size of the corpus.
    """
    top = feature_counts(sampled(docs)).toArrow()
    langs = sorted(set(top.column("lang").unique().to_pylist()))
    if not langs:
        return {"langs": [], "features": np.zeros(0, U64), "scores": np.zeros((0, 0), np.float32)}
    lang = top.column("lang").combine_chunks().dictionary_encode()
    place = np.searchsorted(langs, lang.dictionary.to_pylist())[lang.indices.to_numpy()]
    features, row = np.unique(top.column("feature").to_numpy().view(U64), return_inverse=True)
    size = np.zeros(len(features), np.int8)
    size[row] = top.column("size").to_numpy()
    counts = np.full((len(features), len(langs)), 0.5, np.float32)
    counts[row, place] += top.column("n").to_numpy()
    for g in range(ORDER + 1):  # n-grams of one length share their total, as words do
        some = size == g
        counts[some] = np.log(counts[some] / counts[some].sum(axis=0, dtype=np.float64))
    del top, lang
    pa.default_memory_pool().release_unused()
    return {"langs": langs, "features": features, "scores": counts - counts.mean(axis=1, keepdims=True)}


class Scorer:
    """Language, score and support of texts.

    A word's support is 1 where it is known, and else the length of the n-grams that stood in for it
    over ORDER + 1, times the share of them that is known; a text's is the mean over its words.
    """

    def __init__(self, model: dict) -> None:
        self.langs, self.features, self.scores = model["langs"], model["features"], model["scores"]

    def look_up(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each feature is known, and its row."""
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        return self.features[at] == features, at

    def words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores and support of the distinct words."""
        known, at = self.look_up(feature_of(w.hash, 0))
        out, support = np.zeros((len(known), len(self.langs)), np.float32), known.astype(np.float32)
        out[known] = self.scores[at[known]]
        rest = np.flatnonzero(~known)
        padded, begin, size = w.grams(rest)
        for g in range(ORDER, 0, -1):
            count = np.maximum(size - g + 1, 0)
            places = ranges(begin, count)
            if not len(places):
                continue
            own = np.repeat(np.arange(len(rest)), count)
            hit, at = self.look_up(feature_of(gram_hashes(padded, g)[places], g))
            n = np.bincount(own[hit], minlength=len(rest))
            for lang in range(len(self.langs)):
                out[rest, lang] += np.bincount(own[hit], self.scores[at[hit], lang], len(rest)) / np.maximum(n, 1)
            support[rest] += n / np.maximum(count, 1) * g / (ORDER + 1)
            left = n == 0
            rest, begin, size = rest[left], begin[left], size[left]
        return out, support

    def batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n, langs = len(texts), self.langs
        total, support, seen = np.zeros((n, max(len(langs), 1))), np.zeros(n), np.zeros(n)
        for rows, pieces in text_pieces(texts) if langs else ():
            w = Words(rows, pieces)
            if not len(w.hash):
                continue
            scores, of_word = self.words(w)
            for lang in range(len(langs)):
                total[:, lang] += np.bincount(w.row, scores[w.which, lang], n)
            support += np.bincount(w.row, of_word[w.which], n)
            seen += np.bincount(w.row, minlength=n)
        z = total - total.max(axis=1, keepdims=True)
        score = np.where(seen > 0, 1 / np.exp(z).sum(axis=1), 0.0)
        best = total.argmax(axis=1)
        return [langs[best[i]] if seen[i] else "und" for i in range(n)], score, support / np.maximum(seen, 1)


def predict(docs: DataFrame, model: dict, within: str | None = None) -> DataFrame:
    """Add lang_pred, score and support; ``und`` (0, 0) for texts that are null or have no letter, or if nothing was learned.

    The text is column ``text``, or the field of that name in the struct column ``within``.
    Columns of the new names are replaced; texts are taken whole, however long; of languages
    that score alike the first by code point is taken; an empty table gives no rows.
    """
    df = small_batches(docs).drop("lang_pred", "score", "support")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("support", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # the features of TRAIN_DOCUMENTS documents a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = column(batch, "text") if within is None else column(batch, within).field("text")
                preds, score, support = scorer.batch(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(score), pa.array(support)], names=[f.name for f in schema.fields])

    return df.mapInArrow(freed(run), schema)


def op8(docs: DataFrame) -> DataFrame:
    """The contract's digest: learned from rows whose remainder is not 1 (a null doc_id counts as the empty text).

    Repeated rows are scored alike; other columns are not read.
    """
    held = hash_share(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame, least_support: float = LEAST_SUPPORT) -> DataFrame:
    """``docs`` in one of the languages that their own labels teach, with ``lang`` set to the one found.

    Rejected are texts without a letter and those whose support is below ``least_support``:
    noise, and languages that no label names. Other columns, whatever their names, stay as they are; repeated
    rows stay or go together; where no row has a label nothing can be told apart and an empty table remains.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"))
    found = predict(keyed, model, "row").where((F.col("lang_pred") != "und") & (F.col("support") >= least_support))
    return found.select(*[F.col("lang_pred").alias(n) if n == "lang" else F.col("row")[n].alias(n) for n in names])
