"""Scores of the two classifiers against plain sums."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm import langid, quality

SF = "/root/testdata/sf0.001"
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "


def words(text):
    out = [""]
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def grams(word, g):
    padded = f"<{word}>"
    return [padded[i : i + g] for i in range(len(padded) - g + 1)]


def learned(rows):
    """langs, {(size, feature): score of each language} of (lang, text) rows."""
    counts = {}
    for lang, text in rows:
        for w in words(text):
            for key in [(0, w)] + [(g, x) for g in range(1, langid.ORDER + 1) for x in grams(w, g)]:
                counts.setdefault(key, Counter())[lang] += 1
    langs = sorted({lang for c in counts.values() for lang in c})
    total = {(size, lang): math.fsum(0.5 + c[lang] for (s, _), c in counts.items() if s == size) for size in range(langid.ORDER + 1) for lang in langs}
    scores = {}
    for key, c in counts.items():
        s = [math.log((0.5 + c[lang]) / total[key[0], lang]) for lang in langs]
        scores[key] = [x - sum(s) / len(s) for x in s]
    return langs, scores


def word_score(scores, n_langs, w):
    if (0, w) in scores:
        return scores[0, w]
    for g in range(langid.ORDER, 0, -1):
        hits = [scores[g, x] for x in grams(w, g) if (g, x) in scores]
        if hits:
            return [sum(h[i] for h in hits) / len(hits) for i in range(n_langs)]
    return [0.0] * n_langs


def test_languages_against_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = docs.select("doc_id", "text", "lang").collect()
    rng = random.Random(5)
    odd = [(9001, "", None), (9002, "zzq xyzzy\n" * 3, None), (9003, " ".join(r["text"] for r in source if r["text"])[:300_000], None)]
    odd += [(9010 + i, "".join(rng.choices("abcdeé ß—日\n", k=60)), None) for i in range(20)]
    clash = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(clash).withColumn("held_out", F.lit("clash")).withColumn("lang_pred", F.lit(7))
    langs, scores = learned([(r["lang"], r["text"]) for r in source if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1])
    texts = {r["doc_id"]: r["text"] for r in source} | {i: t for i, t, _ in odd}
    got = langid.op8(both).collect()
    assert len(got) == len(texts)
    for r in got:
        found = [word_score(scores, len(langs), w) for w in words(texts[r["doc_id"]] or "")]
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = [sum(f[i] for f in found) for i in range(len(langs))]
        top = max(total)
        assert total[langs.index(r["lang_pred"])] >= top - 1e-2
        assert abs(r["score"] - 1 / sum(math.exp(t - top) for t in total)) < 1e-2
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_the_language_found_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(6)
    one = docs.where(F.col("lang").isNotNull() & (F.length("text") > 300)).orderBy("doc_id").first()
    other = docs.where(F.col("lang") != one["lang"]).orderBy("doc_id").first()["lang"]
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 12))) for _ in range(200))
    odd = spark.createDataFrame([(9001, one["text"], other, "s", 1), (9002, noise, None, "s", 1), (9003, POLISH * 3, None, "s", 1), (9004, one["text"], None, None, None)], docs.schema)
    found = {r["doc_id"]: r["lang"] for r in langid.identified(docs.unionByName(odd)).select("doc_id", "lang").collect()}
    assert found[9001] == found[9004] == one["lang"]
    assert 9002 not in found
    assert 9003 not in found
    assert len(found) >= 2 + docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    n = quality.BUCKETS + quality.STRUCTURE
    m = {"w0": 0.3, "w": rng.normal(0, 1, n).astype(np.float32), "v": rng.normal(0, 0.5, (n, quality.FACTORS)).astype(np.float32), "mean": np.zeros(quality.STRUCTURE), "std": np.ones(quality.STRUCTURE), "scale": 0.5}
    texts = ["", None, "one", "one two two Three. four\nfive", "w " * 3000, " ".join(f"w{i}" for i in range(150))]
    seen = 0
    for lo, hi, d, b, x, dense in quality.features(pa.array(texts, pa.string()), np.array([0, np.nan, 3, 28, 6000, 700.0])):
        doc, feature, value = quality.with_dense(m, hi - lo, d, b, x, dense)
        got, _ = quality.raw_scores(m, hi - lo, doc, feature, value)
        for i in range(hi - lo):
            f, xs = feature[doc == i], value[doc == i].astype(float)
            v = m["v"][f].astype(float)
            want = m["w0"] + (m["w"][f] * xs).sum() + sum((v[j] @ v[k]) * xs[j] * xs[k] for j in range(len(f)) for k in range(j))
            assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
            seen += 1
    assert seen == len(texts)


def test_quality_of_ties_repeats_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a good text\n" * 40_000, 480_000), (2, "short", 5), (2, "short", 5), (3, None, None), (None, "", 0)], "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (2, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality.op5(docs, labels).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 2, 3]
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.op5(docs.limit(0), labels.limit(0)).collect() == []


def test_repeated_labels_are_one_example(spark, monkeypatch):
    """A document whose label comes thousands of times fills neither the sample nor the driver."""
    seen = []
    pack = quality.pack
    monkeypatch.setattr(quality, "pack", lambda rows: seen.append(pack(rows)) or seen[-1])
    monkeypatch.setattr(quality, "TRAIN_DOCUMENTS", 2500)
    schema = "doc_id long, text string, n_chars int, quality int"
    hot = [(7, "always the same words", 21, 1)] * 2000 + [(7, "always the same words", 21, 0)] * 3
    quality.fit(spark.createDataFrame(hot + [(i, f"text {i}", 7, i % 2) for i in range(100, 400)], schema))
    assert len(seen[0]) == 302
    quality.fit(spark.createDataFrame([(7, f"text {i}", 7, 1) for i in range(20000)], schema))
    assert 2200 < len(seen[1]) < 2800
