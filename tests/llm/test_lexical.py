import math
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import lexical

from .plain import corpus

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * sum(c.values()) * n_docs // total
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, k=20):
    return sorted(map(tuple, lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k).collect()))


def many():
    docs = corpus(3, 80)
    docs += [(500 + i, docs[11][1]) for i in range(40)]  # ties beyond the k-th place
    docs += [(700, "ÀB àb Ab-aB 😀x 12"), (701, "word " * 60000), (702, "é" * 100000), (703, "a\x85b c　d")]
    return docs


def queries(docs):
    texts = [t for _, t in docs if t]
    return [(i, " ".join((t.split() * 2)[i % 5 : 40])) for i, t in enumerate(texts[:30])] + [(900, None), (901, ""), (902, "?!"), (903, "nowhere"), (904, "ab AB 12 😀X word word"), (905, texts[11] * 50)]


@pytest.mark.parametrize("k", [1, 20])
def test_search_equals_scoring_everything(spark, k):
    docs = many()
    assert found(spark, docs, queries(docs), k) == plain(docs, queries(docs), k)


def test_small_blocks_and_groups_give_the_same(spark, monkeypatch):
    docs = many()
    for name, value in (("DOCUMENTS", 7), ("POSTINGS", 300), ("ITEMS", 9), ("PARTS", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert found(spark, docs, queries(docs), 5) == plain(docs, queries(docs), 5)


def test_bytes_bound_impacts():
    tf, m = np.meshgrid(np.arange(1, 60), np.unique(np.geomspace(75, 10**9, 400).astype(np.int64)))
    exact = lexical.impact(tf, m)
    q = lexical.byte_of(exact)
    assert (lexical.LOWER[q] <= exact).all() and (exact <= lexical.UPPER[q]).all()


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "one two", 1, "a"), (4, "one two", 1, "a"), (4, "one two", 1, "a"), (5, None, 1, "a"), (None, None, 1, "a"), (6, "three", 1, "a")], "doc_id long, text string, score int, item string")
    items = spark.createDataFrame([(1, "one", 3), (1, "one", 4), (1, "three", 4), (None, "two", 4)], "item_id long, text string, rank int")
    got = [tuple(r)[:3] for r in lexical.op13(docs, items).orderBy(F_nulls("item_id"), "score", "rank").collect()]
    assert got == [(None, 1, None), (None, 2, 4), (None, 3, 4), (1, 1, None), (1, 2, 4), (1, 3, 4), (1, 1, 6)]


def F_nulls(name):
    from pyspark.sql import functions as F

    return F.col(name).asc_nulls_first()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert lexical.op13(docs.limit(0), items).count() == 0
    assert lexical.op13(docs, items.limit(0)).count() == 0
    assert lexical.op13(docs.select("doc_id", docs["doc_id"].cast("string").alias("text")).where("doc_id < 0"), items).count() == 0
