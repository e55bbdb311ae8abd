from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import minhash, suffix, superkmer, windows
from strandlake.llm.common import run_hashes, span_hashes
from tests.llm import plain

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("hot", [2, 256])
def test_against_plain_versions(spark, hot):
    rows = plain.corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in suffix.op7(docs, replace(suffix.CONFIG, hot=hot)).collect()}
    assert got == plain.bytes_digest(rows)
    got = {r[0]: tuple(r[1:]) for r in superkmer.op9(docs, replace(superkmer.CONFIG, hot=hot)).collect()}
    assert got == plain.words_digest(rows)


def test_empty_tables_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix.op7(empty).collect() == []
    assert superkmer.op9(empty).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long), (5, long), (7, "x"), (7, "x")], SCHEMA)
    got = sorted(((r["doc_id"] or -1, r["n_removed"]) for r in suffix.op7(docs).collect()))
    assert got == [(-1, 0), (5, len(long)), (7, 0), (7, 0)]
    got = sorted(((r["doc_id"] or -1, r["n_removed"]) for r in superkmer.op9(docs).collect()))
    assert got == [(-1, 60), (5, 60), (7, 0), (7, 0)]
    twice = spark.createDataFrame([(5, long), (5, long)], SCHEMA)
    assert [r["n_removed"] for r in suffix.op7(twice).collect()] == [0, 0]
    assert [r["n_removed"] for r in superkmer.op9(twice).collect()] == [0, 0]


def test_rows_that_share_a_doc_id(spark):
    """Different texts under one id, or under none, are different documents in order of their hash."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = text(60)
    rows = [(None, shared + " " + text(300)), (None, text(3) + " " + shared), (None, text(9)), (5, text(20) + " " + shared), (5, shared), (5, shared), (6, text(50)), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    order = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    named = {i: t for i, (_, _, t) in enumerate(sorted({(-1 if d is None else d, order[t], t or "") for d, t in rows}))}
    want = {(len(t.encode()), *x[1:]) for t, x in ((named[i], v) for i, v in plain.bytes_digest(named.items()).items())}
    got = suffix.op7(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r[1:]) for r in got} == want
    want = set(plain.words_digest(named.items()).values())
    got = superkmer.op9(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r[1:]) for r in got} == want
    kept = {r["text"] for r in suffix.without_repeats(docs).collect()}
    assert kept - {None} == {np.frombuffer(named[i].encode(), np.uint8)[~m].tobytes().decode() for i, m in plain.repeated_bytes(named.items()).items() if named[i]}


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts longer than a segment, settled in small groups, buckets of a few strings."""
    rows = plain.corpus(3, 40)
    units = {t: (t or "").encode() for _, t in rows}
    for name, cfg in (("byte", suffix.CONFIG), ("word", superkmer.CONFIG)):
        data = np.frombuffer(b"".join(units.values()), np.uint8)
        offs = np.append(0, np.cumsum([len(u) for u in units.values()]))
        u, first, _, _ = windows.units_of(cfg, data, offs)
        whole = windows.super_kmers(cfg, u, first)
        monkeypatch.setattr(windows, "SEGMENT", 500)
        parts = windows.super_kmers(cfg, u, first)
        monkeypatch.undo()
        spread = lambda x, n=cfg.size: {(t, s + i, h) for t, s, k, h in zip(*(c.tolist() for c in x), strict=True) for i in range(k - n + 1)}
        assert spread(whole) == spread(parts), name


def test_equal_strings_over_batches():
    """Reading in order, batch by batch, says the same for every cut into batches."""
    rng = np.random.default_rng(8)
    rows = np.stack([rng.integers(0, 4, 200), rng.integers(0, 3, 200), rng.integers(0, 5, 200), np.zeros(200, int), rng.integers(0, 4, 200), np.full(200, 9)])
    rows = rows[:, np.lexsort(rows[[4, 3, 2, 1, 0]])]
    for keep_first in (True, False):
        for step in (1, 3, 7, 200):
            equal, firsts, covered = windows._Equal(keep_first), [], set()
            for lo in range(0, 200, step):
                first, told = equal.take(*rows[:, lo : lo + step])
                firsts += (first + lo).tolist()
                covered |= set(zip(*(c.tolist() for c in told), strict=True))
            groups = {}
            for r in rows.T.tolist():
                groups.setdefault((r[0], r[1]), []).append(tuple(r[2:]))
            want = {p for g in groups.values() for p in g if p != min(g) or (not keep_first and len(set(g)) > 1)}
            told_places = {(k, p) for k, g in groups.items() for p in g}
            assert covered == want
            assert len(firsts) == len(groups) and told_places


def test_other_columns_stay(spark):
    long = " ".join(f"é{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long, "a"), (2, "y" + long, "b"), (3, None, "c")], "doc_id long, text string, spans string").withColumnRenamed("spans", "key")
    got = {r["doc_id"]: (r["text"], r["key"]) for r in suffix.without_repeats(docs).collect()}
    assert got == {1: (long, "a"), 2: ("y", "b"), 3: (None, "c")}


def test_maximal_repeats():
    strings = [(1, b"xabcabcy"), (2, b"zabcabcw"), (3, b"qabcr")]
    got = {s: places for s, places in suffix.maximal_repeats(strings, 3)}
    assert got[b"abcabc"] == [(1, 1), (2, 1)]
    assert got[b"abc"] == [(1, 1), (1, 4), (2, 1), (2, 4), (3, 1)]
    for s, places in got.items():
        for d, p in places:
            assert dict(strings)[d][p : p + len(s)] == s
        assert len(places) == sum(t[i : i + len(s)] == s for _, t in strings for i in range(len(t)))


def thue_morse(n):
    """A word over a and b, and its complement: a pair that polynomial hashes modulo powers of two can't tell apart."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x[:n], x[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_long_words_are_told_apart(spark, n):
    x, y = thue_morse(n)
    rest = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([x, *rest])), (2, " ".join([y, *rest]))], SCHEMA)
    assert [r["n_removed"] for r in superkmer.op9(docs).collect()] == [0, 0]
    rows = [(1, f"{x} a b c"), (2, f"{y} a b c"), (3, f"{x} a b c")]
    found = {r["doc_id"]: r["component_id"] for r in minhash.op3(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    rows = [(1, f"{x}{y}"), (2, f"{y}{x}"), (3, f"{x}-{y}")]
    got = {r[0]: tuple(r[1:]) for r in suffix.op7(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain.bytes_digest(rows)


def test_span_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 100_000).astype(np.uint8)
    start, size = rng.integers(0, len(data) - 40, 20_000), rng.integers(0, 40, 20_000)
    found = {}
    for a, n, h in zip(start.tolist(), size.tolist(), span_hashes(data, start, start + size).tolist(), strict=True):
        assert found.setdefault(data[a : a + n].tobytes(), h) == h
    assert len(set(found.values())) == len(found)
    units = rng.integers(0, 3, 5000).astype(np.uint64)
    start, size = rng.integers(0, 4900, 3000), rng.integers(0, 60, 3000)
    found = {}
    for a, n, h in zip(start.tolist(), size.tolist(), run_hashes(units, start, size).tolist(), strict=True):
        assert found.setdefault(units[a : a + n].tobytes(), h) == h
    assert len(set(found.values())) == len(found)
