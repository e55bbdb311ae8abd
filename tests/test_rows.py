import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import colorsets as C
from strandlake.operators import permute as PM
from strandlake.operators import rows as R


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = [sorted(rng.sample(range(9), rng.choice([0, 0, 1, 2, 2, 5]))) for _ in range(40)]
    return rows, spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "row_id long, colors array<int>").persist()


def listed(df):
    got = sorted((r["row_id"], list(r["colors"])) for r in df.collect())
    assert [i for i, _ in got] == list(range(len(got)))
    return [c for _, c in got]


def test_dictionary_and_stats(data):
    rows, df = data
    coded, sets = R.compress(df)
    assert sets.count() == len({tuple(r) for r in rows})
    assert listed(R.decode(coded, sets)) == rows
    s = R.stats(df, 9).first()
    assert (s["n_rows"], s["set_bits"], s["n_unique"], s["n_internal"]) == (40, sum(map(len, rows)), sets.count(), sets.count() - 1)


def test_edits(spark, data):
    rows, df = data
    more = spark.createDataFrame([(0, [1]), (1, [2, 3])], "row_id long, colors array<int>")
    for place in (0, 7, 40):
        assert listed(R.insert(df, more, place)) == rows[:place] + [[1], [2, 3]] + rows[place:]
    assert listed(R.insert(df, more)) == rows + [[1], [2, 3]]
    gone = spark.createDataFrame([(0,), (3,), (39,), (3,)], "row_id long")
    assert listed(R.remove(df, gone)) == [r for i, r in enumerate(rows) if i not in (0, 3, 39)]
    pairs = spark.createDataFrame([(0, 5), (7, 39)], "a long, b long")
    swapped = list(rows)
    for a, b in ((0, 5), (7, 39)):
        swapped[a], swapped[b] = swapped[b], swapped[a]
    assert listed(R.swap(df, pairs)) == swapped
    assert listed(R.swap(R.swap(df, pairs), pairs)) == rows
    for op, new in ((R.set_bit, lambda r: sorted({*r, 4})), (R.unset_bit, lambda r: [c for c in r if c != 4]), (R.toggle_bit, lambda r: sorted({*r} ^ {4}))):
        for i in range(0, 40, 13):
            assert listed(op(df, i, 4)) == [new(r) if j == i else r for j, r in enumerate(rows)]
    assert listed(R.set_bits(df, gone, 8)) == [sorted({*r, 8}) if i in (0, 3, 39) else r for i, r in enumerate(rows)]
    assert R.same_table(df, df) and not R.same_table(df, R.insert(df, more))
    assert R.at(df, 5, 4).first()["colors"] == [c for c in rows[5] if c < 4]


def test_packed_words(spark):
    df = spark.createDataFrame([([0, 63, 64, 130],), ([],)], "c array<int>")
    got = df.select(C.words_text(C.words(F.col("c"), 131)).alias("t"), C.from_words(C.words(F.col("c"), 131)).alias("back")).collect()
    assert got[0]["t"] == f"{1 + 2**63},1,4"
    assert got[0]["back"] == [0, 63, 64, 130]
    assert (got[1]["t"], got[1]["back"]) == ("0,0,0", [])


def test_permutations(spark, data):
    colors = spark.createDataFrame([(i, f"c{i}", i in (2, 5)) for i in range(10)], "color_id int, name string, is_prefix boolean")
    got = {r[0]: r[1] for r in PM.prefix_first(colors).collect()}
    assert got == {2: 0, 5: 1, 0: 2, 1: 3, 3: 4, 4: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    rows, df = data
    anno = df.select(F.col("row_id").alias("edge_id"), F.explode("colors").alias("color_id"))
    sizes = PM.trie_sizes(anno, PM.random_permutations(colors, 3)).orderBy("perm").collect()
    distinct = len({tuple(r) for r in rows if r})
    assert [r["perm"] for r in sizes] == [0, 1, 2, 3]
    assert all(r["n_nodes"] == 2 * distinct - 1 for r in sizes)
    orders = {}
    for perm, old, new in PM.random_permutations(colors, 3).collect():
        orders.setdefault(perm, {})[old] = new
    assert orders[0] == {i: i for i in range(10)}
    assert all(sorted(o.values()) == list(range(10)) for o in orders.values())
    for r in sizes:
        words = ["".join("1" if i in moved else "0" for i in range(10)) for moved in ({orders[r["perm"]][c] for c in row} for row in rows if row)]
        assert (r["alpha_bits"], r["beta_bits"]) == plain_trie(words)


def plain_trie(words, depth=0):
    """Label and branching bits of the tree over bit strings, node by node."""
    if len(set(words)) == 1:
        return max(len(words[0].rstrip("0")) - depth, 0) + 1, 0
    d = depth
    while len({w[d] for w in words}) == 1:
        d += 1
    a, b = (plain_trie([w for w in words if w[d] == x], d + 1) for x in "01")
    return a[0] + b[0] + d - depth + 1, a[1] + b[1] + len(words)


def test_cooccurrence(data):
    rows, df = data
    anno = df.select(F.col("row_id").alias("edge_id"), F.explode("colors").alias("color_id"))
    got = {(r["a"], r["b"]): r["n"] for r in R.cooccurrence(anno).collect()}
    want = {}
    for r in rows:
        for i, a in enumerate(r):
            for b in r[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_difference_counts_repeats(spark):
    schema = "row_id long, colors array<int>, __x string"
    a = spark.createDataFrame([(0, [1], "a"), (0, [1], "a"), (1, None, None), (2, [], "b")], schema)
    b = spark.createDataFrame([("a", [1], 0), (None, None, 1), ("b", [2], 2)], "__x string, colors array<int>, row_id long")
    assert tuple(R.difference(a, b).first()) == (4, 3, 2, 1)
    assert tuple(R.difference(a.limit(0), b.limit(0)).first()) == (0, 0, 0, 0)
    assert R.same_table(a, a.repartition(3)) and not R.same_table(a, a.distinct()) and not R.same_table(a, a.drop("__x"))
