import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import permute as PM
from strandlake.operators import rows as R
from strandlake.operators import trie as T
from strandlake.plans import commands as CM
from strandlake.sources import store as ST

ROWS = "row_id long, colors array<int>"


def table(n, colors, seed):
    r = random.Random(seed)
    return [(i, sorted(c for c in range(colors) if r.random() < r.choice([0.1, 0.6]))) for i in range(n)]


@pytest.mark.parametrize(("n", "colors", "block"), [(150, 5, 16), (90, 40, 4096), (7, 0, 4)])
def test_rows_come_back_from_the_tree(spark, monkeypatch, n, colors, block):
    monkeypatch.setattr(T, "BLOCK", block)
    made = table(n, colors, n)
    rows = spark.createDataFrame(made, ROWS)
    coded, sets = R.compress(rows)
    tree = T.build(coded, sets)
    assert {r["row_id"]: list(r["colors"]) for r in T.at(tree, rows.select("row_id")).collect()} == dict(made)
    some = rows.where("row_id % 5 = 2").select("row_id")
    assert {r["row_id"]: list(r["colors"]) for r in T.at(tree, some, 3).collect()} == {i: [c for c in cs if c < 3] for i, cs in made if i % 5 == 2}
    seen = T.check(tree).first()
    distinct = len({tuple(c) for _, c in made})
    assert (seen["n_nodes"], seen["n_leaves"], seen["n_rows"], seen["n_wrong"]) == (2 * distinct - 1, distinct, n, 0)
    if colors:
        shapes = PM.trie_sizes(rows.select(F.col("row_id").alias("edge_id"), F.explode("colors").alias("color_id")), spark.createDataFrame([(0, c, c) for c in range(colors)], "perm int, color_id int, new_id int"))
        if all(c for _, c in made):
            assert shapes.first()["beta_bits"] == seen["beta_bits"]


def test_ranks_count_bits_before_a_place(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    made = [(i, [0] if i % 3 == 0 else []) for i in range(50)]
    tree = T.build(*R.compress(spark.createDataFrame(made, ROWS)))
    root = tree["nodes"].where("parent_id IS NULL").first()
    assert (root["split"], root["size"], root["ones"]) == (0, 50, 17)
    places = spark.createDataFrame([(root["node_id"], i) for i in range(50)], "node_id long, at long")
    got = {r["at"]: (r["bit"], r["rank0"], r["rank1"]) for r in T.ranks(tree, places).collect()}
    assert got == {i: (int(i % 3 == 0), i - (i + 2) // 3, (i + 2) // 3) for i in range(50)}


def test_merging_dictionaries(spark, tmp_path):
    tables = [table(40, 4, s) for s in (1, 2)] + [[], [(0, [9])]]
    parts = [R.compress(spark.createDataFrame(t, ROWS)) for t in tables]
    for i in (0, 1, 3):
        ST.save(dict(zip(("rows", "color_sets"), parts[i], strict=True)), str(tmp_path / f"b{i}"))
    rows, sets = R.merge(parts)
    flat = [c for t in tables for _, c in t]
    assert {r["row_id"]: list(r["colors"]) for r in R.decode(rows, sets).collect()} == dict(enumerate(flat))
    order = list(dict.fromkeys(map(tuple, flat)))
    assert {r["set_id"]: tuple(r["colors"]) for r in sets.collect()} == dict(enumerate(order))
    CM.merge(spark, [str(tmp_path / f"b{i}") for i in (0, 1, 3)], str(tmp_path / "all"))
    assert CM.query(spark, str(tmp_path / "all")).count() == len(flat)
    files = []
    for i, t in enumerate(tables[:2]):
        files.append(str(tmp_path / f"{i}.txt"))
        (tmp_path / f"{i}.txt").write_text("".join(",".join(map(str, c)) + "\n" for _, c in t))
    assert CM.compress_lists(spark, files, str(tmp_path / "lists"), verify=True).first().asDict() == {"n_rows": 80, "n_missing": 0, "n_extra": 0, "n_different": 0}
    wrong = spark.createDataFrame([(i, [7]) for i in range(3)], ROWS)
    assert R.verified(rows, sets, wrong).first().asDict() == {"n_rows": 3, "n_missing": 0, "n_extra": len(flat) - 3, "n_different": 3}


def test_folded_rows(spark):
    rows = spark.createDataFrame([("a", [1, 2]), ("a", [2, 3]), ("b", []), ("b", [4]), ("c", [5])], "k string, colors array<int>")
    assert {r["k"]: list(r["colors"]) for r in R.folded(rows, "k", "and").collect()} == {"a": [2], "b": [], "c": [5]}
    assert {r["k"]: list(r["colors"]) for r in R.folded(rows, "k", "or").collect()} == {"a": [1, 2, 3], "b": [4], "c": [5]}
