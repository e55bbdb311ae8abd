import time

import numpy as np

from strandlake.llm import components as c
from strandlake.llm.common import CLEANUP, cut


def test_random_links_and_chains(spark):
    rng = np.random.default_rng(8)
    chain = np.arange(1000, 1200)
    links = rng.integers(0, 200, (150, 2)).tolist() * 2 + np.stack([chain, chain + 1], 1)[rng.permutation(200)].tolist() + [[5000, i] for i in range(5001, 5100)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_round_has_two_exchanges(spark):
    edges = cut(spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"))
    plan = c._stars(c._stars(edges, True), False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    setting = spark.conf.get(CLEANUP)
    rows = spark.range(10_000).selectExpr("id", "id % 100 AS k")
    joined = rows.join(rows.groupBy("k").count(), "k").repartition(4, "id")
    before = files()
    out = cut(joined)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == joined.count() == 10_000
    assert spark.conf.get(CLEANUP) == setting
