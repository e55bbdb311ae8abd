import hashlib
import random
import re

from strandlake.llm import fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string"


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def texts():
    r = random.Random(1)
    letters = list("ab é\n\t\x0b<PSM>😀  \x85  ")
    found = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(600)]
    return [*found, (None, "a b c"), (None, None), (9001, None), (9002, ""), (9003, " \n "), (9004, "x <P> y"), (9005, "a " * 100000), (9006, "é" * 200000), (7, "one two"), (7, "one two")]


def test_op12_equals_a_plain_version(spark):
    rows = texts()
    found = fim.op12(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain(*x) for x in rows), key=str)
    assert {"plain", "psm", "spm"} == {x["form"] for x in found.select("form").distinct().collect()}


def test_rewriting_gives_texts_and_takes_any_columns(spark):
    rows = spark.createDataFrame([(i, f"w{i} x\ny z  ", "a", "b", 3, "u") for i in range(50)], "doc_id long, text string, units string, form string, n int, output string")
    for grammar in fim.GRAMMARS:
        out = fim.restored(fim.rewritten(rows, grammar)).collect()
        assert all(x["restored"] == x["text"] for x in out)
        assert any(x["form"] != "plain" for x in out)
        assert all(x["prefix"] + x["middle"] + x["suffix"] == x["text"] for x in out if x["form"] != "plain")


def test_grammars_cut_where_they_say(spark):
    row = spark.createDataFrame([("a b\n\ncé  ",)], "text string")
    cut = {g: row.select(fim.units(row["text"], g).alias("u")).first()["u"] for g in fim.GRAMMARS}
    assert cut == {"words": ["a", " b", "\n\ncé", "  "], "lines": ["a b\n", "\n", "cé  "], "characters": list("a b\n\ncé  ")}


def test_an_empty_table_gives_no_rows_and_nothing_is_shuffled(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.op12(empty).count() == 0
    plan = fim.op12(spark.createDataFrame(texts(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
