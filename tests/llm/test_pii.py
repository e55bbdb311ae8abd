import hashlib
import random
import re
import time

import numpy as np
import pytest

from strandlake.llm import pii

SCHEMA = "doc_id long, text string"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, body):
    digits = [int(c) for c in body if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in body.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return {k: [m.span() for m in re.finditer(rule, text) if passes(k, m.group())] for k, rule in RULES.items()}


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for k in RULES for a, b in spans[k])


@pytest.mark.parametrize("letters", ["ab@.-+ 1", "0123456789 -.", "+1(5) -.@", "1.2@a é\n", "25.0 "])
def test_base_rules_equal_plain_patterns(letters):
    r = random.Random(letters)
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 90)))
        assert pii.base_spans(text)[0] == plain(text), text


def corpus(n=900, seed=5):
    """Texts with personal data, numbers of other kinds, and some that base rules can't find; and the latter's spans."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghilmnorstué") for _ in range(r.randint(2, 8)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if passes("card", d + c))

    phone = lambda: f"+1 ({digits(3)}) 555-{digits(4)}"
    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    rows, hidden = [], {}
    for i in range(n):
        bits = [[word()] for _ in range(r.randint(8, 40))]
        kind = i % 9
        made = {0: card, 1: phone, 2: ip, 3: lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com".replace("é", "e"), 4: lambda: digits(16), 5: lambda: f"version {digits(1)}.{digits(1)}.", 6: lambda: f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"'}.get(kind)
        at = r.randint(1, len(bits) - 1)
        if made:
            bits[at] = [made()]
        elif kind == 7 and i > 100:
            a, b = card(), card()
            bits[at] = [a, b]
        elif kind == 8 and i > 100:
            bits[at] = [phone(), ip()]
        text = " ".join(x for b in bits for x in b)
        rows.append((i, text))
        if kind in (7, 8) and i > 100:
            begin = len(" ".join(x for b in bits[:at] for x in b)) + 1
            parts = bits[at]
            second = begin + len(parts[0]) + 1
            hidden[i] = [("card" if kind == 7 else "phone", begin, begin + len(parts[0])), *([("card", second, second + len(parts[1]))] if kind == 7 else [])]
    return rows, hidden


@pytest.fixture(scope="module")
def searched(spark):
    rows, hidden = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return rows, hidden, {r["doc_id"]: r for r in pii.op11(docs).collect()}


def test_op11_keeps_base_spans(searched):
    rows, _, found = searched
    for i, text in rows:
        base, row = plain(text), found[i]
        assert [row[f"n_{k}"] for k in RULES] == [len(base[k]) for k in RULES]
        assert row["base_sha256"] == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert set(filter(None, text_of(base).split(","))) <= set(row["spans"].split(","))


def test_trees_add_what_base_rules_cannot_find_and_leave_the_rest(searched):
    rows, hidden, found = searched
    right = wrong = 0
    for i, text in rows:
        added = set(filter(None, found[i]["spans"].split(","))) - set(text_of(plain(text)).split(","))
        true = {f"{k}:{a}:{b}" for k, a, b in hidden.get(i, [])}
        right += len(added & true)
        wrong += len(added - true)
    assert right >= 0.9 * sum(map(len, hidden.values()))
    assert wrong <= 0.02 * right


def test_the_same_rows_otherwise_dealt_give_the_same(spark, searched):
    rows, _, found = searched
    again = pii.op11(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    assert {r["doc_id"]: r for r in again.collect()} == found


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "write a@b.co", "x", 1), (3, "é a@b.co", "x", 1), (3, "é a@b.co", "x", 1), (4, "no data", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")
    got = pii.op11(docs).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in got) == [(0, 1, "email:6:12"), (1, 0, ""), (2, 0, ""), (3, 1, "email:2:8"), (3, 1, "email:2:8"), (4, 0, "")]
    assert {r["base_sha256"] for r in got if not r["spans"]} == {nothing}
    assert pii.op11(docs.limit(0)).count() == 0
    assert pii.found(docs, [None] * 4).where("doc_id = 3").first()["redacted"] == "é <email>"


def test_long_texts_take_linear_time():
    rows, _ = corpus(300)
    x = np.array([f for _, t in rows for k, _, f in pii.examples(t) if k == 2])
    y = np.array([label for _, t in rows for k, label, _ in pii.examples(t) if k == 2], float)
    models = [None, None, pii.calibrated(pii.fit(x, y), x, y), None]
    for piece in ("1", "1 ", "1.", "a@", "@", "+1(", "a at a dot ", "12 34 56 78 ", "é", "4444 4444 4444 4448 "):
        began = time.time()
        pii.spans_of([piece * (200_000 // len(piece))], models)
        assert time.time() - began < 20, piece


def test_trees_learn_an_interaction_and_thresholds_hold_the_precision():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (4000, 5)).astype(float)
    y = ((x[:, 0] > 1) & (x[:, 3] < 2)).astype(float)
    noisy = np.where(rng.random(4000) < 0.02, 1 - y, y)
    model = pii.calibrated(pii.fit(x[:3000], noisy[:3000]), x[3000:], noisy[3000:], 0.9)
    taken = model.score(x[3000:]) >= model.threshold
    assert 0.5 <= model.threshold < 1
    assert noisy[3000:][taken].mean() >= 0.9
    assert ((model.score(x) > 0.5) == y).mean() > 0.99
    assert pii.calibrated(pii.fit(x, y), x, 1 - y).threshold == np.inf
