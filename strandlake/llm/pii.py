"""Personal data by candidates and boosted trees.

Base rules find what has an unmistakable form. Generators of high recall propose many more
spans, overlapping ones too: any run of digit groups that could be a card, a phone number or
an address, and anything around an at sign or its paraphrases. Boosted trees of each kind judge
a proposal by its format and its context; proposals whose score reaches the kind's threshold
are added, the best first, where they overlap nothing taken before. Base spans always stay.

The trees learn from the corpus itself: a proposal that equals a base span is an example, other
proposals are counter-examples, except where a base match failed its check (a card number that
runs into the next one, say), as those may be personal data after all: they are what the trees
are for. Base spans are also rewritten in their surroundings: in other formats and beside other
numbers (examples), and with a digit changed or left out (counter-examples). Thresholds are
calibrated on examples that the trees haven't seen, to a precision of PRECISION.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, freed, small_batches

KINDS = ["email", "ip", "card", "phone"]
#: Documents that examples are taken from, about; the examples of each kind and label; the least number to learn from.
SAMPLE_DOCUMENTS, EXAMPLES, LEAST = 20_000, 4_000, 40
#: Share of right spans among the added ones, on examples kept apart.
PRECISION = 0.99
#: Characters on both sides of a proposal that are its context.
CONTEXT = 32
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 8

# The base rules. Possessive forms and lookbehinds don't change what they match, only how long a failure takes.
EMAIL_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_END = re.compile(EMAIL_LOCAL + r"++\Z")
AT = re.compile(r"@|[ ]?[(\[{][ ]?at[ ]?[)\]}][ ]?|[ ]at[ ]", re.IGNORECASE)
DOMAIN = re.compile(r"[\w-]++(?:(?:\.|[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?|[ ]dot[ ])[\w-]++){1,8}+", re.IGNORECASE)
CHAIN = re.compile(r"[0-9]++(?:[  ().\-/]{1,2}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
# Words that stand near personal data, and near numbers of other kinds
CUES = {
    "email": re.compile(r"mail|contact|write|schreib|correo|courriel", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|from|client", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|amex|credit|karte|tarjeta|carte", re.IGNORECASE),
    "phone": re.compile(r"phone|tel|call|fax|mobil|fon|llama|appel", re.IGNORECASE),
}
OTHERS = re.compile(r"version|licen[sc]e|token|isbn|page|chapter|\bno\b|\bid\b|key|§|%|\$|€", re.IGNORECASE)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[Span]:
    at, end = text.find("@"), 0
    while at >= 0:
        domain = EMAIL_DOMAIN.match(text, at + 1)
        begin = at
        if domain:
            while begin > end and text[begin - 1] in _local:
                begin -= 1
        if begin < at:
            yield begin, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """What the base rules find of each kind, and the matches that failed their check."""
    good: dict[str, list[Span]] = {k: [] for k in KINDS}
    bad: dict[str, list[Span]] = {k: [] for k in KINDS}
    good["email"] = list(_emails(text))
    for m in IP.finditer(text):
        (good if all(map(_octet, m.group().split("."))) else bad)["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        (good if 16 <= len(digits) <= 19 and luhn(digits) else bad)["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            n = len(re.sub("[^0-9]", "", m.group()))
            (good if 8 <= n <= 15 else bad)["phone"].append(m.span())
    return good, bad


def proposals(text: str) -> Iterator[tuple[str, int, int, list[Span]]]:
    """(kind, start, end, digit groups): all spans that may be personal data, overlapping; linear in the text."""
    for m in AT.finditer(text):
        domain = DOMAIN.match(text, m.end())
        local = LOCAL_END.search(text, max(0, m.start() - 64), m.start()) if domain else None
        if local:
            yield "email", local.start(), domain.end(), []
    for chain in CHAIN.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, *chain.span())]
        for i, (start, first_end) in enumerate(groups):
            digits = 0
            for j in range(i, min(i + 6, len(groups))):
                a, end = groups[j]
                digits += end - a
                if digits > 19:
                    break
                part = groups[i : j + 1]
                gaps = [text[x[1] : y[0]] for x, y in zip(part, part[1:], strict=False)]
                if len(part) == 4 and all(x == "." for x in gaps):
                    yield "ip", start, end, part
                sizes = [y - x for x, y in part]
                if 13 <= digits and (len(part) == 1 or (sizes[0] == 4 and (sizes[1] == 6 or set(sizes[:-1]) == {4}))):
                    yield "card", start, end, part
                if 7 <= digits <= 15:
                    begin = start
                    while begin > 0 and text[begin - 1] in "+(" and start - begin < 2:
                        begin -= 1
                    yield "phone", begin, end, part


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "\"'=<>_@/\\#" else 5


def features(text: str, kind: str, start: int, end: int, groups: list[Span]) -> list[float]:
    """Format of a proposal and of its surroundings."""
    body, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    outer = len(left) - len(left.rstrip(_joined)) + len(right) - len(right.lstrip(_joined))
    context = [_class(left[-1:]), _class(right[:1]), sum(map(str.isdigit, left)), sum(map(str.isdigit, right)), sum(map(str.isdigit, left[-3:])), sum(map(str.isdigit, right[:3])), outer, len(CUES[kind].findall(left)), len(OTHERS.findall(left)), right[:2].count("%")]
    if kind == "email":
        local, _, domain = re.sub(AT, "@", body, count=1).partition("@")
        labels = re.split(r"[^\w-]+", domain)
        form = [len(local), len(labels), len(labels[-1]), labels[-1].isalpha(), "@" in body, body.count(" "), body.isascii(), sum(map(str.isdigit, body)), local[:1].isalnum(), local[-1:].isalnum(), "dot" in labels, max(map(len, labels)), body.count("("), body.count("[")]
    else:
        sizes = [b - a for a, b in groups]
        digits = "".join(text[a:b] for a, b in groups)
        form = [len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), body.count(" "), body.count("-"), body.count("."), len(body) - len(digits), body[0] == "+", "(" in body, luhn(digits), all(_octet(text[a:b]) for a, b in groups), len(set(digits)), digits[0] == "0", body.count("(") == body.count(")"), sizes[1] if len(sizes) > 1 else 0, text[max(0, start - 1) : start] == "+", body.count("/")]
    return [float(x) for x in (*form, *context)]


_joined = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-+"


def _overlaps(spans: list[Span], start: int, end: int) -> bool:
    """Whether one of some sorted spans, none of which overlap, overlaps another."""
    before = bisect.bisect_left(spans, (end, end))  # those that begin before its end
    return before > 0 and spans[before - 1][1] > start


# --- examples ------------------------------------------------------------------


def _number(seed: str, n: int) -> str:
    return str(int(hashlib.md5(seed.encode()).hexdigest(), 16))[-n:].rjust(n, "7")


def _with_check(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def variants(kind: str, body: str) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): a base span in other formats and beside other numbers, and spoilt ones."""
    digits, n = re.sub("[^0-9]", "", body), len(body)
    if kind == "email":
        local, _, domain = body.partition("@")
        forms = [f"{local} (at) {domain}", f"{local}[at]{domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}"]
        return [*[(x, 0, len(x), 1) for x in forms], *[(x, 0, len(x), 0) for x in (f"{local} at {domain}", f"{local}@{domain.replace('.', '') }.{_number(body, 2)}")]]
    if kind == "ip":
        parts = body.split(".")
        beside, big = f"{_number(body, 4)} ", str(256 + int(_number(body, 2)))
        return [(f"{beside}{body}", len(beside), len(beside) + n, 1), (f"{body} {_number(body, 5)}", 0, n, 1), *[(".".join([*parts[:i], big, *parts[i + 1 :]]), 0, n + len(big) - len(parts[i]), 0) for i in (0, 3)], (f"{body}.{parts[0]}", 0, n, 0), (f"{parts[1]}.{body}", len(parts[1]) + 1, len(parts[1]) + 1 + n, 0)]
    if kind == "card":
        other = _with_check(_number(body, 15))
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(_number(body, 3)) % 9) % 10)
        forms = [digits, ".".join(groups), " ".join(groups), "/".join(groups)]
        return [*[(x, 0, len(x), 1) for x in forms], (f"{digits} {other}", 0, len(digits), 1), (f"{other} {digits}", 17, 17 + len(digits), 1), (f"{_number(body, 3)} {digits}", 4, 4 + len(digits), 1), (wrong, 0, len(digits), 0), (f"{wrong} {other}", 0, len(digits), 0), (" ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), 0, len(wrong) + len(groups) - 1, 0), (f"{other}{digits[:3]}", 0, 19, 0)]
    ip, plain = ".".join(str(int(_number(body + str(i), 3)) % 256) for i in range(4)), f"1{digits[-10:]}"
    beside = [f"{body} {ip}", f"{body} {_number(body, 16)}", f"{body} ({_number(body, 3)})"]
    national = body[body.find("(") :] if "(" in body else ""
    return [*[(x, 0, n, 1) for x in beside], *([(national, 0, len(national), 1)] if national else []), (f"{body}".replace("-", "."), 0, n, 1), (plain, 0, len(plain), 0), (digits[:8], 0, min(8, len(digits)), 0), (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", 0, 10, 0), (f"{_number(body, 4)} {_number(body, 3)}", 0, 8, 0)]


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features) of a text's proposals and of its base spans' variants."""
    good, bad = base_spans(text)
    right_ones = {k: set(good[k]) for k in KINDS}
    for kind, start, end, groups in proposals(text):
        label = (start, end) in right_ones[kind]
        if label or not _overlaps(bad[kind], start, end):
            yield KINDS.index(kind), int(label), features(text, kind, start, end, groups)
    for k, kind in enumerate(KINDS):
        for start, end in good[kind]:
            left, right = text[max(0, start - 2 * CONTEXT) : start], text[end : end + 2 * CONTEXT]
            for body, a, b, label in variants(kind, text[start:end]):
                changed = left + body + right
                for found, x, y, groups in proposals(changed):
                    if found == kind and (x, y) == (len(left) + a, len(left) + b):
                        yield k, label, features(changed, kind, x, y, groups)


# --- boosted trees -------------------------------------------------------------


@dataclass
class Trees:
    """Sum of small trees; a node of a tree compares one feature, the last level holds values."""

    base: float = 0.0
    columns: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column_, cut_, value in zip(self.columns, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, column_[node]] > cut_[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss, splits at quantiles."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: edges[b-1] < value <= edges[b]
    p = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(base=float(np.log(p / (1 - p))))
    total = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        col, cut_, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            best = (1e-9, None, None)
            g, h = grad[mine].sum(), hess[mine].sum()
            for c, e in enumerate(edges):
                if not len(e) or len(mine) < 2 * LEAF:
                    continue
                b = binned[mine, c]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (grad[mine], hess[mine], None))
                ok = (ns >= LEAF) & (len(mine) - ns >= LEAF)
                gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], c, i)
            if best[1] is not None:
                col[at], cut_[at] = best[1], edges[best[1]][best[2]]
            node[mine] = 2 * at + 1 + (x[mine, col[at]] > cut_[at])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        total += value[leaf]
        model.columns.append(col)
        model.cuts.append(cut_)
        model.values.append(value)
    return model


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Trees:
    """Set the least threshold (0.5 or more) from which on the examples' precision is ``precision``; none if none is."""
    s = model.score(x)
    order = np.argsort(-s, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(s[order][1:] != s[order][:-1], True)  # a threshold takes all of one score
    fits = np.flatnonzero((right >= precision) & last & (s[order] >= 0.5))
    model.threshold = float(s[order][fits[-1]]) if len(fits) else np.inf
    return model


def learned(docs: DataFrame, n: int | None = None) -> list[Trees | None]:
    """Trees of each kind from a sample of ``docs``; None where examples of either label are fewer than LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for t in column(batch, "text").to_pylist() if t and _any.search(t) for e in examples(t)]
            kinds, labels, x = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(labels, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["kind", "label", "x"])

    n = docs.count() if n is None else n
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = small_batches(some.select("text")).mapInArrow(freed(run), "kind int, label int, x array<double>")
    first = Window.partitionBy("kind", "label").orderBy(F.xxhash64("x"), "x")
    rows = found.withColumn("i", F.row_number().over(first)).where(F.col("i") <= EXAMPLES).select("kind", "label", F.pmod(F.xxhash64("x"), F.lit(4)).alias("fold"), "x").toArrow()  # EXAMPLES of each kind and label at most
    kind, label, fold = (rows.column(c).to_numpy() for c in ("kind", "label", "fold"))
    out: list[Trees | None] = []
    for k in range(len(KINDS)):
        mine = np.flatnonzero(kind == k)
        y = label[mine].astype(float)
        if min(y.sum(), len(y) - y.sum()) < LEAST:
            out.append(None)
            continue
        x = np.array(rows.column("x").take(pa.array(mine)).to_pylist(), float)
        order = np.lexsort((*x.T, y))
        x, y, apart = x[order], y[order], fold[mine][order] == 0
        out.append(calibrated(fit(x[~apart], y[~apart]), x[apart], y[apart]))
    return out


_any = re.compile("[0-9@]|[ (\\[{]at[ )\\]}]", re.IGNORECASE)


def spans_of(texts: list[str], models: list[Trees | None]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """Base spans and added spans of each text, by kind."""
    out, rows = [], [([], []) for _ in KINDS]  # for each kind: (text, start, end) and features
    for i, text in enumerate(texts):
        if not _any.search(text):
            out.append(({k: [] for k in KINDS}, {k: [] for k in KINDS}))
            continue
        good, _ = base_spans(text)
        out.append((good, {k: [] for k in KINDS}))
        taken = sorted(s for k in KINDS for s in good[k])
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
        begins = np.array([a for a, _ in taken])
        for kind, start, end, groups in proposals(text):
            model = models[KINDS.index(kind)]
            if model is None or model.threshold == np.inf:
                continue
            before = int(np.searchsorted(begins, end, side="left"))  # base spans that begin before the proposal's end
            if before and ends[before - 1] > start:
                continue
            where, x = rows[KINDS.index(kind)]
            where.append((i, start, end))
            x.append(features(text, kind, start, end, groups))
    better = []
    for k, (where, x) in enumerate(rows):
        if x:
            s = models[k].score(np.array(x))
            better += [(-s[j], *where[j], k) for j in np.flatnonzero(s >= models[k].threshold).tolist()]
    busy: dict[int, list[Span]] = {}
    for _, i, start, end, k in sorted(better):
        mine = busy.setdefault(i, [])
        if not _overlaps(mine, start, end):
            bisect.insort(mine, (start, end))
            out[i][1][KINDS[k]].append((start, end))
    return out


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def found(docs: DataFrame, models: list[Trees | None] | None = None, redact: bool = True) -> DataFrame:
    """(doc_id, spans, redacted): all spans of each text, by kind and start, and the text without them (null unless asked for).

    Offsets count code points. Null texts count as empty and have none; texts are searched whole, however long. Every
    row has its own result, repeated rows equal ones; an empty table gives no rows; other columns are not read. Where
    a kind has too few examples to learn from, only base rules find it.
    """
    models = learned(docs) if models is None else models
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                texts = [t or "" for t in column(batch, "text").to_pylist()]
                spans, clean = [], []
                for text, (good, more) in zip(texts, spans_of(texts, models), strict=True):
                    every = [sorted([(a, b, True) for a, b in good[k]] + [(a, b, False) for a, b in more[k]]) for k in KINDS]
                    spans.append([{"kind": k, "start": a, "end": b, "base": base} for k, own in zip(KINDS, every, strict=True) for a, b, base in own])
                    clean.append(redacted(text, {k: [(a, b) for a, b, _ in own] for k, own in zip(KINDS, every, strict=True)}) if redact else None)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(spans, pa.list_(kind)), pa.array(clean, pa.string())], names=["doc_id", "spans", "redacted"])

    rows = docs.select("doc_id", "text")
    return small_batches(rows).mapInArrow(freed(run), f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}, redacted string")


def op11(docs: DataFrame) -> DataFrame:
    """The contract's digest: base spans counted and hashed, all spans listed; edge cases are stated in ``found``."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found(docs, redact=False).withColumn("base", base).select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
