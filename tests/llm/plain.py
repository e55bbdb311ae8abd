"""Plain versions of the corpus operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, size):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def near_duplicates(rows, size, per_cent=80):
    sets = {d: shingles(t, size) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    both = Counter()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    links = [p for p, n in both.items() if 100 * n >= per_cent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    comp = components(sets, links)
    return {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def repeated_bytes(rows, window=100):
    """Mask of removed bytes of each document."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            if s in seen:
                mask[i : i + window] = True
            seen.add(s)
        out[d] = mask
    return out


def bytes_digest(rows):
    out, texts = {}, dict(rows)
    for d, mask in repeated_bytes(rows).items():
        raw = (texts[d] or "").encode()
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[d] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def words_digest(rows, window=35):
    count, texts = Counter(), {d: (t or "").encode().split() for d, t in rows}
    for w in texts.values():
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, a common line, periodic, empty, null and long texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghié"), int(rng.integers(2, 9))))
    vocab = [word() for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab, k))
    passages = [text(45) for _ in range(3)]
    line = text(8)
    base = text(150)
    out = []
    for i in range(n):
        kind = i % 10
        t = text(int(rng.integers(1, 200)))
        if kind == 1:
            t = base
        elif kind in (2, 3):
            w = base.split()
            for _ in range(int(rng.integers(1, 14))):
                w[int(rng.integers(len(w)))] = word()
            t = " ".join(w)
        elif kind == 4:
            t = f"{t}\n{passages[i // 10 % 3]} {text(20)}"
        elif kind == 5:
            t = f"{line}\n{t}"
        elif kind == 6:
            t = (word() + ", ") * int(rng.integers(1, 120))
        elif kind == 7:
            t = [None, "", "  \t\n", "one", "two words", "a b c"][i // 10 % 6]
        out.append((i * 7 % 101, t))
    out.append((999, " ".join([text(3000), passages[0], passages[0]])))
    return out
