"""Byte-pair encoding and decoding on contiguous rank arrays.

A word is an array of part ids beside the array of ranks of its adjacent pairs. The smallest
rank is found by a scan, the boundary there is deleted, and the two ranks beside it are
looked up anew, until no pair has a rank. Short words of a batch stand in one matrix and take
these steps together (numpy); long runs of symbols, for which repeated scans would be
quadratic, keep their ranks in a heap and give the same merges.

The tokenizer file is read, never trained: NFC, lower case, words split at white space and at
letter, digit and symbol borders, byte-level symbols, an end-of-word mark on the last one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, freed

NONE = 1 << 30
#: Longest word, in bytes, that is merged in the matrix.
SHORT = 48
#: Words a worker remembers before it starts anew (bounds its memory).
REMEMBERED = 400_000

# The split pattern of the tokenizer file's pre-tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class _Words(dict):
    """Ids of each chunk between white space, as little-endian bytes; unknown ones are encoded on demand."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        self.codec.learn([chunk])
        return self[chunk]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        mark = spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.first = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + mark] for c in symbols], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), pairs[order, 2].astype(np.int32)
        self.made_by_rank = pairs[:, 2].astype(np.int32)
        self.pair_rank = {(int(a), int(b)): r for r, (a, b, _) in enumerate(pairs)}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known = _Words(self)
        self.parts: dict[str, bytes] = {}

    # --- merging -----------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE).astype(np.int32)

    def merge_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Encode words of 2 to ``width`` bytes, all rows of one matrix step by step."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.first[flat]
        rows = np.arange(n)
        ids[rows, lens - 1] = self.last[flat[rows, lens - 1]]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width - 1)[None, :] >= (lens - 1)[:, None]] = NONE
        done = np.zeros((n, width), np.int32)
        left = lens.copy()
        live = rows
        cols = np.arange(width - 1)
        while len(live):
            at = ranks.argmin(axis=1)
            here = np.arange(len(live))
            best = ranks[here, at]
            stop = best >= NONE
            if stop.any():
                done[live[stop]] = ids[stop]
                go = ~stop
                live, ids, ranks, at, best, here = live[go], ids[go], ranks[go], at[go], best[go], here[: int(go.sum())]
                if not len(live):
                    break
            ids[here, at] = self.made_by_rank[best]
            # delete the boundary: what lies behind it moves up by one
            take = cols[None, :] + (cols[None, :] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, take, axis=1)
            take = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, take, axis=1)
            left[live] -= 1
            ranks[:, -1] = NONE
            size = left[live]
            # refresh the ranks beside the merged part
            r = np.minimum(at + 1, width - 1)
            ranks[here, np.minimum(at, width - 2)] = np.where(at + 1 < size, self.ranks(ids[here, at], ids[here, r]), NONE)
            b = at > 0
            ranks[here[b], at[b] - 1] = self.ranks(ids[here[b], at[b] - 1], ids[here[b], at[b]])
        out = done.astype("<u4")
        return [out[i, : left[i]].tobytes() for i in range(n)]

    def merge_long(self, word: bytes) -> bytes:
        """Encode one long word: the same merges, the smallest rank (then the leftmost) from a heap."""
        ids = [int(self.first[b]) for b in word]
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pair_rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made_by_rank[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = int(self.last[w[0]]).to_bytes(4, "little")
            elif len(w) > SHORT:
                out[i] = self.merge_long(w)
            else:
                groups.setdefault(6 if len(w) <= 6 else 12 if len(w) <= 12 else 24 if len(w) <= 24 else SHORT, []).append(i)
        for width, members in groups.items():
            for lo in range(0, len(members), 20_000):
                some = members[lo : lo + 20_000]
                for i, ids in zip(some, self.merge_matrix([words[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    # --- encoding ----------------------------------------------------------

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks (no white space within) that aren't known yet."""
        pieces = [self.split(c) for c in chunks]
        fresh = list({p for c in pieces for p in c if p not in self.parts})
        if fresh:
            self.parts.update(zip(fresh, self.merge_words([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True))
        for c, ps in zip(chunks, pieces, strict=True):
            self.known[c] = b"".join([self.parts[p] for p in ps])

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased letter by letter, so never the final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Chunks between white space; \\x1c to \\x1f aren't white space to the tokenizer."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.findall(r"[^\s]+", text)
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        plans: list[list[str | int]] = []
        for text in texts:
            if self.cut is not None and "<|" in text:
                plan: list = []
                for piece in self.cut(text):
                    if piece in self.special:
                        plan.append(self.special[piece])
                    else:
                        plan += self.chunks(self.normalise(piece))
            else:
                plan = self.chunks(self.normalise(text))
            plans.append(plan)
        known = self.known
        fresh = {c for plan in plans for c in plan if c not in known}
        numbers = {c for c in fresh if isinstance(c, int)}
        for c in numbers:
            known[c] = c.to_bytes(4, "little")
        self.learn(list(fresh - numbers))
        get = known.__getitem__
        return [b"".join(map(get, plan)) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """Text of ids as the library's decoder gives it where a file names none: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """Tokenise column ``text`` of each row.

    Adds n_tokens, ids_sha256, decoded_sha256 and, as asked for, ids (array<int>) and decoded.
    Null and empty texts have no tokens; texts of any length are taken whole; columns of
    these names in the input are replaced; an empty table gives no rows.
    """
    path = path or default_path()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids + [T.StructField("decoded", T.StringType())] * keep_decoded
    df = docs.drop(*[f.name for f in added])
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ids = c.encode_batch(column(batch, "text").fill_null("").to_pylist())
                decoded = [c.decode(x) for x in ids]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                cols = [*batch.columns, pa.array(size), pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(x.encode()) for x in decoded], pa.string())]
                if keep_ids:
                    ends = np.append(0, np.cumsum(size)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if keep_decoded:
                    cols.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.mapInArrow(freed(run), schema)


def op1(docs: DataFrame) -> DataFrame:
    return encode_documents(docs.select("doc_id", "text"), keep_ids=False, keep_decoded=False).drop("text")
