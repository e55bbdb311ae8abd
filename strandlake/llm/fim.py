"""Fill-in-middle rewriting by lookaround splitting.

A unit grammar says where a text may be cut: between a character of one class and a
character of another. It becomes a zero-width regular expression (a lookbehind for the one
class, a lookahead for the other), and Spark's ``split`` by it gives the units with nothing
lost: joined again they are the text. An empty text would split into one empty piece; it
has no units and is dealt with apart. Everything is DataFrame functions, row by row: no
shuffle, and a text is held by nobody but the task that rewrites it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
#: Marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of documents that are rewritten, and of those, that begin with the suffix.
REWRITTEN, SUFFIX_FIRST = 50, 80
SEED = 42


@dataclass(frozen=True)
class Units:
    """A unit ends after a character of ``ends`` if one of ``begins`` follows (classes as inside [])."""

    ends: str
    begins: str

    def boundary(self) -> str:
        return f"(?=[{self.begins}])(?<=[{self.ends}])"


ANY = r"\x00-\x{10FFFF}"
#: Words with the white space before them (white space at the end is a unit), lines with their ends, characters.
GRAMMARS = {"words": Units("^" + SPACE, SPACE), "lines": Units(r"\n", ANY), "characters": Units(ANY, ANY)}


def units(text: Column, grammar: str = "words") -> Column:
    """The units of a text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GRAMMARS[grammar].boundary(), -1))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and doc_id only (a null id counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rewritten(docs: DataFrame, grammar: str = "words", seed: int = SEED) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output) of each document; other columns are not read.

    ``form`` is "plain" (output is the text; parts are null), "psm" or "spm", after the order of the parts.
    Null texts count as empty; empty texts and those that hold a mark stay plain. Texts are cut whole, however long;
    rows that share a doc_id draw alike, so equal rows give equal rows; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    cut = rows.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("long"))
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= REWRITTEN), "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    placed = cut.select("doc_id", "text", "n", "units", form.alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = placed.select("doc_id", "text", "n", "form", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"))
    out = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    out = out.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(F.col("text"))
    return parts.withColumn("output", out)


def restored(rows: DataFrame) -> DataFrame:
    """Add ``restored``, the text that each row's ``output`` was made of by its ``form``; marks can't occur inside the parts."""
    cut = rows.withColumn("__parts", F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1))  # nothing, first part, second part, middle
    first, second, middle = (F.get("__parts", F.lit(i)) for i in (1, 2, 3))
    text = F.when(F.col("form") == "psm", F.concat(first, middle, second)).when(F.col("form") == "spm", F.concat(second, middle, first)).otherwise(F.col("output"))
    return cut.withColumn("restored", text).drop("__parts")


def op12(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``rewritten`` over words; edge cases are stated there."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = restored(rewritten(docs).select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(F.col("restored")).alias("restored_sha256"))
