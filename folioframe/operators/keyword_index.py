"""Keyword search that skips blocks of rows by the trigrams they hold.

Rows lie in blocks; a block's signature is a bit set of the hashes of all trigrams of its
searched columns, ASCII letters in lower case, as the search compares them. A LIKE pattern's
literal runs (between wildcards, backslash escapes taken off) hold trigrams that a matching
column must hold as well, so a block that lacks one of them has no match and is not read.
A set bit may be another trigram's: such a block is read in vain, and LIKE decides on its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators import catalog

#: Bits of a block's signature (8 KiB).
BITS = 1 << 16
SEARCHED = ("title", "file_name", "document_number", "summary", "keywords")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bit(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS)).cast("int")


def signatures(documents: DataFrame, columns=SEARCHED, block: str = "block") -> DataFrame:
    """(block, word, bits): 64 bits of a block's signature a row, without rows of none. Only distinct bits of a row are shuffled, merged within each task first."""
    text = lambda c: F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), _UPPER, _LOWER)
    at = lambda cs, i: F.coalesce(F.get(cs, i), F.lit(""))
    # Characters are taken apart once a text, and within a lambda, so that no step goes through the text again.
    three = lambda cs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - 3, F.lit(0))), lambda i: F.concat(at(cs, i), at(cs, i + 1), at(cs, i + 2)))
    grams = lambda t: F.flatten(F.transform(F.array(F.split(t, "")), three))
    each = F.array_distinct(F.flatten(F.array(*(F.transform(F.filter(grams(text(c)), lambda g: F.length(g) == 3), _bit) for c in columns))))
    bits = documents.select(block, F.explode(each).alias("bit"))
    return bits.select(block, F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("b")).groupBy(block, "word").agg(F.bit_or("b").alias("bits"))


def literal_runs(pattern: str) -> list[str]:
    """The runs of a LIKE pattern that stand for themselves."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            run, i = run + pattern[i + 1], i + 1
        elif c in "%_":
            runs, run = [*runs, run], ""
        else:
            run += c
        i += 1
    return [r for r in [*runs, run] if r]


def blocks_to_read(signature: DataFrame, keyword: str, block: str = "block") -> DataFrame | None:
    """(block): those that may hold a match of %keyword%; None where the keyword has no trigram and all may."""
    low = keyword.translate(str.maketrans(_UPPER, _LOWER))
    grams = sorted({run[i : i + 3] for run in literal_runs(low) for i in range(len(run) - 2)})
    if not grams:
        return None
    wanted = F.array(*(F.struct(F.floor(_bit(F.lit(g)) / 64).cast("int").alias("word"), _bit(F.lit(g)).alias("bit")) for g in grams))
    asked = signature.sparkSession.range(1).select(F.explode(wanted).alias("w")).select("w.word", "w.bit").distinct()  # a row per trigram of the keyword
    met = signature.join(F.broadcast(asked), "word").where(F.expr("(shiftright(bits, bit % 64) & 1) = 1"))
    return met.groupBy(block).agg(F.countDistinct("bit").alias("n")).join(F.broadcast(asked.agg(F.count(F.lit(1)).alias("n"))), "n").select(block)


def search(documents: DataFrame, signature: DataFrame, keyword: str, block: str = "block", **filters) -> DataFrame:
    """The rows of `catalog.search`; only blocks that may hold the keyword are read: where documents are a table in folders by block, the others' files are pruned."""
    blocks = blocks_to_read(signature, keyword, block)
    if blocks is not None:
        found = [r[0] for r in blocks.collect()]  # at most as many as there are blocks
        documents = documents.where(F.col(block).isin(found)) if found else documents.limit(0)
    return catalog.search(documents, keyword=keyword, **filters)
