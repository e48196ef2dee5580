"""Benchmark decontamination by a stored positional inverted index.

The index has one posting (term, document, position) for each occurrence of a term that
some benchmark window is looked up by, and one length record per document. Each window of
13 item words is looked up by its rarest terms: corpus frequencies of all benchmark words
are counted first, and only the LOOKUPS rarest of each window are indexed, so common words
never become postings unless a window has nothing else. A posting at document position p of
the term at item position q is aligned at p - q. An item is laid out in overlapping stretches
of 64 positions, each window within one, so the terms met are bits of a whole number: a
document and a stretch whose bits hold no window are given up at once. Of the others the
lists are intersected by offset: at one offset for exact phrases, whose places are then
compared word by word, and, for proximity, at offsets within slop of each other, by a window that
slides over the sorted offsets.

Everything is DataFrame and SQL functions. Postings are keyed by document as well as term
wherever they are grouped, so a passage that a third of all documents hold is no group in
one task. The benchmark's words go to all executors only below BROADCAST_WORDS words;
beyond that the same joins are shuffled.

Defined results: a null text has no words; an item without words has no window and one of
fewer than 13 words is one window; rows of the benchmark that share an item_id are items of
their own, which count as one item of that id; a null item_id is an id of its own that is no
part of `items`; a document without words is not contaminated; rows that repeat a doc_id have
the hits of all that id's texts each; a null doc_id has none; an empty benchmark hits nothing;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import pinned

WINDOW = 13
LOOKUPS = 4
#: Item positions from one stretch to the next; a stretch has 64, so that each window lies within one.
STRETCH = 64 - (WINDOW - 1)
#: The length record's place in the index; no word is empty.
LENGTH = ""
#: Words from one block of a text to the next; a block has 64 more, so that each stretch lies within one.
BLOCK = 256
BROADCAST_WORDS = 2_000_000
FILTER_BITS = 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and characters outside ASCII."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(pieces, lambda w: w != "")


class Benchmark:
    """Items (one for each different row) with their words, and how each window is looked up."""

    def __init__(self, benchmark: DataFrame):
        items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("item_words")).where("size(item_words) > 0").distinct()
        self.items = pinned(items.select(F.xxhash64("item_id", "item_words").alias("item"), "item_id", "item_words"))
        total = self.items.agg(F.sum(F.size("item_words"))).first()[0] or 0
        self.small = total <= BROADCAST_WORDS
        self.terms = self.items.select("item", F.posexplode("item_words").alias("q", "term"))

    def hinted(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def planned(self, frequency: DataFrame) -> DataFrame:
        """(item, lookups): for each window, the item positions of its rarest terms."""
        ranked = self.terms.join(frequency, "term", "left").select("item", "q", F.coalesce("n", F.lit(0)).alias("n"))
        lists = ranked.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("q", "n"))).alias("by_q"))
        starts = F.sequence(F.lit(1), F.greatest(F.size("by_q") - (WINDOW - 1), F.lit(1)))
        rarest = lambda i: F.slice(F.array_sort(F.transform(F.slice("by_q", i, WINDOW), lambda x: F.struct(x["n"].alias("n"), x["q"].alias("q")))), 1, LOOKUPS)
        lookups = F.array_distinct(F.transform(starts, lambda i: F.sort_array(F.transform(rarest(i), lambda x: x["q"]))))
        return lists.select("item", lookups.alias("lookups"))

    def looked_up(self, planned: DataFrame) -> DataFrame:
        """(item, q, term) of all lookups."""
        return planned.select("item", F.explode(F.array_distinct(F.flatten("lookups"))).alias("q")).join(self.terms, ["item", "q"])


def frequencies(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """(term, n): occurrences of each benchmark word in all documents."""
    vocabulary = bench.hinted(bench.terms.select("term").distinct())
    return docs.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, bench: Benchmark) -> DataFrame:
    """The index: (doc_id, term, pos) of the given terms, and (doc_id, LENGTH, n_words) once a row."""
    wanted = bench.hinted(terms.select("term").unionByName(terms.sparkSession.createDataFrame([(LENGTH,)], "term string")).distinct())
    return docs.select("doc_id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(LENGTH)))).alias("pos", "term")).join(wanted, "term")


def _masks(planned: DataFrame) -> DataFrame:
    """(item, stretch, masks): the windows that begin in a stretch, each as the bits of its lookups."""
    each = planned.select("item", F.explode("lookups").alias("w")).withColumn("stretch", F.floor(F.element_at("w", 1) / STRETCH))
    bits = F.aggregate("w", F.lit(0).cast("long"), lambda m, q: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (q - F.col("stretch") * STRETCH).cast("int"))))
    return each.select("item", "stretch", bits.alias("mask")).groupBy("item", "stretch").agg(F.collect_set("mask").alias("masks"))


def _held(bits: Column) -> Column:
    """Whether the bits hold one of the masks."""
    return F.exists("masks", lambda m: bits.bitwiseAND(m) == m)


def met_in(index: DataFrame, planned: DataFrame, bench: Benchmark) -> DataFrame:
    """(doc_id, item, stretch, masks, delta, bits): the offsets, with the terms met there, of all documents and stretches that hold the terms of a window, anywhere."""
    at = F.floor(F.col("q") / STRETCH)
    also = F.when((F.col("q") % STRETCH < 64 - STRETCH) & (at > 0), at - 1)
    chosen = bench.looked_up(planned).withColumn("stretch", F.explode(F.array(at, also))).where("stretch IS NOT NULL")
    chosen = chosen.select("item", "q", "term", "stretch", F.expr(f"shiftleft(1L, cast(q - stretch * {STRETCH} AS int))").alias("bit"))
    posted = index.join(bench.hinted(chosen), "term").select("doc_id", "item", "stretch", "bit", (F.col("pos") - F.col("q")).alias("delta"))
    # One shuffle: what follows groups and sorts within (document, item, stretch), and gathers no list.
    by = ["doc_id", "item", "stretch"]
    offsets = posted.repartition(*by).groupBy(*by, "delta").agg(F.bit_or("bit").alias("bits"))
    seen = offsets.withColumn("seen", F.bit_or("bits").over(Window.partitionBy(*by)))
    return seen.join(bench.hinted(_masks(planned)), ["item", "stretch"]).where(_held(F.col("seen"))).select(*by, "masks", "delta", "bits")


def aligned(met: DataFrame) -> DataFrame:
    """(doc_id, item, stretch, delta) where all lookups of a window meet at one offset, as in an exact phrase."""
    return met.where(_held(F.col("bits"))).select("doc_id", "item", "stretch", "delta")


def near(met: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item) where all lookups of a window meet at offsets within slop of each other: a window slides over the sorted offsets."""
    ahead = Window.partitionBy("doc_id", "item", "stretch").orderBy("delta").rangeBetween(0, slop)
    return met.withColumn("within", F.bit_or("bits").over(ahead)).where(_held(F.col("within"))).select("doc_id", "item").distinct()


def occurrences(docs: DataFrame, candidates: DataFrame, bench: Benchmark) -> DataFrame:
    """(doc_id, item, item_id, start, length): every place where a window occurs in full.

    Texts are laid out in overlapping blocks of words, and each candidate place is joined with
    the one block that holds its stretch: a place is compared over 64 words, whatever the
    lengths of the text and the item, and however many places a text has.
    """
    slot = f"(xxhash64(doc_id) & {(1 << FILTER_BITS) - 1})"
    bits = candidates.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, cast({slot} & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # At most 2**17 rows: texts that hold no candidate stay where they are.
    texts = docs.withColumn("word", F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(bits), "word").where(f"shiftright(bits, cast({slot} & 63 AS int)) & 1 = 1")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("doc_words") - 1) / BLOCK).cast("int")),
        lambda b: F.array_join(F.slice("doc_words", b * BLOCK + 1, BLOCK + 64), " "),  # no word holds a blank
    )
    laid = texts.select("doc_id", words(F.col("text")).alias("doc_words")).where("size(doc_words) > 0").select("doc_id", F.posexplode(blocks).alias("block", "block_words"))
    # Where in the document the stretch begins, or what of it lies within the text.
    begin = F.greatest(F.lit(0), F.col("delta") + F.col("stretch") * STRETCH).cast("long")
    places = candidates.select("doc_id", "item", "stretch", "delta", begin.alias("at")).withColumn("block", F.floor(F.col("at") / BLOCK).cast("int"))
    here = places.join(laid, ["doc_id", "block"]).withColumn("block_words", F.split("block_words", " ")).join(bench.hinted(bench.items), "item")
    first, own = (F.col("at") - F.col("delta")).cast("int"), (F.col("at") - F.col("block") * BLOCK).cast("int")
    here = here.select(
        "doc_id", "item", "item_id", "at", F.least(F.size("item_words"), F.lit(WINDOW)).alias("length"),
        F.slice("block_words", own + 1, 64).alias("x"), F.slice("item_words", first + 1, 64).alias("y"),
    )
    n = F.least(F.size("x"), F.size("y"))
    here = here.withColumn("same", F.zip_with(F.slice("x", 1, n), F.slice("y", 1, n), lambda x, y: x == y)).where("size(same) >= length")
    begins = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("length")), lambda i: F.forall(F.slice("same", i + 1, F.col("length")), lambda x: x))
    return here.select("doc_id", "item", "item_id", "length", "at", F.explode(begins).alias("i")).select("doc_id", "item", "item_id", (F.col("at") + F.col("i")).alias("start"), "length").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, slop: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, n_near_items) for every row.

    n_hit: words inside some window's occurrence; items: their item_ids as sorted strings;
    n_near_items, with slop: item_ids one of whose windows has its rarest terms within slop of
    their places.
    """
    docs = documents.select("doc_id", "text")
    bench = Benchmark(benchmark)
    planned = pinned(bench.planned(frequencies(docs, bench)))
    index = pinned(postings(docs, bench.looked_up(planned), bench))
    lengths = index.where(F.col("term") == LENGTH).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    met = pinned(met_in(index.where(F.col("term") != LENGTH), planned, bench))
    found = occurrences(docs, pinned(aligned(met)), bench)
    # Union of the intervals of a document: each adds what lies beyond all before it.
    before = Window.partitionBy("doc_id").orderBy("start", "length", "item").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.col("start"))))
    hits = found.withColumn("fresh", fresh).groupBy("doc_id").agg(
        F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("nameless")
    )
    zero = F.lit(0).cast("long")
    out = lengths.join(hits, "doc_id", "left").withColumn("n_hit", F.coalesce("n_hit", zero))
    if slop:
        ids = near(met, slop).join(bench.hinted(bench.items.select("item", "item_id")), "item").groupBy("doc_id")
        out = out.join(ids.agg((F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("long"))).alias("n_near_items")), "doc_id", "left").withColumn("n_near_items", F.coalesce("n_near_items", zero))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.when(F.col("items").isNull(), zero).otherwise(F.size("items") + F.col("nameless")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *(["n_near_items"] if slop else []),
    )
