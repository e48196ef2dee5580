"""Collocations: phrases whose words stand together more often than apart, per part of the corpus.

Words are counted first, with their partial sums. Only words that are frequent enough to be in
a frequent phrase begin or go on a suffix, of up to DEPTH words of one piece; equal suffixes of
a batch are one row with a count. Suffixes are routed by their leading words: by two; by three
where the first two are both so frequent that their pair might be too much for one task; by all
four where the third one is as well. A task gets the suffixes of its groups together and sorts
pointers to them by multikey three-way quicksort: a pivot word splits a partition into the
suffixes whose word at this depth is smaller, equal or larger; the equal ones share a phrase,
whose count is the partition's weight, and go one word deeper. A partition whose weight is below
the threshold holds no frequent phrase and is abandoned, unless its phrases are so short that
the routing has dealt them to several tasks; such partial counts, and those of a group larger than
a task's buffer, are summed afterwards.

Of the vocabulary, a bounded number of words has short numbers that go to all executors; other
frequent words are known by a bounded filter and carried by fingerprint (64 bits, the top one set).
Both only change what is shuffled.

Defined results: a null text is empty; a null part is `und`; parts without words and parts
without candidates have no rows; rows are counted one by one, whatever their ids; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import forget, pinned
from ._words import LOWER, U, hash_of, mix, separators, span_hashes, spans, text_buffers

DEPTH, LEAST, TOP = 4, 30, 2000
#: Words with a number of 16 bits; 0 is no word, OTHER a word without a number.
NUMBERED, OTHER = (1 << 16) - 2, (1 << 16) - 1
#: A word with more than one in HOT of all occurrences: groups led by such words only are dealt by one word more.
HOT = 512
#: Bits of the filter of frequent words.
FILTER_BITS = 23
#: Bytes of text that are cut at a time; suffixes whose equal ones are merged; suffixes that a task sorts together.
CHUNK, MERGED, BUFFER = 4 << 20, 1 << 20, 1 << 20
#: Partitions of fewer pointers are sorted at once.
SMALL = 4096
_ENDS = separators((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
_SLOT = f"(shiftrightunsigned(key, {63 - FILTER_BITS}) & {(1 << FILTER_BITS) - 1})"
_SEPARATORS = _ENDS | separators((0x20, 0x20), (0x09, 0x09))


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunks of whole rows: bytes, words' starts and ends, their keys (a fingerprint of part and word), the piece and the row of each."""
    offsets, data = text_buffers(batch.column("text"))
    part = batch.column("part").dictionary_encode()
    salts = np.array([hash_of(f"part {p}") for p in part.dictionary.to_pylist()] or [0], U)[part.indices.to_numpy()]
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        b = data[offsets[low] : offsets[high]]
        starts, ends = spans(b, offsets[low : high + 1] - offsets[low], _SEPARATORS)
        if len(starts):
            row = np.searchsorted(offsets[low : high + 1] - offsets[low], starts, "right") - 1
            piece = np.cumsum(_ENDS[b], dtype=np.int32)[starts]
            lower = LOWER[b]
            keys = mix(span_hashes(lower, starts, ends) ^ salts[low + row], 31) | U(1 << 63)
            yield lower, starts, ends, keys, piece, row + low
        low = high


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) -> (part, word, key, n), summed within a chunk."""
    for batch in batches:
        forget()
        for b, starts, ends, keys, _, row in _cut(batch):
            key, first, n = np.unique(keys, return_index=True, return_counts=True)
            s, size = starts[first], (ends - starts)[first]
            borders = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(borders[-1]) + np.repeat(s - borders[:-1], size)
            words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(b[at])]).cast(pa.large_string()).cast(pa.string())
            part = batch.column("part").take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([part, words, pa.array(key.view(np.int64)), pa.array(n)], ["part", "word", "key", "n"])


class Vocabulary:
    """The numbered words, most frequent first, and the filter of all frequent ones; goes to all executors, its size bounded."""

    def __init__(self, frequent: DataFrame, total: int):
        # The least count that at most NUMBERED words reach, from a histogram of bounded size.
        step = F.floor(F.log2("n") * 16)
        held = frequent.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).toPandas()
        fits = held["step"][held["words"].cumsum() <= NUMBERED]
        top = frequent.where(step >= int(fits.min())) if len(fits) else frequent.limit(0)
        top = top.select("key", "n").toPandas().sort_values(["n", "key"], ascending=[False, True], ignore_index=True)
        self.keys = np.concatenate([[U(0)], top["key"].to_numpy(np.int64).view(U)])
        #: Words with numbers of at most this are hot.
        self.hot = int((top["n"] * HOT > total).sum())
        order = np.argsort(self.keys[1:], kind="stable")
        self.sorted, self.number = self.keys[1:][order], (order + 1).astype(np.int64)
        slots = frequent.selectExpr(f"shiftright({_SLOT}, 6) AS word", f"shiftleft(1L, cast({_SLOT} & 63 AS int)) AS bit")
        bits = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2**17 rows
        self.filter = np.zeros(1 << (FILTER_BITS - 6), U)
        self.filter[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(U)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word: OTHER if it may be frequent and has none, 0 if it isn't frequent."""
        slot = (keys >> U(63 - FILTER_BITS)) & U((1 << FILTER_BITS) - 1)
        frequent = (self.filter[slot >> U(6)] >> (slot & U(63))) & U(1) == 1
        out = np.zeros(len(keys), np.int64)
        if len(self.sorted):
            asked = keys[frequent]
            at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            out[frequent] = np.where(self.sorted[at] == asked, self.number[at], OTHER)
        else:
            out[frequent] = OTHER
        return out


def _suffixes(shared):
    """(part, text) -> (head, rest, n): the numbers of up to DEPTH words, the keys of those without one, how often."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        head = np.concatenate([h for h, _ in held])
        keys = np.concatenate([k for _, k in held])
        others = (keys != 0).sum(axis=1)
        for u in range(DEPTH + 1):
            own = others == u
            if not own.any():
                continue
            if u == 0:
                heads, n = np.unique(head[own], return_counts=True)
                rest = pa.nulls(len(heads), pa.binary())
            else:
                k = keys[own]
                rows = np.concatenate([head[own][:, None], k[k != 0].reshape(-1, u)], axis=1)
                order = np.lexsort(rows.T[::-1])
                rows = rows[order]
                first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
                heads, n = rows[first, 0], np.diff(np.append(first, len(rows)))
                rest = pa.Array.from_buffers(pa.binary(8 * u), len(first), [None, pa.py_buffer(np.ascontiguousarray(rows[first, 1:]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), rest, pa.array(n)], ["head", "rest", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, size = shared.value, [], 0
        for batch in batches:
            forget()
            for _, _, _, keys, piece, row in _cut(batch):
                number = vocabulary.numbers(keys)
                goes_on = np.zeros(len(keys), bool)
                goes_on[:-1] = (number[:-1] > 0) & (number[1:] > 0) & (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
                at = np.flatnonzero(goes_on)
                alive, head, wide = np.ones(len(at), bool), np.zeros(len(at), U), np.zeros((len(at), DEPTH), U)
                for j in range(DEPTH):
                    if j:
                        alive = alive & goes_on[np.minimum(at + j - 1, len(keys) - 1)]
                    here = np.where(alive, np.minimum(at + j, len(keys) - 1), 0)
                    word = np.where(alive, number[here], 0)
                    head |= word.astype(U) << U(16 * (DEPTH - 1 - j))
                    wide[:, j] = np.where(word == OTHER, keys[here], U(0))
                held.append((head, wide))
                size += len(at)
                if size >= MERGED:
                    yield from merged(held)
                    held, size = [], 0
        if held:
            yield from merged(held)

    return run


def _word(j: int) -> Column:
    """The number of a suffix's j-th word."""
    return F.shiftrightunsigned("head", 16 * (DEPTH - 1 - j)).bitwiseAND(0xFFFF)


def _group(hot: int) -> tuple[Column, Column]:
    """(group, depth): a fingerprint of the leading words by which a suffix is routed, and their number."""
    is_hot = [(_word(j) > 0) & (_word(j) <= hot) for j in range(DEPTH - 1)]

    def leading(d: int) -> Column:
        others = reduce(lambda x, y: x + y, [(_word(j) == OTHER).cast("int") for j in range(d)])
        return F.xxhash64(F.lit(d), F.shiftrightunsigned("head", 16 * (DEPTH - d)), F.coalesce(F.substring(F.col("rest"), F.lit(1), others * 8), F.lit(b"")))

    two, three = ~(is_hot[0] & is_hot[1]), ~is_hot[2]
    return F.when(two, leading(2)).when(three, leading(3)).otherwise(leading(4)), F.when(two, 2).when(three, 3).otherwise(4)


def quicksort(words: np.ndarray, n: np.ndarray, partial: int, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """(phrase, count) of all phrases of two words or more that suffixes begin with.

    words: a row per suffix, 0 after its last word. Phrases of up to `partial` words are returned
    whatever their counts, longer ones from `least` on.
    """
    stack = [(np.arange(len(words)), 0)]
    while stack:
        pointers, depth = stack.pop()
        if not len(pointers) or depth >= partial and n[pointers].sum() < least:
            continue
        at = words[pointers, depth]
        if len(pointers) <= SMALL:
            # Small partitions: one sort, then the equal runs at each depth.
            rows = words[pointers]
            order = np.lexsort(rows[:, depth:].T[::-1])
            rows, sums = rows[order], np.concatenate([[0], np.cumsum(n[pointers][order])])
            new = np.zeros(len(rows), bool)
            new[0] = True
            for d in range(depth, words.shape[1]):
                new[1:] |= rows[1:, d] != rows[:-1, d]
                first = np.flatnonzero(new)
                count = sums[np.append(first[1:], len(rows))] - sums[first]
                if d:
                    kept = (rows[first, d] != 0) & ((count >= least) | (d < partial))
                    for i, c in zip(first[kept], count[kept]):
                        yield rows[i, : d + 1], int(c)
            continue
        pivot = np.sort(at[:: max(1, len(at) // 33)])[min(len(at), 33) // 2]
        equal = pointers[at == pivot]
        stack += [(pointers[at < pivot], depth), (pointers[at > pivot], depth)]
        count = int(n[equal].sum())
        if pivot and depth and (count >= least or depth < partial):
            yield words[equal[0], : depth + 1], count
        if pivot and depth + 1 < words.shape[1]:
            stack.append((equal, depth + 1))


def _sorting(shared, least: int):
    """Rows sorted by group (depth, group, head, rest, n) -> (phrase, n): phrases as arrays of keys."""

    def counted(held: list[tuple[np.ndarray, ...]], partial: bool) -> Iterator[pa.RecordBatch]:
        depth, head, wide, n = (np.concatenate(x) for x in zip(*held))
        out: tuple[list, list] = ([], [])
        for d in (2, 3, 4):
            own = np.flatnonzero(depth == d)
            for phrase, count in quicksort(wide[own], n[own], DEPTH if partial else d - 1, least):
                out[0].append(phrase)
                out[1].append(count)
        if out[0]:
            flat, sizes = np.concatenate(out[0]), np.array([len(p) for p in out[0]])
            named = flat < U(1 << 16)
            flat[named] = shared.value.keys[flat[named].astype(np.int64)]
            phrases = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([phrases, pa.array(np.array(out[1], np.int64))], ["phrase", "n"])

    def decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        head = batch.column("head").to_numpy().view(U)
        wide = np.stack([(head >> U(16 * (DEPTH - 1 - j))) & U(0xFFFF) for j in range(DEPTH)], axis=1)
        other = wide == OTHER
        if other.any():
            rest = batch.column("rest").drop_null()
            wide[other] = np.frombuffer(b"".join(rest.to_pylist()), U)  # row by row, as they were written
        return batch.column("depth").to_numpy(), head, wide, batch.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, split, last = [], 0, False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            parts = decoded(batch)
            low = 0
            if held and size + len(group) > BUFFER:
                # Up to the end of the group that is being read; if it doesn't end here, it is counted in parts.
                borders = np.flatnonzero(group != np.concatenate([[last], group[:-1]]))
                low = int(borders[0]) if len(borders) else len(group)
                held.append(tuple(x[:low] for x in parts))
                split_on = not len(borders)
                yield from counted(held, split or split_on)
                held, size, split = [], 0, split_on
            if low < len(group):
                held.append(tuple(x[low:] for x in parts))
                size += len(group) - low
            last = group[-1]
        if held:
            yield from counted(held, split)

    return run


def phrases(texts: DataFrame, vocabulary: Vocabulary, least: int = LEAST) -> DataFrame:
    """(phrase, n): the phrases of 2 to DEPTH words with at least that many occurrences."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    suffixes = texts.mapInArrow(_suffixes(shared), "head long, rest binary, n long")
    group, depth = _group(vocabulary.hot)
    routed = suffixes.repartition(group).withColumn("group", group).withColumn("depth", depth.cast("int")).sortWithinPartitions("group")
    counts = routed.mapInArrow(_sorting(shared, least), "phrase array<long>, n long")
    return counts.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(documents: DataFrame, part: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): each part's best phrases."""
    texts = documents.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_counting, "part string, word string, key long, n long").groupBy("part", "word", "key").agg(F.sum("n").alias("n"))
    counts = pinned(counts)
    totals = pinned(counts.groupBy("part").agg(F.sum("n").alias("total")))
    words = pinned(counts.where(F.col("n") >= least))
    vocabulary = Vocabulary(words, int(totals.agg(F.sum("total")).first()[0] or 0))

    candidates = pinned(phrases(texts, vocabulary, least))
    known = candidates.unionByName(words.select(F.array("key").alias("phrase"), "n"))
    size = F.size("phrase")
    # Every cut, with the counts of its two sides: both are as frequent as the phrase, so both are known.
    cuts = candidates.select("phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("first"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("rest"))
    of = lambda side, name: known.select(F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(of("first", "l"), "first").join(of("rest", "r"), "rest")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.select("phrase", "a", "k", "l", "r", (F.lit(2_000_000).cast("decimal(7,0)") * exact("a")).alias("x"), (exact("l") + exact("r")).alias("y"))
    best = cuts.withColumn("score", F.expr("x div y")).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("phrase", "a", "cut.*")

    # Phrases within a longer candidate that has nearly all of their occurrences.
    inner = candidates.where(size > 2).select("n", size.alias("size"), "phrase", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("n", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")).select(F.slice("phrase", F.col("at"), F.col("m")).alias("phrase"), "n")
    longer = inner.groupBy("phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < exact("a") * 80))

    named = kept.withColumn("id", F.xxhash64("phrase")).select("id", "phrase", "a", "l", "r", "score", F.posexplode("phrase").alias("at", "key")).join(words.select("part", "word", "key"), "key")
    named = named.groupBy("phrase", "a", "l", "r", "score", "part").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = named.select("part", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "l", "r", "score")
    # The best of each of 64 shares of a part, then of those: no part's candidates are one task's.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("part", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "part").select("part", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
