"""How filters of documents overlap, for every order in which they may be applied.

Each document's failures are bits of a mask; masks are counted per part of the corpus (at
most 2 ** filters rows a part, summed before the shuffle). A part's counts become a decision
diagram: one level per filter, a low child for documents that pass it and a high one for
those that fail, and vectors of counts (documents, good ones, toxic ones) as leaves. Nodes are
kept once for equal subtrees, and each remembers the sum of its leaves. Another order of the
filters is another order of the levels, reached by swapping adjacent ones: all orders are
visited by a sequence in which neighbours differ by one swap. In each of them the path of low
children is what is left after each step, and the high child beside it is what the step removes.

Defined results: a null text is empty; a null part is the empty string; a null doc_id is
neither smaller nor larger than another, so its text fails no comparison of ids and is no other
document's first; rows that repeat a doc_id are counted one by one, with the labels of that id
(1 if any row of labels says 1); an empty table has no parts; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import forget
from ._words import BLANKS, PIECE, span_hashes, spans, text_buffers

#: The filters' letters; bit i of a mask is a failure of the i-th.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_CAPITAL, _SYMBOL, _STARTS = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(b"#$%&*|")] = True
_STARTS[0x80:0xC0] = False  # bytes that go on with a code point


def own_failures(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D of each row; b holds all rows' bytes, cuts are their borders."""
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])
    starts, ends = spans(b, cuts, BLANKS)
    hashes, borders = span_hashes(b, starts, ends), np.searchsorted(starts, cuts)
    n = np.diff(borders)
    for x, y in zip(borders[:-1], borders[1:]):
        hashes[x:y].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[borders[:-1][n > 0]] = True
    distinct = np.diff(np.concatenate([[0], np.cumsum(new)])[borders])
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * sums(_CAPITAL[b]) > MOST_CAPITALS * sums(_STARTS[b]), sums(_SYMBOL[b]) > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, print, text) -> (doc_id, part, print, mask) with the bits A to D."""
    for batch in batches:
        forget()
        offsets, data = text_buffers(batch.column("text"))
        masks, low, rows = [], 0, len(offsets) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 2 * PIECE, "right")) - 1)
            masks.append(own_failures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
            low = high
        mask = pa.array(np.concatenate(masks) if masks else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "print")), mask], ["doc_id", "part", "print", "mask"])


def failures(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every row.

    One shuffle by doc_id meets the labels and the texts that a document is the first one of:
    only those pass E. No text is a group's key beyond a partial minimum, however many copies it has.
    """
    docs = documents.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("print", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    masked = docs.select("doc_id", "part", "print", "text").mapInArrow(_masked, "doc_id long, part string, print binary, mask long")
    firsts = docs.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "print", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    marked = labels.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("binary").alias("print"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    beside = firsts.unionByName(marked).groupBy("doc_id").agg(F.collect_set("print").alias("firsts"), F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    met = masked.join(beside, "doc_id", "left")
    repeats = F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("firsts", F.col("print")), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").alias(c)
    return met.select("part", (F.col("mask") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), flag("good"), flag("toxic"))


class Diagram:
    """A quasi-reduced decision diagram over some variables, in an order of them, with vectors as leaves."""

    def __init__(self, variables: int, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(variables))
        #: id -> (low, high), or a leaf's vector; ids of equal nodes are equal.
        self.nodes: list[tuple] = []
        self.sums: list[tuple[int, ...]] = []
        self._ids: dict[tuple, int] = {}
        self.root = self._built(counts, 0, 0, (0,) * width)

    def _node(self, *key) -> int:
        if key not in self._ids:
            self._ids[key] = len(self.nodes)
            self.nodes.append(key)
            self.sums.append(key[1] if key[0] == "leaf" else tuple(map(sum, zip(self.sums[key[0]], self.sums[key[1]]))))
        return self._ids[key]

    def _built(self, counts: dict[int, tuple[int, ...]], level: int, mask: int, nothing: tuple[int, ...]) -> int:
        if level == len(self.order):
            return self._node("leaf", counts.get(mask, nothing))
        low, high = (self._built(counts, level + 1, mask | fails << self.order[level], nothing) for fails in (0, 1))
        return self._node(low, high)

    def swap(self, level: int) -> None:
        """Exchanges the variables of a level and of the next one; only nodes of the two are rebuilt."""
        done: dict[int, int] = {}

        def exchanged(node: int, depth: int) -> int:
            if node not in done:
                low, high = self.nodes[node]
                if depth < level:
                    done[node] = self._node(exchanged(low, depth + 1), exchanged(high, depth + 1))
                else:
                    (ll, lh), (hl, hh) = self.nodes[low], self.nodes[high]
                    done[node] = self._node(self._node(ll, hl), self._node(lh, hh))
            return done[node]

        self.root = exchanged(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, left, removed) down the path of documents that fail nothing."""
        node = self.root
        for variable in self.order:
            node, removed = self.nodes[node]
            yield variable, self.sums[node], self.sums[removed]

    def alone(self, variable: int) -> tuple[int, ...]:
        """The leaf of documents that fail this variable only."""
        node = self.root
        for v in self.order:
            node = self.nodes[node][v == variable]
        return self.sums[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """n! - 1 places at which to swap neighbours, so as to visit all orders of n things (plain changes)."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        place = next(inner, None)
        if place is None:
            return
        yield place + down  # the largest has moved to the front or to the back
        down = not down


def audited(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders; counts are (documents, good, toxic) of each mask."""
    diagram, n = Diagram(len(filters), counts, 3), len(filters)
    swaps, found, total, failing = adjacent_swaps(n), {}, [0] * n, [0] * n
    alone = [diagram.alone(v)[0] for v in range(n)]
    while True:
        order = "".join(filters[v] for v in diagram.order)
        found[order] = list(diagram.steps())
        for step, (variable, _, removed) in enumerate(found[order]):
            total[variable] += removed[0]
            if step == 0:  # nothing has been removed before
                failing[variable] = removed[0]
        place = next(swaps, None)
        if place is None:
            break
        diagram.swap(place)
    return [
        (order, step + 1, left[0], removed[0], failing[v] - removed[0], alone[v], removed[1], removed[2], total[v])
        for order, steps in sorted(found.items())
        for step, (v, left, removed) in enumerate(steps)
    ]


_COLUMNS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def filter_audit(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row per part, order and step."""
    counts = failures(documents, labels, part).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:  # at most one row per mask
        table = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(audited(table), columns=_COLUMNS)
        out.insert(0, "part", rows["part"].iloc[0])
        return out.astype({"step": "int32"})

    longs = ", ".join(f"{c} long" for c in _COLUMNS[2:])
    return counts.groupBy("part").applyInPandas(of_part, f"part string, filter_order string, step int, {longs}")
