"""Set-similarity join of documents on word shingles by PartEnum signatures.

A document is the set of its distinct w-word shingles. Set sizes are cut into bands so that
two similar sets lie in the same or in neighbouring bands; every set is signed for its own
band and for the next one. Two sets of one band whose Jaccard similarity reaches the
threshold differ in at most k shingles. The shingle domain is dealt into n1 groups of n2
partitions; some group holds at most k2 of the differences, so among its subsets of
n2 - k2 partitions there is one without any, and that subset's content, the signature, is
the same in both sets (`plan` has the numbers; all groups beyond those needed are slack,
which adds as many signatures that must agree, so that a document may leave out that many of
its signatures of the fewest shingles).

Equal sets are found by fingerprints of whole sets and linked to their smallest doc_id, which
alone goes on. Buckets of equal signatures are read as sorted runs, and each member makes a row
(pivot, member) with the run's smallest document; the rows of a pivot, summed over its runs,
are a star, and any two similar documents meet in a star. First each document is compared with
the one pivot that it shares most runs with, if counts of shingles in SKETCH classes don't rule
that out (the sum of their absolute differences is a lower bound of the number of differences);
linked documents are contracted. Then the stars that still hold several components are compared
member by member: a task gets a star's sets and counts common shingles by matrix products, so
pairs are cells of a bounded array and never rows, and what it returns are links that span
the components it has found similar. A star over MEMBERS documents or SHINGLES shingles is cut
into blocks, and each pair of blocks is a task's work of its own.

Defined results: a null text, and a text without words, has an empty set and links with
nothing; a text of fewer than w words is one shingle; rows that repeat a doc_id give one
output row each and share a component, which any of their texts may link; a null doc_id links
with nothing; doc_id is an integer (any other type is cast to long, and fails where it can't
be). Shingles are 64-bit fingerprints. Further columns of the input, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import pinned
from ._words import BLANKS, U, Words, mix, word_chunks
from .components import components

#: Subsets with fewer shingles than this tell little: a document leaves out those of fewer than t, for the largest t up to WEAK that makes at most `slack` of them.
WEAK = 2
#: Classes of the counts that rule out pairs; a byte each.
SKETCH = 256
#: Documents and shingles of a block; stars over either are compared block by block.
MEMBERS, SHINGLES = 1024, 1 << 20
#: Shingles that fewer members of a block hold are counted pair by pair, others by matrix products, so many columns at a time.
FEW, COLUMNS = 16, 4096
#: Rows of such a block that are looked at together.
SLICE = 128
#: Bits of the doc_id filter that goes to all executors: 1 MiB, whatever the input.
FILTER_BITS = 23


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, row after row, and each row's number of them."""
    h, counts = words.hashes, words.counts
    n, row_end = len(h), np.cumsum(counts)
    position, end_of = np.arange(n), np.repeat(row_end, counts)
    row_of, count_of = np.repeat(np.arange(len(counts)), counts), np.repeat(counts, counts)
    padded = np.concatenate([h, np.zeros(width, U)])
    total = np.zeros(n, U)
    for j in range(width):
        term = mix(padded[j : j + n], j + 1)
        total += np.where(position + j < end_of, term, U(0))
    starts_one = (position + width <= end_of) | ((count_of < width) & (position == end_of - count_of))
    shingles, rows = mix(total + np.minimum(count_of, width).astype(U))[starts_one], row_of[starts_one]
    each = np.bincount(rows, minlength=len(counts))
    borders = np.concatenate([[0], np.cumsum(each)])
    for a, b in zip(borders[:-1], borders[1:]):
        shingles[a:b].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
    return shingles[new], np.bincount(rows[new], minlength=len(counts))


class Bands:
    """Size bands for the threshold num/den, and each band's enumeration."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size, from 1; band 1 is size 1."""
        while self.low[-1] <= (sizes.max(initial=0)):
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return np.searchsorted(self.low, sizes, "right")

    def k(self, bands: np.ndarray) -> np.ndarray:
        """Most differences of two similar sets of at most the band's largest size."""
        while len(self.low) <= bands.max(initial=0):
            self.low.append(self.low[-1] * self.den // self.num + 1)
        largest = np.array(self.low)[bands] - 1
        return 2 * largest * (self.den - self.num) // (self.den + self.num)


def plan(k: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, slack) for k differences: n1 * C(n2, k2) signatures, slack + 1 of which agree at least."""
    if k <= 3:
        return 1, (1, 6, 6, 7)[k], k, 0
    if k <= 7:
        return 2, 6, k // 2, 0
    slack = 1 + k // 16
    return k // 2 + 1 + slack, 4 if k < 24 else 3, 1, slack


def signatures(shingles: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all rows with a shingle."""
    out = [(np.zeros(0, U), np.zeros(0, np.int64))]
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out[0]
    n = sizes[rows]
    border = np.concatenate([[0], np.cumsum(n)])
    element, value = mix(shingles, 77), mix(shingles, 78)
    own = bands.of(n)
    for band in (own, own + 1):
        plans = np.array([plan(int(k)) for k in bands.k(band)], np.int64).reshape(-1, 4)
        for n2, k2 in {(int(x), int(y)) for x, y in plans[:, 1:3]}:
            at = np.flatnonzero((plans[:, 1] == n2) & (plans[:, 2] == k2))
            groups = plans[at, 0]
            cells = np.concatenate([[0], np.cumsum(groups * n2)])
            mine = np.concatenate([np.arange(border[i], border[i + 1]) for i in at])
            owner = np.repeat(np.arange(len(at)), n[at])
            cell = cells[owner] + (element[mine] % (groups * n2)[owner].astype(U)).astype(np.int64)
            sums = np.zeros(cells[-1], U)
            np.add.at(sums, cell, value[mine])
            held = np.bincount(cell, minlength=cells[-1])
            row = np.repeat(np.arange(len(at)), groups)
            group = np.arange(len(row)) - (cells[:-1] // n2)[row]
            salt = mix(band[at][row].astype(U) * U(1 << 32) + group.astype(U), 79)
            parts, held = np.stack([mix(sums[j::n2], 90 + j) for j in range(n2)]), held.reshape(-1, n2).T
            chosen = [list(c) for c in combinations(range(n2), n2 - k2)]
            filled = [held[c].sum(axis=0) for c in chosen]
            least = np.zeros(len(at), np.int64)
            for t in range(1, WEAK + 1):
                n_weak = sum(np.bincount(row[f < t], minlength=len(at)) for f in filled)
                least = np.where(n_weak <= plans[at, 3], t, least)
            for c, (members, f) in enumerate(zip(chosen, filled)):
                stay = f >= least[row]
                sig = mix(parts[members].sum(axis=0, dtype=U) + salt, 200 + c)
                out.append((sig[stay], at[row[stay]]))
    sig, row = (np.concatenate(x) for x in zip(*out))
    return sig, rows[row]


def _scale(similarity: float) -> tuple[int, int]:
    """The threshold as a fraction of whole per mille."""
    return round(similarity * 1000), 1000


def prints(shingles: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two fingerprints of each row's whole set."""
    borders = np.concatenate([[0], np.cumsum(sizes)])
    sums = (np.concatenate([[U(0)], np.cumsum(mix(shingles, salt))]) for salt in (5, 6))
    return [x[borders[1:]] - x[borders[:-1]] for x in sums]


def _sign(width: int, num: int, den: int):
    """Arrow batches of (doc_id, text) -> rows (sig, doc). Of equal sets within a task only the first is signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, first = Bands(num, den), {}
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for words in word_chunks(batch.column("text"), BLANKS):
                shingles, sizes = shingle_sets(words, width)
                doc = ids[words.low : words.high].astype(np.int64)
                x, y = prints(shingles, sizes)
                keep = np.zeros(len(sizes), bool)
                for i in np.flatnonzero(sizes):
                    keep[i] = first.setdefault((int(x[i]), int(y[i]), int(sizes[i])), doc[i]) == doc[i]
                sig, row = signatures(shingles[np.repeat(keep, sizes)], np.where(keep, sizes, 0), bands)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(doc[row])], ["sig", "doc"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, doc) -> (pivot, doc, n): the first document of a run of two and more, each other one, and in how many of a batch's runs."""
    sig_before, pivot_before = None, None
    for batch in batches:
        sig, doc = (batch.column(c).to_numpy() for c in ("sig", "doc"))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        starts = np.flatnonzero(new)
        pivot = np.repeat(doc[starts], np.diff(np.append(starts, len(sig))))
        if sig[0] == sig_before:  # the run of the batch before goes on
            pivot[: starts[1] if len(starts) > 1 else len(sig)] = pivot_before
        sig_before, pivot_before = sig[-1], pivot[-1]
        other = pivot != doc
        pivot, doc = pivot[other], doc[other]
        order = np.lexsort((doc, pivot))
        pivot, doc = pivot[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pivot[first]), pa.array(doc[first]), pa.array(np.diff(np.append(first, len(doc))))], ["pivot", "doc", "n"])


def _compare(width: int, num: int, den: int):
    """Arrow batches of (a, b, text_a, text_b) -> the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("text_a", "text_b"):
                sets = []
                for words in word_chunks(batch.column(side), BLANKS):
                    shingles, sizes = shingle_sets(words, width)
                    sets += np.split(shingles, np.cumsum(sizes)[:-1])
                sides.append(sets)
            ok = np.zeros(len(sides[0]), bool)
            for i, (x, y) in enumerate(zip(*sides)):
                if len(x) and len(y) and min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                    common = len(x) + len(y) - _union(x, y)
                    ok[i] = den * common >= num * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _union(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return len(both) - int((both[1:] == both[:-1]).sum())


def _asked_for(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs that a bounded filter of ids lets through, those of all ids among them: other texts are not shuffled."""
    slot = f"(xxhash64({{}}) & {(1 << FILTER_BITS) - 1})"
    bits = (
        ids.selectExpr(f"shiftright({slot.format('id')}, 6) AS word", f"shiftleft(1L, cast({slot.format('id')} & 63 AS int)) AS bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )  # at most 2**17 rows
    return (
        docs.withColumn("word", F.expr(f"shiftright({slot.format('doc_id')}, 6)"))
        .join(F.broadcast(bits), "word")
        .where(f"shiftright(bits, cast({slot.format('doc_id')} & 63 AS int)) & 1 = 1")
        .select("doc_id", "text")
    )


def _linked(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    wanted = _asked_for(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    both = pairs.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(width, num, den), "a long, b long").distinct()


def facts(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, x, y, sketch) of every row; x and y tell its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column("text"), BLANKS):
                shingles, sizes = shingle_sets(words, width)
                classes = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + (mix(shingles, 76) % U(SKETCH)).astype(np.int64)
                counts = np.minimum(np.bincount(classes, minlength=len(sizes) * SKETCH), 255).astype(np.uint8)
                sketch = pa.Array.from_buffers(pa.binary(SKETCH), len(sizes), [None, pa.py_buffer(counts)]).cast(pa.binary())
                ids = batch.column("doc_id").slice(words.low, words.high - words.low)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in prints(shingles, sizes)), sketch], ["doc_id", "n_shingles", "x", "y", "sketch"]
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, x long, y long, sketch binary")


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of every row with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column("text"), BLANKS):
                shingles, sizes = shingle_sets(words, width)
                ids = batch.column("doc_id").slice(words.low, words.high - words.low)
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, sets], ["doc", "shingles"])

    return docs.mapInArrow(run, "doc long, shingles array<long>").where("size(shingles) > 0")


def _possible(num: int, den: int):
    """Arrow batches of (a, b, n_a, n_b, s_a, s_b) -> the pairs (a, b) that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("s_a", "s_b"))
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            ok = (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _not_ruled_out(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    of = lambda c: known.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return pinned(both.mapInArrow(_possible(num, den), "a long, b long").distinct())


def common(codes: np.ndarray, owner: np.ndarray, left: int, members: int) -> np.ndarray:
    """How many codes each of the first `left` members has in common with each of the others (with all, if there are no others)."""
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    held = np.diff(np.append(np.flatnonzero(new), len(codes)))
    column = np.cumsum(new) - 1
    below = 0 if left == members else left
    out = np.zeros((left, members - below), np.float32)
    few, many = held[column] < FEW, np.flatnonzero(held >= FEW)
    c, o = column[few & (held[column] > 1)], owner[few & (held[column] > 1)]
    for step in range(1, FEW - 1):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        x, y = np.minimum(o[same], o[same + step]), np.maximum(o[same], o[same + step])
        across = (x < left) & (y >= below)
        np.add.at(out, (x[across], y[across] - below), 1)
    place = np.full(len(held), -1)
    place[many] = np.arange(len(many))
    c, o = place[column[~few]], owner[~few]
    for low in range(0, len(many), COLUMNS):
        now = slice(*np.searchsorted(c, (low, low + COLUMNS)))
        has = np.zeros((members, min(COLUMNS, len(many) - low)), np.float32)
        has[o[now], c[now] - low] = 1
        out += has[:left] @ has[below:].T
    return out


def _spanning(pairs: np.ndarray) -> list[int]:
    """Places of pairs that join the same ends as all of them."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[a] = b
            kept.append(i)
    return kept


def _within(num: int, den: int):
    """Rows sorted by (pivot, i, j, block) with (doc, component, shingles) -> links (a, b) of documents of block i with those of block j, which join all similar ones of different components."""
    key = ["pivot", "i", "j"]

    def links_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        block, doc, component = (table.column(c).to_numpy() for c in ("block", "doc", "component"))
        sets = table.column("shingles").combine_chunks()
        codes, n = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
        left = int((block == block[0]).sum())
        if table.column("i")[0] != table.column("j")[0] and left == len(doc):  # one of the blocks is empty
            return pa.RecordBatch.from_pylist([], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        below = 0 if left == len(doc) else left
        shared = common(codes, np.repeat(np.arange(len(doc)), n), left, len(doc))
        found = []
        for low in range(0, left, SLICE):
            # common * den >= num * union, in whole numbers below 2**53
            some = slice(low, min(low + SLICE, left))
            linked = shared[some].astype(np.float64) * (den + num) >= num * (n[some, None] + n[None, below:])
            linked &= component[some, None] != component[None, below:]
            x, y = np.nonzero(linked)
            found.append(np.stack([x + low, y])[:, y + below > x + low])  # within one block, each pair once
        x, y = np.concatenate(found, axis=1)
        y += below
        at = _spanning(np.stack([component[x], component[y]], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(doc[x[at]]), pa.array(doc[y[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in key]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                now = tuple(int(x[a]) for x in columns)
                if held and now != held_key:
                    yield links_of(held)
                    held = []
                held_key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield links_of(held)

    return run


def _unsettled(stars: DataFrame, joined: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the different components of each star (pivot, doc, compared)."""
    members = stars.select("pivot", "doc", "compared").unionByName(stars.select("pivot", F.col("pivot").alias("doc"), F.lit(0).alias("compared")).distinct())
    placed = members.join(joined.withColumnRenamed("node", "doc"), "doc", "left").join(sizes, "doc").withColumn("component", F.coalesce("component", "doc"))
    placed = pinned(placed)
    per_star = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), F.sum("compared").alias("compared"), F.min("component").alias("x"), F.max("component").alias("y"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / MEMBERS), F.ceil(F.col("n") / SHINGLES)).cast("int")
    # Members that were compared with the pivot alone may still be similar to each other.
    unsettled = per_star.where("x <> y AND (size > 2 OR compared = 0)").select("pivot", blocks.alias("blocks"))
    rows = placed.select("pivot", "doc", "component").join(unsettled, "pivot").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = pinned(rows.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "component"))
    sets = _shingled(_asked_for(rows.select(F.col("doc").alias("id")).distinct(), docs), width)
    dealt = rows.join(sets, "doc").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "block")
    return dealt.mapInArrow(_within(num, den), "a long, b long").distinct()


def links(documents: DataFrame, width: int = 5, similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """(a, b): links that join the same documents as all pairs of sufficient similarity do, exact copies included."""
    num, den = _scale(similarity)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    known = (pinned(facts(docs, width)) if known is None else known).where("doc_id is not null")
    filled = known.where("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "x", "y")
    firsts = filled.groupBy("x", "y", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    first = pinned(filled.join(firsts, ["x", "y", "n"], "left").select(F.col("doc_id").alias("doc"), F.coalesce("first", "doc_id").alias("first"), "n").distinct())

    signed = docs.mapInArrow(_sign(width, num, den), "sig long, doc long").repartition("sig").sortWithinPartitions("sig", "doc")
    met = signed.mapInArrow(_stars, "pivot long, doc long, n long").groupBy("pivot", "doc").agg(F.sum("n").alias("n"))
    met = pinned(met)
    of = lambda c: first.select(F.col("doc").alias(c), F.col("first").alias(f"{c}_first"))
    met = met.join(of("pivot"), "pivot").join(of("doc"), "doc").where("pivot_first <> doc_first")
    stars = pinned(met.groupBy(F.col("pivot_first").alias("pivot"), F.col("doc_first").alias("doc")).agg(F.sum("n").alias("n")))
    best = stars.groupBy("doc").agg(F.max_by("pivot", F.struct("n", (-F.col("pivot")).alias("least"))).alias("pivot"))

    found = _linked(_not_ruled_out(best.select(F.col("pivot").alias("a"), F.col("doc").alias("b")), known, num, den), docs, width, num, den)
    found = pinned(first.where("first <> doc").select(F.col("first").alias("a"), F.col("doc").alias("b")).unionByName(found))
    compared = stars.select("pivot", "doc").join(best.withColumn("compared", F.lit(1)), ["pivot", "doc"], "left").fillna(0, ["compared"])
    more = _unsettled(compared, components(found), first.where("first = doc").select("doc", "n"), docs, width, num, den)
    return found.unionByName(more)


def jaccard_components(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest doc_id reachable by links, itself included."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = pinned(facts(docs, width))
    joined = components(links(docs, width, similarity, known)).withColumnRenamed("node", "doc_id")
    return known.join(joined, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
