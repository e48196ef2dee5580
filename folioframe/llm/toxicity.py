"""Toxicity scores from two class-conditional Kneser-Ney models.

One model is learned from texts labelled toxic, one from ordinary ones. Bigrams are
discounted and back off to the bigrams of both classes together, and those to words by
continuation counts (of how many words a word is seen after). Words back off to their
beginnings, longest first: at each step a class's counts are discounted, and the mass that
this frees is dealt out by the counts of both classes together. So a rare expression is judged by the longest part of it that has been seen, and
where only shared counts are left, the classes agree.

A document's evidence is the difference of the two log-likelihoods, normalised by length,
and the part of it that single clear expressions make, of common expressions and of rare ones
apart; a logistic curve, fitted on labelled texts that the counts have not seen and weighted to the labels'
own class shares, turns it into a score.

The classifier is fitted on at most `per_class` labelled rows of each class (a documented
bound: those with the smallest hash of doc_id); every document is scored, in one pass
without a shuffle. Labels, language, source and doc_id are not inputs of a score.

Defined results: a null or wordless text has no evidence, so the curve's value at none;
labels that are null, or of no document, are not learned from; a doc_id with several
labels counts as toxic if one of them is; without training rows of both classes every score
is the share of toxic labels, or 0; rows that repeat a doc_id are scored one by one; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import pinned
from ._words import PUNCTUATION, U, mix, word_chunks

PER_CLASS = 6000
#: Lengths in bytes of the beginnings that words back off to.
BEGINNINGS = (4, 5, 7, 9)
#: Keeps the curve's weights finite where the classes part cleanly.
RIDGE = 1.0
#: Languages and topics shift all words of a text a little; an expression tells by itself from here on.
CLEAR = 1.5
START = U(0x5354415254)
#: What a text with a word holds.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Counts from which on an expression is common; what rarer ones say is evidence of its own, with a weight of its own.
COMMON = 4
#: Parts of the contexts, which are worked on one by one.
PARTS = 8
EVIDENCE = [f"e{i}" for i in range(7)]
LEVELS = [f"b{n}" for n in BEGINNINGS] + ["right"]


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left, 31) + right


def _lefts(words) -> np.ndarray:
    """The word before each word; START at a row's first."""
    left = np.concatenate([[START], words.hashes[:-1]]) if len(words.hashes) else words.hashes
    first = (np.cumsum(words.counts) - words.counts)[words.counts > 0]
    left[first] = START
    return left


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (toxic, left, right, beginnings, n), summed within a chunk of texts."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for words in word_chunks(batch.column("text"), PUNCTUATION, beginnings=BEGINNINGS):
            of = np.repeat(toxic[words.low : words.high], words.counts)
            left = _lefts(words)
            for label in (0, 1):
                mine = np.flatnonzero(of == label)
                _, first, n = np.unique(_pair(left[mine], words.hashes[mine]), return_index=True, return_counts=True)
                at = mine[first]
                columns = [left, words.hashes, *(mix(x, 40 + i) for i, x in enumerate(words.beginnings))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), label, np.int32)), *(pa.array(x[at].view(np.int64)) for x in columns), pa.array(n.astype(np.int64))],
                    ["toxic", "left", "right", *LEVELS[:-1], "n"],
                )


class Table:
    """Keys with a value each, and which of them are common; seven bytes a key.

    Keys lie in buckets of their first 16 bits and are told apart by the 32 bits after those.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, common: np.ndarray):
        order = np.argsort(keys)
        self.values, self.common = values[order].astype(np.float16), common[order]
        keys = keys[order] >> U(16)
        self.starts = np.searchsorted(keys, np.arange((1 << 16) + 1, dtype=np.uint64) << U(32)).astype(np.int32)
        self.rest = keys.astype(np.uint32)
        self.steps = int(np.diff(self.starts).max()).bit_length()

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the keys are found, their values (0 elsewhere), and where they are common."""
        if not len(self.rest):
            return np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(len(keys), bool)
        bucket, want, last = (keys >> U(48)).astype(np.int32), (keys >> U(16)).astype(np.uint32), len(self.rest) - 1
        low, high = self.starts[bucket], self.starts[bucket + 1]
        end = high
        for _ in range(self.steps):  # a bisection of each key's bucket
            at = (low + high) >> 1
            above = (at < high) & (self.rest[np.minimum(at, last)] < want)
            low, high = np.where(above, at + 1, low), np.where(above, high, at)
        at = np.minimum(low, last)
        found = (low < end) & (self.rest[at] == want)
        return found, np.where(found, self.values[at], 0.0), found & self.common[at]


def _discounts(of_one: float, of_two: float, of_three: float, of_four: float) -> np.ndarray:
    """What counts of 0, 1, 2 and more are discounted by, from the numbers of counts of one to four (modified Kneser-Ney)."""
    n = (of_one, of_two, of_three, of_four)
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1), k - 0.01) for k in (1, 2, 3))])


def _discounted(counts: np.ndarray, parent: np.ndarray, parents: int, discounts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each one's share of its parent's counts after the discount; each parent's mass that this frees (all of it, where it has none)."""
    if discounts is None:
        discounts = _discounts(*(int((counts == k).sum()) for k in range(1, 5)))
    d = discounts[np.minimum(counts, 3).astype(int)]
    total = np.bincount(parent, counts, minlength=parents)
    freed = np.where(total > 0, np.bincount(parent, d, minlength=parents) / np.maximum(total, 1), 1.0)
    return (counts - d) / np.maximum(total, 1)[parent], freed


class Tables:
    """Tables of log(toxic likelihood / ordinary likelihood): of bigrams, of contexts' backoff, of words and beginnings.

    All that the sample holds is counted, however rare. Within each class the probabilities of
    a parent's children, and those of the words after a context, sum to one.
    """

    def __init__(self, pairs: DataFrame):
        seen = lambda c: F.count(F.when(F.col("toxic") == c, 1)).cast("int").alias(f"c{c}")
        words = pairs.groupBy(*LEVELS).agg(seen(0), seen(1)).toArrow()
        kinds = [words.column(f"c{c}").to_numpy() for c in (0, 1)]  # words before it, of either class
        self.nodes, parent = [], np.zeros(words.num_rows, np.int64)
        above, log = [np.array([x.sum()]) for x in kinds], [np.zeros(1), np.zeros(1)]
        for level in LEVELS:
            keys, first, node = np.unique(words.column(level).to_numpy().view(np.uint64), return_index=True, return_inverse=True)
            own = [np.bincount(node, x) for x in kinds]
            up = parent[first]
            share = (own[0] + own[1]) / (above[0] + above[1])[up]
            for c in (0, 1):
                seen, freed = _discounted(own[c], up, len(above[c]))
                log[c] = log[c][up] + np.log(seen + freed[up] * share)
            self.nodes.append(Table(keys, log[1] - log[0], own[0] + own[1] >= COMMON))
            parent, above = node, own
        self._bigrams(pairs, keys, log)

    def _bigrams(self, pairs: DataFrame, words: np.ndarray, word_log: list[np.ndarray]) -> None:
        """Part by part of the contexts: what is held at a time is a part's bigrams, and of the parts before it their values."""
        both = pairs.groupBy("left", "right").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).cast("int").alias(f"n{c}") for c in (0, 1)))
        both = pinned(both.withColumn("part", F.pmod(F.xxhash64("left"), F.lit(PARTS)).cast("int")))
        sizes = both.agg(*(F.count_if(F.expr(f"{x} = {k}")) for x in ("n0", "n1", "n0 + n1") for k in range(1, 5))).first()
        discounts = [_discounts(*sizes[i : i + 4]) for i in (0, 4, 8)]
        found: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        for part in range(PARTS):
            table = both.where(F.col("part") == part).select("left", "right", "n0", "n1").toArrow()
            before, after = (table.column(c).to_numpy().view(np.uint64) for c in ("left", "right"))
            own = [table.column(c).to_numpy() for c in ("n0", "n1")]
            contexts, context = np.unique(before, return_inverse=True)
            word, n = np.searchsorted(words, after), own[0] + own[1]
            shared, rest = _discounted(n, context, len(contexts), discounts[2])
            log, back = [], []
            for c in (0, 1):
                seen, freed = _discounted(own[c], context, len(contexts), discounts[c])
                log.append(np.log(seen + freed[context] * (shared + rest[context] * np.exp(word_log[c][word]))))
                back.append(np.log(freed))
            pair = _pair(before, after), (log[1] - log[0]).astype(np.float16), n >= COMMON
            found.append((pair, (contexts, (back[1] - back[0]).astype(np.float16), np.bincount(context, n) >= COMMON)))
        self.pairs, self.backs = (Table(*(np.concatenate(x) for x in zip(*(f[i] for f in found)))) for i in (0, 1))

    def evidence(self, words) -> np.ndarray:
        """Per row, of the longest common expressions: log-likelihood as toxic - as ordinary, per word and per root of words; what expressions
        that are CLEAR by themselves add to it, in all (as a logarithm) and per root of words. Log of 1 + words. What
        the longest expressions add that have been seen at all, per root of words, and the clear ones of them (as a logarithm)."""
        left, right = _lefts(words), words.hashes
        levels = [*(mix(x, 40 + i) for i, x in enumerate(words.beginnings)), right]
        met, value, often = self.pairs.look(_pair(left, right))
        usual, open_, rare = np.where(often, value, 0.0), ~met, ~often
        for table, keys in zip(reversed(self.nodes), reversed(levels)):
            at = np.flatnonzero(rare)
            hit, node, common = table.look(keys[at])
            value[at[hit & open_[at]]] = node[hit & open_[at]]
            usual[at[common]] = node[common]
            open_[at[hit]], rare[at[common]] = False, False
        _, back, common = self.backs.look(left)
        ends = np.cumsum(words.counts)

        def summed(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(x)])
            return sums[ends] - sums[ends - words.counts]

        n = np.maximum(words.counts, 1)
        whole, clear = summed(usual + np.where(often | ~common, 0.0, back)), summed(np.maximum(usual - CLEAR, 0.0))
        more, clearer = summed(value + np.where(met, 0.0, back)) - whole, summed(np.maximum(value - CLEAR, 0.0))
        return np.stack([10 * whole / n, whole / np.sqrt(n), np.log1p(clear), clear / np.sqrt(n), np.log1p(words.counts), more / np.sqrt(n), np.log1p(clearer)], axis=1)


class Model:
    """The tables, sent to all executors once, and the curve over their evidence."""

    def __init__(self, pairs: DataFrame):
        self.shared, self.curve = pairs.sparkSession.sparkContext.broadcast(Tables(pairs)), None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression with a ridge, by Newton steps that are halved until the loss falls."""
        self.center, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.center) / self.scale]
        ridge = np.full(z.shape[1], RIDGE)
        ridge[0] = 1e-6
        b = np.zeros(z.shape[1])
        loss = lambda b: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b))).sum() + 0.5 * (ridge * b * b).sum()
        now = loss(b)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * b)
            while (then := loss(b + step)) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            if then >= now - 1e-9:
                break
            b, now = b + step, then
        self.curve = b

    def scores(self):
        """evidence -> scores."""
        center, scale, curve = self.center, self.scale, self.curve

        def score(x: np.ndarray) -> np.ndarray:
            z = np.c_[np.ones(len(x)), (x - center) / scale]
            return 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))

        return score


def _evidence_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for words in word_chunks(batch.column("text"), PUNCTUATION, beginnings=BEGINNINGS):
                e = tables.evidence(words)
                rest = batch.slice(words.low, words.high - words.low)
                yield pa.RecordBatch.from_arrays([rest.column("toxic"), *(pa.array(x) for x in np.ascontiguousarray(e.T))], ["toxic", *EVIDENCE])

    return run


def fit(documents: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = PER_CLASS) -> Model | float:
    """The model, or the share of toxic labels where a class is missing. train: a condition on doc_id."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(train) if train is not None else known
    known = pinned(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    first = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most 2 * per_class rows
    texts = documents.select("doc_id", "text").join(chosen, "doc_id").where("text IS NOT NULL")
    texts = pinned(texts.select("toxic", "text", (F.crc32(F.concat(F.lit("curve"), F.col("doc_id").cast("string"))) % 4 == 0).alias("curve")))
    counts = texts.where("NOT curve").select("toxic", "text").mapInArrow(_counting, f"toxic int, left long, right long, {' long, '.join(LEVELS[:-1])} long, n long")
    counts = pinned(counts.groupBy("toxic", "left", *LEVELS).agg(F.sum("n").alias("n")))
    seen = {r["toxic"] for r in counts.select("toxic").distinct().collect()}
    if seen != {0, 1}:
        return share.get(1, 0) / total if total else 0.0
    model = Model(counts)
    e = texts.where("curve").select("toxic", "text").mapInArrow(_evidence_of(model.shared), f"toxic int, {' double, '.join(EVIDENCE)} double").toPandas()
    y = e["toxic"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return share.get(1, 0) / total
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum()) * len(y) / total
    model.fit(e[EVIDENCE].to_numpy(), y, weight)
    return model


def scored(documents: DataFrame, model: Model | float) -> DataFrame:
    """documents with a column score (0 to 1)."""
    if isinstance(model, float):
        return documents.withColumn("score", F.lit(model))
    shared, score = model.shared, model.scores()
    kept = [c for c in documents.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for words in word_chunks(batch.column("text"), PUNCTUATION, beginnings=BEGINNINGS):
                rest = batch.slice(words.low, words.high - words.low)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score(tables.evidence(words)))], [*kept, "score"])

    df = documents.select(*kept)
    return df.mapInArrow(run, df.withColumn("score", F.lit(0.0)).schema)
