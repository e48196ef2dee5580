"""Language-model scores from a class-factored log-bilinear model trained by noise contrast.

Corpus counts come first: the tokens of all training texts are counted, summed within each
batch before the shuffle. The most frequent words are units of their own; every other word
belongs to the unit of its ending. Units are put into classes by the company they keep
(counts of which frequent word stands before them, over all training texts). A log-bilinear
model predicts the next token's class from the vectors of the tokens before it, through one
matrix per distance; it is trained in numpy by noise-contrastive estimation on every token of
every training text in each round. The objective's expectation over the noise is a sum over all
classes, so nothing is drawn. Texts are dealt into SHARDS by a hash of the row and kept as their
units, two bytes a token; a step sums the gradients of one shard, in whatever tasks its texts lie,
and the parameters take it by Adam: the model is the same, but for the rounding of sums, however
the texts are partitioned, and takes SHARDS * ROUNDS steps at every size of the corpus. Scores are normalised: a softmax over all classes by one matrix product per batch,
times the unit's share in its class, times the word's in its unit, where an unseen word has
the place of one more word of its unit.

What goes to all executors is bounded (UNITS units); counts of the other words stay
distributed and are met by one equi-join per (word, document), partial sums first.

Defined results: a null or empty text has the end token alone; a training set without
texts gives every token the same share; rows that repeat a doc_id are scored one by one as
long as they differ, and equal rows alike; a null doc_id is scored and never trained on;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import discard, pinned, written
from ._words import BLANKS, U, Words, mix, word_chunks

#: Frequent words that are units of their own, and units by ending for all others.
FREQUENT, ENDINGS = 4096, 512
UNITS = FREQUENT + ENDINGS + 1  # and the end token's
END_UNIT = UNITS - 1
CLASSES, SIZE, CONTEXT = 160, 16, 3
#: Words whose counts go to all executors, the most frequent ones, at most; the others' are joined.
KNOWN = 1 << 16
#: Steps of the histogram of counts in which a count doubles; bits by which a known word is found.
STEPS, SLOT = 16, 20
#: Words before a token by which units are put into classes.
COMPANY = 96
#: Noise tokens to one of the text; Adam's rate, which falls to a tenth, and its memory; tokens of a matrix product.
NOISE, RATE, MEMORY, BATCH = 24, 0.2, (0.9, 0.95), 2048
ROUNDS, SHARDS = 1, 32
END = U(0x9E0D)


def _tokens(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    for words in word_chunks(column, BLANKS, beginnings=(-3,)):
        yield words, (mix(words.beginnings[0], 7) % U(ENDINGS)).astype(np.int64) + FREQUENT


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, unit, n), summed within a chunk of texts."""
    for batch in batches:
        for words, ending in _tokens(batch.column("text")):
            word, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending[first].astype(np.int32)), pa.array(n)], ["word", "unit", "n"])


class Vocabulary:
    """Known words, sorted by fingerprint, with their counts and units; units' counts and numbers of words."""

    def __init__(self, counts: DataFrame, n_rows: int):
        total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(total["n"] or 0) + n_rows, int(total["v"]) + (1 if n_rows else 0)
        # The least count that at most KNOWN words reach, from a histogram of bounded size: no task sends more than its share of those.
        held = counts.groupBy(F.floor(F.log2("n") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).toPandas()
        fits = held["step"][held["words"].cumsum() <= KNOWN]
        top = counts.where(F.floor(F.log2("n") * STEPS) >= int(fits.min())) if len(fits) else counts.limit(0)
        top = top.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
        word = top["word"].to_numpy(np.int64).view(np.uint64)
        unit = np.where(np.arange(len(top)) < FREQUENT, np.arange(len(top)), top["unit"].to_numpy(np.int64))
        order = np.argsort(word)
        self.words, self.unit_of, self.count = word[order], unit[order], top["n"].to_numpy(np.int64)[order]
        # Where each word is by its first SLOT bits; words that share those with another are looked up by bisection.
        slot = self.words >> U(64 - SLOT)
        self.slots = np.full(1 << SLOT, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[1:][slot[1:] == slot[:-1]]] = -2
        # Sums of the words that are left to the units by ending.
        rest = counts.groupBy("unit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
        self.unit_n, self.unit_v = np.zeros(UNITS), np.zeros(UNITS)
        self.unit_n[rest["unit"]], self.unit_v[rest["unit"]] = rest["n"], rest["v"]
        own = top[:FREQUENT]
        np.subtract.at(self.unit_n, own["unit"].to_numpy(), own["n"].to_numpy(float))
        np.subtract.at(self.unit_v, own["unit"].to_numpy(), 1.0)
        self.unit_n[: len(own)], self.unit_v[: len(own)] = own["n"], 1
        self.unit_n[END_UNIT], self.unit_v[END_UNIT] = n_rows, 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is among the known ones, and its place there."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = self.slots[hashes >> U(64 - SLOT)]
        shared = np.flatnonzero(at == -2)
        if len(shared):
            at[shared] = np.minimum(np.searchsorted(self.words, hashes[shared]), len(self.words) - 1)
        known = at >= 0
        known[known] = self.words[at[known]] == hashes[known]
        return known, np.where(known, at, 0)

    def units(self, words: Words, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of all tokens, each row's end included; their counts, -1 where those must be joined; each row's number of tokens."""
        known, at = self.find(words.hashes)
        unit = np.where(known, self.unit_of[at], ending) if len(self.words) else ending
        count = np.where(known, self.count[at], -1) if len(self.words) else np.full(len(ending), -1)
        ends = np.cumsum(words.counts)
        return np.insert(unit, ends, END_UNIT), np.insert(count, ends, int(self.unit_n[END_UNIT])), words.counts + 1

    def base(self, count) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))


def _before(units: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token; before a row's first, the end token."""
    place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.concatenate([np.full(CONTEXT, END_UNIT), units])
    return np.stack([np.where(place > j, padded[CONTEXT - 1 - j : len(padded) - 1 - j], END_UNIT) for j in range(CONTEXT)], axis=1)


def _encoding(shared):
    """(shard, text) -> (shard, units): the units of a chunk's texts of one shard, two bytes each, every text's end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for words, ending in _tokens(batch.column("text")):
                units, _, counts = vocabulary.units(words, ending)
                of = np.repeat(shard[words.low : words.high], counts)
                order = np.argsort(of, kind="stable")
                borders = np.searchsorted(of[order], np.arange(SHARDS + 1))
                dealt = units[order].astype(np.uint16)
                held = np.flatnonzero(np.diff(borders))
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([dealt[borders[k] : borders[k + 1]].tobytes() for k in held], pa.binary())], ["shard", "units"])

    return run


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, those before each) of every row."""
    for batch in batches:
        for raw in batch.column("units"):
            units = np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64)
            yield units, _before(units, np.diff(np.flatnonzero(units == END_UNIT), prepend=-1))


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(units) -> (unit, before, n): how often a unit stands after a frequent word."""
    table = np.zeros((UNITS, COMPANY), np.int64)
    for units, before in _decoded(batches):
        for j in range(CONTEXT):
            near = before[:, j] < COMPANY
            table += np.bincount(units[near] * COMPANY + before[near, j], minlength=UNITS * COMPANY).reshape(UNITS, COMPANY)
    unit, near = np.nonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(table[unit, near])], ["unit", "before", "n"])


def _classes(table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A class for each unit: k-means of the units' company, the most frequent units first as centres."""
    share = (table + 0.1) / (table + 0.1).sum(1, keepdims=True)
    x = np.sqrt(share)
    seeds = np.argsort(-weight, kind="stable")
    centre = x[seeds[np.linspace(0, min(len(seeds) - 1, 4 * CLASSES), CLASSES).astype(int)]].copy()
    w = weight + 1.0
    for _ in range(12):
        of = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(1), axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, x * w[:, None])
        mass = np.bincount(of, w, minlength=CLASSES)
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centre)
    of[END_UNIT] = CLASSES - 1  # the end is a class of its own
    of[(of == CLASSES - 1) & (np.arange(UNITS) != END_UNIT)] = CLASSES - 2
    return of


def _summed(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (units or classes), each once, and the sums of their rows of x."""
    keys = keys.astype(np.int16)
    order = np.argsort(keys, kind="stable")  # by radix
    keys = keys[order]
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
    sums = np.cumsum(x[order], axis=0, dtype=np.float64)[last]
    sums[1:] -= sums[:-1].copy()
    return keys[last], sums.astype(np.float32)


class LogBilinear:
    """Vectors of units (context) and classes (target), one diagonal matrix per distance, biases."""

    def __init__(self, class_share: np.ndarray):
        rng = np.random.default_rng(7)
        self.unit = (rng.standard_normal((UNITS, SIZE)) * 0.1).astype(np.float32)
        self.at = np.ones((CONTEXT, SIZE), np.float32) / np.arange(1, CONTEXT + 1, dtype=np.float32)[:, None]
        self.target = (rng.standard_normal((CLASSES, SIZE)) * 0.1).astype(np.float32)
        self.bias = np.log(class_share + 1e-9).astype(np.float32)
        self.share = class_share

    def rows(self) -> np.ndarray:
        return _rows_of(self.unit, self.at, self.target, self.bias)

    def take(self, rows: np.ndarray) -> None:
        a, b, c = UNITS, UNITS + CONTEXT, UNITS + CONTEXT + CLASSES
        self.unit, self.at, self.target = (rows[x:y].astype(np.float32) for x, y in ((0, a), (a, b), (b, c)))
        self.bias = rows[c:].reshape(-1)[:CLASSES].astype(np.float32)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.unit[before[:, j]] * self.at[j] for j in range(CONTEXT))

    def log_softmax(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each target class: one product with all classes' vectors."""
        z = self.predicted(before) @ self.target.T + self.bias
        top = z.max(1)
        own = z[np.arange(len(z)), target]
        np.exp(z - top[:, None], out=z)
        return own - top - np.log(z.sum(1))

    def gradient(self, before: np.ndarray, target: np.ndarray, into: list[np.ndarray]) -> None:
        """Adds the tokens' gradients of the noise-contrastive objective to those of (unit, at, target, bias); the noise counts by its expectation."""
        x = self.unit[before]
        q = sum(x[:, j] * self.at[j] for j in range(CONTEXT))
        noise = (NOISE * self.share).astype(np.float32)
        # e to the power of minus each class's score beside the noise: what tells a token from noise is 1 / (1 + e).
        with np.errstate(over="ignore"):
            e = q @ -self.target.T
            e += np.log(noise + 1e-12) - self.bias
            np.exp(e, out=e)
            own = e[np.arange(len(e)), target]
            own = 1 - 1 / (1 + own)
            e += 1
            g = np.divide(-noise, e, out=e)
        g[np.arange(len(g)), target] += own
        g_q = g @ self.target
        into[2] += g.T @ q
        into[3] += g.sum(0)
        for j in range(CONTEXT):
            into[1][j] += np.einsum("ij,ij->j", g_q, x[:, j])
            key, sums = _summed(before[:, j], g_q * self.at[j])
            into[0][key] += sums


def _rows_of(unit: np.ndarray, at: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """All parameters (or their gradients), one row per vector."""
    return np.concatenate([unit, at, target, np.resize(np.append(bias, np.zeros(-len(bias) % SIZE, bias.dtype)), (-(-CLASSES // SIZE), SIZE))])


def _gradients(shared):
    """(units) -> (row, v0, ..., tokens): the gradient of this task's tokens, a row per vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rows, share = shared.value
        model = LogBilinear(share)
        model.take(rows)
        sums, n = [np.zeros(x.shape) for x in (model.unit, model.at, model.target, model.bias)], 0
        for units, before in _decoded(batches):
            for i in range(0, len(units), BATCH):
                model.gradient(before[i : i + BATCH], of[units[i : i + BATCH]], sums)
            n += len(units)
        if n:
            out = _rows_of(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in out.T), pa.array(np.full(len(out), n))], ["row", *(f"v{i}" for i in range(SIZE)), "tokens"])

    return run


def _trained(model: LogBilinear, of: np.ndarray, encoded: DataFrame) -> LogBilinear:
    """ROUNDS times over all shards, a step each."""
    spark, values = encoded.sparkSession, [f"v{i}" for i in range(SIZE)]
    rows = model.rows().astype(np.float64)
    mean, square, step, last = np.zeros_like(rows), np.zeros_like(rows), 0, ROUNDS * SHARDS
    for _ in range(ROUNDS):
        for shard in range(SHARDS):
            model.take(rows)
            now = spark.sparkContext.broadcast((of, model.rows(), model.share))
            each = encoded.where(F.col("shard") == shard).select("units").mapInArrow(_gradients(now), f"row int, {', '.join(f'{v} double' for v in values)}, tokens long")
            summed = each.groupBy("row").agg(*((F.sum(v) / F.sum("tokens")).alias(v) for v in values)).orderBy("row").toPandas()  # a row per vector of the model
            now.destroy()
            step += 1
            if not len(summed):
                continue
            gradient = summed[values].to_numpy()
            mean = MEMORY[0] * mean + (1 - MEMORY[0]) * gradient
            square = MEMORY[1] * square + (1 - MEMORY[1]) * gradient**2
            rate = RATE * (1 - 0.9 * (step - 1) / last)
            rows = rows + rate * (mean / (1 - MEMORY[0] ** step)) / (np.sqrt(square / (1 - MEMORY[1] ** step)) + 1e-9)
    model.take(rows)
    return model


class Scorer:
    """Everything that scores a batch; goes to all executors, its size set by UNITS."""

    def __init__(self, vocabulary: Vocabulary, of: np.ndarray, model: LogBilinear):
        self.vocabulary, self.of, self.model = vocabulary, of, model
        n = vocabulary.unit_n + 0.5 * (vocabulary.unit_v + 1)
        self.unit_total = n  # of a unit's words, and one unseen
        in_class = np.bincount(of, n, minlength=CLASSES)
        self.log_unit = np.log10(n / in_class[of])

    def rows(self, words: Words, ending: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per row: tokens; how many are known, and base score, of the known words and the end; model score without the other words' shares in their units. Then the places of those other words."""
        v = self.vocabulary
        units, count, counts = v.units(words, ending)
        before = _before(units, counts)
        log = np.empty(len(units))
        for i in range(0, len(units), 1 << 13):
            s = slice(i, i + (1 << 13))
            log[s] = self.model.log_softmax(before[s], self.of[units[s]])
        log = log / np.log(10) + self.log_unit[units]
        known = count >= 0
        share = np.log10((np.maximum(count, 0) + 0.5) / self.unit_total[units])
        log += np.where(known, share, 0.0)
        base = np.where(known, v.base(np.maximum(count, 0)), 0.0)
        ends = np.cumsum(counts)
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        other = np.flatnonzero(~np.delete(known, ends - 1))
        return counts, add((count > 0).astype(np.int64)), add(base), add(log), other


def fit(training: DataFrame) -> tuple[Scorer, DataFrame]:
    """(scorer, counts): counts (word, unit, n) of all training tokens but the end, distributed."""
    spark = training.sparkSession
    texts = training.select("text")
    counts = pinned(texts.mapInArrow(_counting, "word long, unit int, n long").groupBy("word").agg(F.min("unit").alias("unit"), F.sum("n").alias("n")))
    vocabulary = Vocabulary(counts, texts.count())
    shared = spark.sparkContext.broadcast(vocabulary)
    dealt = training.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).alias("shard"), "text")
    encoded = written(dealt.mapInArrow(_encoding(shared), "shard int, units binary"), "shard")
    company = encoded.select("units").mapInArrow(_company, "unit int, before int, n long").groupBy("unit", "before").agg(F.sum("n").alias("n")).toPandas()  # at most UNITS * COMPANY rows
    table = np.zeros((UNITS, COMPANY))
    table[company["unit"], company["before"]] = company["n"]
    of = _classes(table, vocabulary.unit_n)
    share = np.bincount(of, vocabulary.unit_n + 0.5, minlength=CLASSES)
    model = _trained(LogBilinear(share / share.sum()), of, encoded)
    discard(encoded)
    return Scorer(vocabulary, of, model), counts


def scored(documents: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of documents."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(scorer)
    docs = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of words whose counts must be joined, and HEAD rows: unit -1 has a row's tokens and base score, -2 its known tokens and score, of all but those words."""
        scorer = shared.value
        for batch in batches:
            for words, ending in _tokens(batch.column("text")):
                n, known, base, log, other = scorer.rows(words, ending)
                keys = _row_key(words).to_numpy()
                row, word, unit = np.repeat(np.arange(len(n)), words.counts)[other], words.hashes[other], ending[other]
                _, first, tf = np.unique(mix(word, 3) + mix(row.astype(U), 4), return_index=True, return_counts=True)
                # A head's word is its row's own, so that heads are dealt evenly; it is no word's fingerprint, but for chance.
                every = np.arange(len(n))
                rows = np.concatenate([every, every, row[first]])
                ids = batch.column("doc_id").slice(words.low, len(n)).take(pa.array(rows))
                out = [
                    keys[rows], np.concatenate([mix(keys.view(U), 11), mix(keys.view(U), 12), word[first]]).view(np.int64),
                    np.concatenate([np.full(len(n), -1), np.full(len(n), -2), unit[first]]).astype(np.int32), np.concatenate([n, known, tf]), np.concatenate([base, log, np.zeros(len(first))]),
                ]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], ["doc_id", "row", "word", "unit", "tf", "sum"])

    v = scorer.vocabulary
    units = F.array(*(F.lit(float(x)) for x in scorer.unit_total[FREQUENT : FREQUENT + ENDINGS]))
    c, tf = F.coalesce(F.col("n"), F.lit(0)), F.col("tf")
    head = lambda unit, x: F.sum(F.when(F.col("unit") == unit, F.col(x)))
    tail = lambda x: F.coalesce(F.sum(F.when(F.col("unit") >= 0, x)), F.lit(0))
    parts = docs.mapInArrow(run, "doc_id long, row long, word long, unit int, tf long, sum double").join(counts.select("word", "n"), "word", "left")
    # Equal rows of one doc_id are summed together: each gets its part.
    out = parts.groupBy("doc_id", "row").agg(
        F.count(F.when(F.col("unit") == -1, 1)).alias("copies"),
        head(-1, "tf").alias("n_tokens"),
        (head(-2, "tf") + tail(F.when(c > 0, tf).otherwise(0))).alias("n_known"),
        (head(-1, "sum") + tail(tf * F.log10((c + 0.5) / F.lit(v.n + 0.5 * (v.v + 1))))).alias("base"),
        (head(-2, "sum") + tail(tf * F.log10((c + 0.5) / F.get(units, F.greatest(F.col("unit") - FREQUENT, F.lit(0)))))).alias("log"),
    )
    each = lambda x: F.col(x) / F.col("copies")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id", each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        each("base").alias("base_score"), each("log").alias("score"),
    )


def _row_key(words: Words) -> pa.Array:
    """A fingerprint of each row's words: tells rows of one doc_id apart."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(words.hashes, 9))])
    ends = np.cumsum(words.counts)
    return pa.array((sums[ends] - sums[ends - words.counts]).view(np.int64))
