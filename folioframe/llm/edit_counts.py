"""Token counts that follow edits.

A document is a row of leaves of about LEAF words, cut where the tokenizer's pattern always
ends a match: at a blank between two characters that are no space. A segment tree over the
leaves holds sums of characters and tokens. An edit descends to the leaves that it touches,
replaces their text, and re-encodes only them; where it disturbs a border (the blank or the
characters beside it) the neighbour leaf joins in. Sums are updated from the leaf upwards,
so an edit costs its leaf and a logarithm, not the document. A leaf that has grown to more
than SPLIT words is cut into leaves of LEAF words again.

A tree is kept beside its text as the leaves' numbers of characters and tokens (`planted`):
about a twelfth of the text. `recounted` reads that, encodes nothing but what edits touch, and
returns the tree as the edits have left it, for the next batch of edits.

Defined results: a null text is an empty one; edits that are null or lie outside the text
are cut to it; edits are applied in their order, each to the text that those before it
left; no edits leave the count as it is; a null tree is made from the text; a text without a
blank between words is one leaf; rows that repeat a doc_id are documents of their own, each
with all of that id's edits; an empty table gives no rows; other columns pass through, but
for those of a name that a function adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .byte_bpe import ROWS, Vocabulary, vocabulary

LEAF, SPLIT = 16, 64
TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDITS = "array<struct<start:int,length:int,replacement:string>>"


def layout(text: str, vocabulary: Vocabulary) -> tuple[list[int], list[int]]:
    """Characters and tokens of each leaf of the text."""
    words, ids = vocabulary.by_word(text)
    chars, tokens = [len(x) + 1 for x in words], [len(x) // 4 for x in ids]
    chars[0] -= 1  # the first word has no blank before it
    places = range(0, len(words), LEAF)
    return [sum(chars[i : i + LEAF]) for i in places], [sum(tokens[i : i + LEAF]) for i in places]


class TokenTree:
    """Leaves of one document and the sums above them; kept: their characters and tokens, where they are known."""

    def __init__(self, text: str, vocabulary: Vocabulary, kept: tuple[list[int], list[int]] | None = None):
        self.vocabulary, self.reencoded = vocabulary, 0
        chars, tokens = kept or layout(text, vocabulary)
        ends = list(accumulate(chars))
        self._grow([text[a:b] for a, b in zip([0, *ends], ends)], chars, tokens)

    def _grow(self, leaves: list[str], chars: list[int], tokens: list[int]) -> None:
        """The tree over these leaves."""
        self.leaves, self.size = leaves, 1 << (len(leaves) - 1).bit_length()
        none = [0] * (self.size - len(leaves))
        self.chars, self.tokens = _sums(chars + none), _sums(tokens + none)

    @property
    def kept(self) -> dict[str, list[int]]:
        """Characters and tokens of each leaf that is left."""
        places = [self.size + i for i, x in enumerate(self.leaves) if x] or [self.size]
        return {"chars": [self.chars[i] for i in places], "tokens": [self.tokens[i] for i in places]}

    def _count(self, leaf: str) -> int:
        return len(self.vocabulary.encode(leaf)) // 4

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one's end is its own), and the place in it."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.size, at

    def _set(self, i: int, text: str) -> None:
        node = self.size + i
        self.leaves[i], self.chars[node], self.tokens[node] = text, len(text), self._count(text)
        self.reencoded += len(text)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _beside(self, i: int, step: int) -> int | None:
        """The next leaf in a direction that holds text."""
        i += step
        while 0 <= i < len(self.leaves):
            if self.leaves[i]:
                return i
            i += step
        return None

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(start, 0), self.n_chars)
        end = min(start + max(length, 0), self.n_chars)
        first, at = self._find(start)
        last, _ = self._find(max(start, end - 1))
        old = "".join(self.leaves[first : last + 1])
        text = old[:at] + replacement + old[at + end - start :]
        touched = [first, *range(first + 1, last + 1)]
        # A border holds while a blank follows a character that is no space and precedes one.
        while (before := self._beside(first, -1)) is not None and not (len(text) > 1 and text[0] == " " and not text[1].isspace()):
            text, first = self.leaves[before] + text, before
            touched.append(before)
        while (after := self._beside(last, 1)) is not None and not (text and not text[-1].isspace()):
            text, last = text + self.leaves[after], after
            touched.append(after)
        for i in touched:
            if i != first and self.leaves[i]:
                self._set(i, "")
        self._set(first, text)
        if text.count(" ") > SPLIT:
            chars, tokens = layout(text, self.vocabulary)
            if len(chars) > 1:
                ends = list(accumulate(chars))
                cut = [text[a:b] for a, b in zip([0, *ends], ends)]
                old = slice(self.size, self.size + len(self.leaves))
                mended = (x[:first] + new + x[first + 1 :] for x, new in ((self.leaves, cut), (self.chars[old], chars), (self.tokens[old], tokens)))
                self._grow(*mended)


def _sums(values: list[int]) -> list[int]:
    """A heap of sums: node i over nodes 2 * i and 2 * i + 1; the values are its leaves."""
    levels = [values]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([a + b for a, b in zip(below[::2], below[1::2])])
    return [0, *(x for level in reversed(levels) for x in level)]


def gathered(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """documents with a column edits, from rows (doc_id, seq, start, length, replacement) in the order of seq."""
    each = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("__edits"))
    of = F.transform("__edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"), e["replacement"].alias("replacement")))
    return documents.drop("edits").join(each, "doc_id", "left").withColumn("edits", of).drop("__edits")


def _with(documents: DataFrame, extra: dict[str, T.DataType], source: list[str], make) -> DataFrame:
    """documents with the extra columns, whose values make() gives from those of source, row by row."""
    kept = [c for c in documents.columns if c not in extra]
    schema = T.StructType([*(documents.schema[c] for c in kept), *(T.StructField(k, t) for k, t in extra.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, types = make(), [to_arrow_type(t) for t in extra.values()]
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                rows = [f(*x) for x in zip(*(part.column(c).to_pylist() for c in source))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [*kept, *extra])

    return documents.mapInArrow(run, schema)


def planted(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents (with text) and their n_tokens and tree, to be written down."""

    def make():
        tokens = vocabulary(path, pattern)

        def row(text):
            chars, counts = layout(text or "", tokens)
            return sum(counts), {"chars": chars, "tokens": counts}

        return row

    return _with(documents, {"n_tokens": T.LongType(), "tree": TREE}, ["text"], make)


def recounted(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents (with text and edits, and tree if there is one) and their n_tokens before, n_tokens_after, n_chars_after, reencoded_chars, text_after, tree_after."""
    extra = {"n_tokens": T.LongType(), "n_tokens_after": T.LongType(), "n_chars_after": T.LongType(), "reencoded_chars": T.LongType(), "text_after": T.StringType(), "tree_after": TREE}

    def make():
        tokens = vocabulary(path, pattern)

        def row(text, edits, kept=None):
            tree = TokenTree(text or "", tokens, kept and (kept["chars"], kept["tokens"]))
            before = tree.n_tokens
            for e in edits or ():
                if e is not None and e["start"] is not None:
                    tree.edit(e["start"], e["length"] or 0, e["replacement"] or "")
            return before, tree.n_tokens, tree.n_chars, tree.reencoded, "".join(tree.leaves), tree.kept

        return row

    return _with(documents, extra, ["text", "edits", *(["tree"] if "tree" in documents.columns else [])], make)
