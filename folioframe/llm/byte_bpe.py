"""Byte-level BPE encoding and decoding by longest matches with backtracking.

The tokens, as Latin-1 strings, form an Aho-Corasick automaton, so one pass over a piece
finds every token at every position. From left to right the longest token is taken; where
it is not compatible with its left neighbour the next shorter one is tried, and where none
is left the last token is taken back and its end marked as dead. Two adjacent tokens are
compatible when merging their joined bytes gives these two tokens back. As compatible
neighbours throughout make the one merge result, this reproduces the merges exactly, and
every position is marked dead at most once: linear time.

Work is remembered per pair of tokens and per blank-separated word, in bounded memos of
each Python worker; a memo that is full starts anew and changes no result.

Defined results: a null text is an empty one and has no ids; any length of text is encoded
whole; equal rows give equal rows; an empty table gives none; other columns pass through
untouched, but for one of the name of the column that is added (`ids`, `decoded`, or as the
caller names them), which is replaced. A rank file that lacks one of the 256 bytes, or gives two
tokens one rank, is refused with a ValueError: some texts would have no ids, or no way back.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import remembered

MEMO = 250_000
#: A blank between two characters that no definition of \s takes as space: a border of the pattern's matches.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """A rank file's tokens with their automaton; rank is id."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {b: a for a, b in self.rank.items()}
        lacking = [i for i in range(256) if bytes([i]) not in self.rank]
        if lacking or len(self.token) < len(self.rank):
            raise ValueError(f"{path}: " + (f"no token for the bytes {lacking}" if lacking else "several tokens of one rank"))
        self.match = regex.compile(pattern).findall
        # The last merge that makes each token: its two parts.
        self.parts, self.joined = {}, {}
        self.automaton, self.automaton_words = ahocorasick.Automaton(), set()
        for piece, own in self.rank.items():
            parts = self._merge(piece, own) if len(piece) > 1 else [piece]
            if len(parts) <= 2:  # others are never made by merges
                self.automaton.add_word(piece.decode("latin-1"), (own, len(piece) - 1))
                self.automaton_words.add(piece)
                if len(parts) == 2:
                    left, right = self.rank[parts[0]], self.rank[parts[1]]
                    self.parts[own] = left, right
                    self.joined[left, right] = own
        self.automaton.make_automaton()
        # Per token: its bytes, and the longest token that begins it (-1: none).
        self.above = max(self.token) + 1
        self.length, self.shorter = [0] * self.above, [-1] * self.above
        for piece, own in self.rank.items():
            self.length[own] = len(piece)
            self.shorter[own] = next((self.rank[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.automaton_words), -1)
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Starts all memos anew, which gives their room back."""
        if self.words or self.pieces or self.fits:
            self.fits, self.pieces, self.words = {}, {}, {}
            pa.default_memory_pool().release_unused()

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Merges of rank under `below`, lowest first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, below) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= below:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the border between the two tokens survives their merges.

        Merges are undone from the latest backwards on either side of the border. If the two
        tokens at the border could merge before the merge that was last undone, they would have.
        """
        before = len(self.rank) + 1 << 1
        while True:
            made = self.joined.get((left, right))
            # Times: a merge of rank r on the left happens before the same one on the right.
            if made is not None and 2 * made < before:
                return False
            inner_left, inner_right = self.parts.get(left), self.parts.get(right)
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or inner_left is not None and left > right:
                before, left = 2 * left, inner_left[1]
            else:
                before, right = 2 * right + 1, inner_right[0]

    def _piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        raw = text.encode()
        if (own := self.rank.get(raw)) is not None:
            return array("I", (own,)).tobytes()
        size = len(raw)
        longest = [-1] * size
        for last, (token, n) in self.automaton.iter(raw.decode("latin-1")):
            longest[last - n] = token  # the last found at a start is the longest
        fits, length, shorter, dead = self.fits, self.length, self.shorter, bytearray(size + 1)
        if len(fits) > 2 * MEMO:
            fits.clear()
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                if not dead[at + length[token]]:
                    if not ids:
                        break
                    pair = ids[-1] * self.above + token
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self._compatible(ids[-1], token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            else:  # nothing fits here: the token before ends in a dead place
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
        return array("I", ids).tobytes()

    def _word(self, text: str) -> bytes:
        pieces, out = self.pieces, []
        for piece in self.match(text):
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) >= MEMO:
                    pieces.clear()
                ids = self._piece(piece)
                if len(piece) < 64:
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def by_word(self, text: str) -> tuple[list[str], list[bytes]]:
        """The text's words (all but the first had a blank before them) and their ids."""
        words = self.words
        parts = _BORDER.split(text)
        out = [self._word(parts[0]), *map(words.get, parts[1:])]
        if None in out:
            for i, word in enumerate(parts):
                if out[i] is None:
                    ids = words.get(word)
                    if ids is None:
                        if len(words) >= MEMO:
                            words.clear()
                        ids = self._word(" " + word)
                        if len(word) < 64:
                            words[word] = ids
                    out[i] = ids
        return parts, out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        return b"".join(self.by_word(text)[1])

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.token.__getitem__, numbers))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per Python worker."""
    made = Vocabulary(path, pattern)
    remembered(made.forget)
    return made


#: Rows that leave a worker at a time.
ROWS = 256


def _mapped(df: DataFrame, source: str, target: str, make) -> DataFrame:
    """df with a binary column target, made from each value of source (null: b'')."""
    kept = [c for c in df.columns if c != target]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(target, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                values = pa.array([f(x) if x is not None else b"" for x in part.column(source).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), values], [*kept, target])

    return df.select(*kept).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its texts: a binary column of little-endian unsigned 32-bit integers."""
    return _mapped(df, text, ids, lambda: vocabulary(path, pattern).encode)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for."""
    return _mapped(df, ids, decoded, lambda: vocabulary(path, pattern).decode)


def n_tokens(ids: str = "ids"):
    """Column: the number of ids."""
    return (F.octet_length(F.col(ids)) / 4).cast("long")
