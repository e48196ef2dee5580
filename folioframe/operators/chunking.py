"""Where the chunks of a list of lines begin, for whole documents and for ranges of their lines.

A chunk begins at every line that opens a section and where a line would take the tokens held
over a limit. Over prefix sums of the lines' tokens the next beginning is found by bisection,
so a range costs a step per chunk. What a range does to a chunk that was open before it depends
on the tokens held only: a table over those few states tells, for each, the tokens held after
it and the chunks begun in it. Tables of a document's ranges are followed in order, and then
each range knows where it stands: one document may span as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state of a document of which no line has been read; others are tokens held, over the limit being one more than it.
EMPTY = -1


def starts(n: np.ndarray, opens: np.ndarray, held: int, limit: int) -> list[int]:
    """The lines at which chunks begin; n: tokens of each line, opens: whether it opens a section, held: the state before."""
    total, openings, size, out = np.cumsum(n), np.flatnonzero(opens), len(n), []
    if not size:
        return out
    at = 0 if held == EMPTY else _next(total, openings, -1, held, limit)
    while at < size:
        out.append(at)
        at = _next(total, openings, at, 0, limit)
    return out


def _next(total: np.ndarray, openings: np.ndarray, start: int, held: int, limit: int) -> int:
    """The first beginning after a chunk's line `start`, or after what was held before the first line (start -1)."""
    before = total[start - 1] if start > 0 else 0
    full = max(int(np.searchsorted(total, limit - held + before, "right")), start + 1)
    opening = np.searchsorted(openings, start, "right")
    return min(full, int(openings[opening])) if opening < len(openings) else full


def table(n: np.ndarray, opens: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """(tokens held after, chunks begun) for each state before: 0 to limit + 1 tokens, then EMPTY."""
    total, openings, size = np.cumsum(n), np.flatnonzero(opens), len(n)
    known: dict[int, tuple[int, int]] = {}

    def onward(start: int) -> tuple[int, int]:
        way = []
        while start < size and start not in known:
            way.append(start)
            start = _next(total, openings, start, 0, limit)
        for x in reversed(way):
            after = _next(total, openings, x, 0, limit)
            known[x] = (known[after][0], known[after][1] + 1) if after < size else (int(min(total[-1] - (total[x - 1] if x else 0), limit + 1)), 1)
        return known[way[0]] if way else known[start]

    held, begun = [], []
    for state in [*range(limit + 2), EMPTY]:
        first = 0 if state == EMPTY else _next(total, openings, -1, state, limit)
        after, count = onward(first) if first < size else (min(state + int(total[-1] if size else 0), limit + 1), 0)
        held.append(after)
        begun.append(count)
    return held, begun


def starts_udf(limit: int):
    """(n, opens, held) -> the places at which chunks begin, each with the last opening line up to it (-1: none)."""
    find, empty = starts, EMPTY

    @F.pandas_udf("array<struct<start:int,opener:int>>")
    def run(n: pd.Series, opens: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for tokens, flags, state in zip(n, opens, held):
            if tokens is None:
                out.append([])
                continue
            flags = np.asarray(flags, bool)
            places = np.array(find(np.asarray(tokens, np.int64), flags, int(state), limit), np.int64)
            openings = np.concatenate([[-1], np.flatnonzero(flags)])
            openers = openings[np.searchsorted(openings, places, "right") - 1]
            out.append([{"start": int(s), "opener": int(o)} for s, o in zip(places, openers)])
        return pd.Series(out)

    return run


def entries(ranges: DataFrame, limit: int) -> DataFrame:
    """(doc_id, part, held, begun, section) before each range. ranges: doc_id, part, n, opens (the sections that lines open, or null)."""
    tabulate = table

    @F.pandas_udf("held array<int>, begun array<int>")
    def tables(n: pd.Series, opens: pd.Series) -> pd.DataFrame:
        rows = [tabulate(np.asarray(x, np.int64), np.asarray(o, bool), limit) for x, o in zip(n, opens)]
        return pd.DataFrame(rows, columns=["held", "begun"])

    flags = F.transform("opens", lambda o: o.isNotNull())
    last = F.element_at(F.filter("opens", lambda o: o.isNotNull()), -1)
    last = F.when(F.exists("opens", lambda o: o.isNotNull()), last)
    each = ranges.select("doc_id", "part", tables("n", flags).alias("t"), last.alias("section")).select("doc_id", "part", "t.held", "t.begun", "section")
    key = ranges.schema["doc_id"].dataType.simpleString()

    def follow(rows: pd.DataFrame) -> pd.DataFrame:  # a row per range of one document
        rows = rows.sort_values("part")
        state, count, section, out = EMPTY, 0, None, []
        for r in rows.itertuples(index=False):
            out.append((r.doc_id, r.part, state, count, section))
            place = limit + 2 if state == EMPTY else state
            state, count = int(r.held[place]), count + int(r.begun[place])
            section = r.section if r.section is not None else section
        return pd.DataFrame(out, columns=["doc_id", "part", "held", "begun", "section"])

    return each.groupBy("doc_id").applyInPandas(follow, f"doc_id {key}, part int, held int, begun long, section string")


def pieces(lines: DataFrame, limit: int, first_section: str) -> DataFrame:
    """(doc_id, part, chunk_order, section, text, token_count): the chunks' pieces within a range; a piece that goes on with the chunk of the range before has no section.

    lines: doc_id, part, lines, n, opens, and the state before: held, begun, section.
    """
    flags = F.transform("opens", lambda o: o.isNotNull())
    found = lines.withColumn("s", starts_udf(limit)("n", flags, "held"))
    own = F.transform(F.col("s"), lambda s: F.struct(s["start"].alias("start"), F.coalesce(F.when(s["opener"] >= 0, F.get(F.col("opens"), s["opener"])), F.col("section"), F.lit(first_section)).alias("section")))
    going_on = (F.col("held") != EMPTY) & (F.size("lines") > 0) & (F.coalesce(F.get("s", F.lit(0))["start"], F.size("lines")) > 0)
    none = F.lit(None).cast("string")
    all_starts = F.when(going_on, F.concat(F.array(F.struct(F.lit(0).alias("start"), none.alias("section"))), own)).otherwise(own)
    found = found.withColumn("own", all_starts).withColumn("first", F.col("begun") + F.when(going_on, 0).otherwise(1))
    end = lambda i: F.coalesce(F.get(F.col("own"), i + 1)["start"], F.size("lines"))

    def piece(p: Column, i: Column) -> Column:
        long = end(i) - p["start"]
        tokens = F.aggregate(F.slice(F.col("n"), p["start"] + 1, long), F.lit(0), lambda a, x: a + x)
        return F.struct((F.col("first") + i).cast("int").alias("chunk_order"), p["section"].alias("section"), F.array_join(F.slice(F.col("lines"), p["start"] + 1, long), "\n").alias("text"), tokens.alias("token_count"))

    return found.select("doc_id", "part", F.explode(F.transform("own", piece)).alias("p")).select("doc_id", "part", "p.*")
