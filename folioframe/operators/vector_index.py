"""A vector index: cells with centre and radius, searched exactly by bounds or by a few probes.

Centres are k-means cells, fitted in numpy on at most SAMPLE vectors of each length (those of the
smallest hashes of their ids); every vector is placed in its nearest cell, and a cell keeps its
radius, the largest distance from its centre, and its number of vectors. For a query q, no
vector of a cell scores more than q.centre + |q| * radius. An exact search looks into the
PROBES cells of highest bound first; then into every other cell whose bound reaches the query's
k-th score so far. A probe search stops after the cells whose centres score highest.

Cells are dealt into blocks of at most BLOCK vectors, and the queries that look into a cell
into groups of as many, so a task holds two bounded blocks whatever the size of a cell: it
multiplies them as matrices and returns each query's k best. The second round may look into
most cells: there neighbouring cells are packed up to PACK vectors, a query is sent once to each
pack that has a cell for it, and a task tells by the bounds which cells of its pack a query needs. Centres (a bounded number) go to
all executors; queries and vectors stay distributed.

Vectors of another length than the query's score 0, as do nulls: of them only the k smallest
ids of each length can be among the best, and those are kept in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioframe.keeping import kept

#: Vectors of each length that centres are fitted on; lengths that have cells of their own; cells of a length at most.
SAMPLE, LENGTHS, CELLS = 20_000, 4, 4096
#: Cells that a search looks into first; vectors of a block and queries of a group.
PROBES, BLOCK = 4, 4096
#: Vectors of a pack of cells, and queries of a group that looks into one, at a length of 128 or less; longer ones are fewer by as much.
PACK, GROUP = 65_536, 131_072
#: Vectors of a cell that are multiplied at once.
SLICE = 16_384


class VectorIndex(NamedTuple):
    """vectors: (vec_id, vector, d, cell, block), each vector in its cell; cells: (d, cell, centre, radius, n), one row a cell; others: (vec_id, d), the smallest ids of each length."""

    vectors: DataFrame
    cells: DataFrame
    others: DataFrame
    k: int


def kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of at most so many cells."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(rounds):
        of = np.concatenate([np.argmin((centre**2).sum(1) - 2 * part @ centre.T, axis=1) for part in np.array_split(x, max(1, len(x) // 8192))])
        sums, n = np.zeros_like(centre), np.bincount(of, minlength=len(centre))
        np.add.at(sums, of, x)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centre, axis=0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), d)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(int)


def build(chunks: DataFrame, k: int = 100, cells: int | None = None) -> VectorIndex:
    """The index of chunks (vec_id, vector), for searches of at most k results."""
    spark = chunks.sparkSession
    rows = chunks.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.coalesce(F.size("vector"), F.lit(-1)).alias("d"))
    sizes = rows.where("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    centres = {}
    for d, n in sizes:
        part, at = rows.where(F.col("d") == d), F.xxhash64("vec_id")
        first = lambda df: df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
        # Every task would hand on its SAMPLE smallest; hashes that can hardly be among the smallest of all are left out before.
        some = first(part.where(at < int(-(2**63) + 2**64 * min(1.0, 1.5 * SAMPLE / n)))) if n > 2 * SAMPLE else None
        if some is None or some.num_rows < SAMPLE:
            some = first(part)
        centres[d] = kmeans(_matrix(some.column("vector").combine_chunks(), d), cells or min(CELLS, int(n**0.5) + 1))
    shared = spark.sparkContext.broadcast(centres)
    key = chunks.schema["vec_id"].dataType
    matrix, lengths = _matrix, _lengths  # workers need not find this module

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            d = lengths(vectors)
            cell, far = np.full(len(d), -1, np.int32), np.zeros(len(d))
            for size in {int(x) for x in d}:
                mine = np.flatnonzero(d == size)
                if size <= 0:
                    continue
                x = matrix(vectors.take(pa.array(mine)), size)
                centre = shared.value.get(size)
                if centre is None:  # one cell around nothing
                    far[mine] = np.sqrt((x**2).sum(1))
                    continue
                of = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)
                cell[mine], far[mine] = of, np.sqrt(((x - centre[of]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors, pa.array(d.astype(np.int32)), pa.array(cell), pa.array(far)], ["vec_id", "vector", "d", "cell", "far"])

    fields = [T.StructField("vec_id", key), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("d", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]
    placed = kept(rows.select("vec_id", "vector").mapInArrow(place, T.StructType(fields)))
    table = placed.groupBy("d", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = [(int(d), i, [float(v) for v in c]) for d, cs in centres.items() for i, c in enumerate(cs)]
    table = table.join(spark.createDataFrame(known, "d int, cell int, centre array<double>"), ["d", "cell"], "left")  # at most LENGTHS * CELLS rows
    table = kept(table.select("d", "cell", "centre", "radius", "n"))
    blocks = table.select("d", "cell", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    vectors = placed.join(F.broadcast(blocks), ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("far", "blocks")
    smallest = placed.select("vec_id", "d").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["d", "salt"], ["d"]):
        smallest = smallest.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k)
    return VectorIndex(vectors, table, kept(smallest.select("vec_id", "d")), k)


def save(index: VectorIndex, folder: str) -> None:
    """Writes the index; vectors lie in order of their cells, so that a scan for some cells skips the others' row groups."""
    index.vectors.repartitionByRange("d", "cell").sortWithinPartitions("d", "cell").write.mode("overwrite").parquet(f"{folder}/vectors")
    index.cells.write.mode("overwrite").parquet(f"{folder}/cells")
    index.others.withColumn("k", F.lit(index.k)).write.mode("overwrite").parquet(f"{folder}/others")


def load(spark, folder: str) -> VectorIndex:
    others = spark.read.parquet(f"{folder}/others")
    k = others.agg(F.max("k")).first()[0] or 0
    return VectorIndex(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/cells"), others.drop("k"), k)


def _cells(index: VectorIndex) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: cell, centre, radius, blocks, and the first pack of each cell and in how many packs it lies."""
    table = index.cells.select("d", "cell", "centre", "radius", "n").where("d > 0").orderBy("d", "cell").toPandas()  # at most LENGTHS * CELLS rows and one a further length
    cells, pack = {}, 0
    for d, part in table.groupby("d"):
        centre = np.array([c if c is not None else np.zeros(d) for c in part["centre"]], float).reshape(len(part), d)
        n, of, packs, held = part["n"].to_numpy(np.int64), [], [], 0
        most = max(1, PACK * 128 // max(128, int(d)))
        for x in n:
            if held + x > most:
                pack, held = pack + 1, 0
            of.append(pack)
            packs.append(max(1, -(-int(x) // most)))
            pack, held = (pack + packs[-1], 0) if packs[-1] > 1 else (pack, held + x)
        pack += 1
        cells[int(d)] = (part["cell"].to_numpy(np.int32), centre, part["radius"].to_numpy(float), -(-n // BLOCK), np.array(of, np.int32), np.array(packs, np.int32))
    return cells


def _ordered(q: np.ndarray, centre: np.ndarray, radius: np.ndarray, probes: int, by_centre: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bound of each query in each cell, and whether the cell is among the query's first `probes`."""
    near = q @ centre.T
    bound = near + np.sqrt((q**2).sum(1))[:, None] * radius
    first = np.zeros(bound.shape, bool)
    np.put_along_axis(first, np.argsort(-(near if by_centre else bound), axis=1, kind="stable")[:, :probes], True, axis=1)
    return bound, first


def _looks(shared, queries: DataFrame, probes: int, by_centre: bool) -> DataFrame:
    """(query_id, vector, d, looks): for each query the `probes` best cells of its length as (cell, blocks)."""
    lengths, matrix, ordered, rows = _lengths, _matrix, _ordered, 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("blocks", pa.int32())]))
        for batch in batches:
            d, out = lengths(batch.column("vector")), [[] for _ in range(batch.num_rows)]
            for size in {int(x) for x in d} & shared.value.keys():
                mine = np.flatnonzero(d == size)
                cell, centre, radius, blocks, _, _ = shared.value[size]
                for low in range(0, len(mine), rows):
                    some = mine[low : low + rows]
                    _, first = ordered(matrix(batch.column("vector").take(pa.array(some)), size), centre, radius, probes, by_centre)
                    for i, at in zip(some, first):
                        out[i] = [{"cell": cell[c], "blocks": blocks[c]} for c in np.flatnonzero(at)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(d.astype(np.int32)), pa.array(out, kind)], ["query_id", "vector", "d", "looks"])

    fields = [queries.schema["query_id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("d", T.IntegerType()), T.StructField("looks", T._parse_datatype_string("array<struct<cell:int,blocks:int>>"))]
    return queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, T.StructType(fields))


def _more(shared, asked: DataFrame, probes: int) -> DataFrame:
    """(query_id, vector, d, least, n_cells, packs): how many other cells may hold one of a query's k best, and the packs they lie in. asked: query_id, vector, d, least (null: any score counts)."""
    matrix, ordered, rows = _matrix, _ordered, 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, least = batch.column("d").to_numpy(), np.nan_to_num(batch.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            n, out = np.zeros(len(d), np.int64), [[] for _ in range(len(d))]
            for size in {int(x) for x in d} & shared.value.keys():
                mine = np.flatnonzero(d == size)
                _, centre, radius, _, pack, packs = shared.value[size]
                for low in range(0, len(mine), rows):
                    some = mine[low : low + rows]
                    bound, first = ordered(matrix(batch.column("vector").take(pa.array(some)), size), centre, radius, probes, False)
                    need = ~first & (bound + 1e-6 >= least[some, None])
                    n[some] = need.sum(1)
                    for i, at in zip(some, need):
                        out[i] = np.unique(np.concatenate([pack[at], *(np.arange(pack[c], pack[c] + packs[c]) for c in np.flatnonzero(at & (packs > 1)))])).tolist()
            columns = [batch.column("query_id"), batch.column("vector"), batch.column("d"), batch.column("least"), pa.array(n), pa.array(out, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vector", "d", "least", "n_cells", "packs"])

    fields = [asked.schema[c] for c in ("query_id", "vector", "d", "least")] + [T.StructField("n_cells", T.LongType()), T.StructField("packs", T.ArrayType(T.IntegerType()))]
    return asked.select("query_id", "vector", "d", "least").mapInArrow(run, T.StructType(fields))


def _rest(index: VectorIndex, shared, more: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in every pack, of the cells that `_more` counts, none below its least score."""
    q = more.select("query_id", "vector", "d", "least", F.explode("packs").alias("pack"))
    n = F.count(F.lit(1))
    # At most as many rows as there are packs, so vectors are shuffled for their products only; up to three groups where one task would be long.
    groups = q.groupBy("pack").agg(F.greatest(F.ceil(n * F.greatest(F.max("d"), F.lit(128)) / (GROUP * 128)), F.least(F.lit(3), F.ceil(n / (GROUP / 32)))).alias("groups"))
    groups = F.broadcast(kept(groups))
    q = q.join(groups, "pack").withColumn("group", F.pmod(F.xxhash64("query_id"), "groups").cast("int")).drop("groups")
    known = [(d, int(c), int(p), int(n)) for d, x in shared.value.items() for c, p, n in zip(x[0], x[4], x[5])]
    placed = index.vectors.sparkSession.createDataFrame(known, "d int, cell int, pack int, packs int")  # as many rows as there are cells
    v = index.vectors.join(F.broadcast(placed), ["d", "cell"]).withColumn("pack", (F.col("pack") + F.pmod(F.xxhash64("vec_id"), "packs")).cast("int"))
    v = v.join(groups, "pack").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1))).select("pack", "group", "d", "cell", "vec_id", "vector")
    matrix, ordered, rows, most = _matrix, _ordered, 512, SLICE

    def multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
        q_type, v_type = left.schema.field("query_id").type, right.schema.field("vec_id").type
        names = ["query_id", "vec_id", "score"]
        parts = [pa.table([pa.array([], q_type), pa.array([], v_type), pa.array([], pa.float64())], names)]
        if not left.num_rows or not right.num_rows:
            return parts[0]
        d = right.column("d")[0].as_py()
        cell, centre, radius, _, _, _ = shared.value[d]
        right = right.take(pc.sort_indices(right, [("cell", "ascending"), ("vec_id", "ascending")]))
        x, ids, of = matrix(right.column("vector").combine_chunks(), d), right.column("vec_id").combine_chunks(), right.column("cell").to_numpy()
        cells, starts = np.unique(of, return_index=True)
        ends, place = np.append(starts[1:], len(of)), np.searchsorted(cell, cells)
        slices = [(c, a, min(a + most, end)) for c, (begin, end) in enumerate(zip(starts, ends)) for a in range(begin, end, most)]
        by_id = np.empty(len(x), np.int64)  # the order of the ids
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(x))
        q, asked = matrix(left.column("vector").combine_chunks(), d), left.column("query_id").combine_chunks()
        least = np.nan_to_num(left.column("least").to_numpy().astype(float), nan=-np.inf)
        for low in range(0, len(q), rows):
            some, bar = q[low : low + rows], least[low : low + rows]
            bound, first = ordered(some, centre, radius, probes, False)
            need = (~first & (bound + 1e-6 >= bar[:, None]))[:, place]
            best: list[tuple[np.ndarray, ...]] = []
            asks = need.any(0)
            for c, begin, end in slices:
                if not asks[c]:
                    continue
                who = np.flatnonzero(need[:, c])
                scores = some[who] @ x[begin:end].T
                row, column = np.nonzero(scores >= bar[who, None] - 1e-6)
                if len(row) > 4 * k * len(who):  # many reach it: at most k of the slice for each
                    exact = np.rint(scores * 1e6).astype(np.int64) * len(x) - by_id[begin:end]
                    top = np.argpartition(-exact, min(k, exact.shape[1]) - 1, axis=1)[:, :k]
                    row, column = np.repeat(np.arange(len(who)), top.shape[1]), top.ravel()
                best.append((who[row], begin + column, np.round(scores[row, column], 6)))
            if not best:
                continue
            who, at, score = (np.concatenate(z) for z in zip(*best))
            kept = score >= bar[who]
            who, at, score = who[kept], at[kept], score[kept]
            order = np.lexsort((by_id[at], -score, who))
            who = who[order]
            order = order[np.arange(len(order)) - np.searchsorted(who, who) < k]
            back = np.concatenate([z[0] for z in best])[kept][order]
            parts.append(pa.table([asked.take(pa.array(low + back)), ids.take(pa.array(at[order])), pa.array(score[order])], names))
        return pa.concat_tables(parts)

    kind = T.StructType([more.schema["query_id"], index.vectors.schema["vec_id"], T.StructField("score", T.DoubleType())])
    return q.groupBy("pack", "group").cogroup(v.groupBy("pack", "group")).applyInArrow(multiplied, kind)


def _scored(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in every block of the cells that it looks into. asked: query_id, vector, d, cell, blocks."""
    groups = F.broadcast(asked.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("groups")))  # at most as many rows as there are cells
    q = asked.join(groups, ["d", "cell"]).withColumn("group", F.pmod(F.xxhash64("query_id"), "groups").cast("int"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("d", "cell", "block", "group", "query_id", "vector")
    v = index.vectors.join(groups, ["d", "cell"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)))
    v = v.select("d", "cell", "block", "group", "vec_id", "vector")
    matrix, rows = _matrix, 512

    def multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
        q_type, v_type = left.schema.field("query_id").type, right.schema.field("vec_id").type
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], q_type), pa.array([], v_type), pa.array([], pa.float64())], names)
        d = left.column("d")[0].as_py()
        right = right.take(pc.sort_indices(right, [("vec_id", "ascending")]))
        x, ids = matrix(right.column("vector").combine_chunks(), d), right.column("vec_id")
        asked, q, n = left.column("query_id"), matrix(left.column("vector").combine_chunks(), d), len(x)
        parts = []
        for low in range(0, len(q), rows):
            scores = np.round(q[low : low + rows] @ x.T, 6)
            # All different; of equal scores the smaller id first.
            order = np.rint(scores * 1e6).astype(np.int64) * n - np.arange(n)
            best = np.argpartition(-order, min(k, n) - 1, axis=1)[:, :k]
            who = np.repeat(np.arange(low, low + len(scores)), best.shape[1])
            parts.append(pa.table([asked.take(pa.array(who)), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], names))
        return pa.concat_tables(parts)

    by = ["d", "cell", "block", "group"]
    kind = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("vec_id", index.vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    return q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(multiplied, kind)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int | None = None, looked_at: list[int] | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors of each query; ties by vec_id.

    Exact, unless probes says into how many cells a query looks at most. looked_at gets the
    numbers of (query, cell) pairs that were looked into, round by round.
    """
    if k > index.k:
        raise ValueError(f"the index was built for at most {index.k} results")
    shared = queries.sparkSession.sparkContext.broadcast(_cells(index))
    looks = kept(_looks(shared, queries, probes or PROBES, probes is not None))
    now = looks.select("query_id", "vector", "d", F.explode("looks").alias("look")).select("query_id", "vector", "d", "look.*")
    # Vectors of other lengths score 0.
    lengths = index.others.select("d").distinct().withColumnRenamed("d", "other")
    known = F.array(*(F.lit(x["other"]) for x in lengths.collect())).cast("array<int>")
    far = looks.select("query_id", F.explode(F.filter(known, lambda x: (x != F.col("d")) | (x <= 0))).alias("d"))
    zeros = far.join(index.others, "d").select("query_id", "vec_id", F.lit(0.0).alias("score"))
    found = kept(_first(_scored(index, now, k).unionByName(zeros), k))
    if looked_at is not None:
        looked_at.append(now.count())
    if probes is not None:
        return found
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = kept(_more(shared, looks.drop("looks").join(least, "query_id", "left"), PROBES))
    if looked_at is not None:
        looked_at.append(more.agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0])
    return _first(found.select("query_id", "vec_id", "score").unionByName(_rest(index, shared, more, k, PROBES)), k)
