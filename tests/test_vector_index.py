"""The vector index against all products."""

import numpy as np
import pytest

from folioframe.operators import vector_index as I
from folioframe.operators import vectors as V


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        scored = []
        for i, x in vectors:
            same = x is not None and len(x) == len(v)
            scored.append((-(round(float(np.dot(x, v)), 6) if same and len(v) else 0.0), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df):
    got = {}
    for x in sorted(df.collect(), key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    return got


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows] and [s for _, s in got[q]] == pytest.approx([s for _, s in rows], abs=2e-6)


def clustered(spark, n=600, d=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d)) * 3
    x = np.round(centres[r.integers(0, 12, n)] + r.normal(size=(n, d)) * 0.3, 3)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(n + i, list(rows[5][1])) for i in range(300)]  # one vector, a third of all
    queries = [(i, [float(v) for v in np.round(centres[i % 12] + r.normal(size=d) * 0.3, 3)]) for i in range(40)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, vector array<double>").repartition(3)
    return rows, queries, frame(rows, "vec_id"), frame(queries, "query_id")


def test_exact_search(spark, monkeypatch):
    rows, queries, vectors, asked = clustered(spark)
    want = brute(rows, queries, 7)
    index = I.build(vectors)
    looked = []
    same(found(I.search(index, asked, 7, looked_at=looked)), want)
    cells = index.cells.count()
    assert sum(looked) < 0.6 * cells * len(queries)  # whole cells are ruled out
    monkeypatch.setattr(I, "BLOCK", 50)  # cells and their queries in several blocks
    index = I.build(vectors, k=9, cells=5)
    same(found(I.search(index, asked, 7)), want)
    with pytest.raises(ValueError, match="at most 9"):
        I.search(index, asked, 10)


def test_probes_find_most(spark):
    rows, queries, vectors, asked = clustered(spark, seed=3)
    want, looked = brute(rows, queries, 5), []
    got = found(I.search(I.build(vectors), asked, 5, probes=6, looked_at=looked))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9 and looked == [6 * len(queries)]


def test_index_of_odd_vectors(spark):
    """Other lengths, nulls, empty vectors, zeros, ties, more results asked for than there are."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [-9.0, 1.0]), (9, [5.0])]
    queries = [(1, [1.0, 0.0]), (2, [-1.0, -1.0, -1.0]), (3, [0.0, 0.0]), (4, [1.0] * 5), (5, [2.0])]
    vectors, asked = spark.createDataFrame(rows, "vec_id long, vector array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>")
    for k in (1, 3, 20):
        same(found(I.search(I.build(vectors), asked, k)), brute(rows, queries, k))
        same(found(V.top_k(asked, vectors, k)), brute(rows, queries, k))
    assert I.search(I.build(vectors.limit(0)), asked, 3).count() == 0 and I.search(I.build(vectors), asked.limit(0), 3).count() == 0


def test_saved_index(spark, tmp_path):
    rows, queries, vectors, asked = clustered(spark, 200, seed=5)
    I.save(I.build(vectors), str(tmp_path))
    same(found(I.search(I.load(spark, str(tmp_path)), asked, 3)), brute(rows, queries, 3))


def test_second_round_sends_a_query_once_to_each_pack(spark, monkeypatch):
    """Noise has no clusters: nearly every cell is looked into, but a query's vector isn't sent to each of them."""
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.round(row / np.linalg.norm(row), 6)]) for i, row in enumerate(r.normal(size=(500, 12)))]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, vector array<double>").repartition(3)
    index, asked = I.build(frame(rows, "vec_id"), 5), frame(rows[::25], "query_id")
    looks = I.search(index, asked, 5, looked_at=(looked := []))
    same(found(looks), brute(rows, rows[::25], 5))
    assert looked[1] > 200 and I._cells(index)[12][4].max() == 0  # all cells in one pack
    monkeypatch.setattr(I, "PACK", 60)
    monkeypatch.setattr(I, "GROUP", 7)
    index = I.build(frame(rows, "vec_id"), 5, cells=12)  # packs of several cells, and a large cell in packs of its own
    same(found(I.search(index, asked, 5)), brute(rows, rows[::25], 5))


def test_vectors_are_shuffled_for_products_only(spark, monkeypatch):
    """Numbers of groups are sent to the vectors: what is shuffled of them goes straight into a product; cells in slices, a bounded sample by its hashes first."""
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.round(row / np.linalg.norm(row), 6)]) for i, row in enumerate(r.normal(size=(400, 12)))]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, vector array<double>").repartition(3)
    for name, size in (("SLICE", 7), ("SAMPLE", 40), ("PACK", 150)):
        monkeypatch.setattr(I, name, size)
    monkeypatch.setattr(I, "GROUP", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = I.search(I.build(frame(rows, "vec_id"), 5), frame(rows[::20], "query_id"), 5)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [pack" not in plan and "BroadcastHashJoin [pack" in plan
    same(found(out), brute(rows, rows[::20], 5))
