"""The store by key and the ingest job: commits, replays, deletions, search."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folioframe.sources import ingest as I
from folioframe.sources.store import Conflict, Store, Table

TABLES = {"t": Table("k", "k long, a string, b int", 8), "c": Table("p", "p long, x string", 4)}
NOW = "2024-05-01 10:00:00"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, values, schema="k long, a string, b int"):
    return spark.createDataFrame(values, schema)


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    assert rows(store.read("t")) == [] and store.versions() == []
    store.begin().upsert("t", table(spark, [(i, f"a{i}", i) for i in range(200)])).commit()
    before = store.manifest()["tables"]["t"]
    # One row: its bucket alone is written again, the table of the version before is still there.
    assert store.begin().upsert("t", table(spark, [(7, None, 70), (900, "new", None)])).commit() == 2
    after = store.manifest()["tables"]["t"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    want = {i: (i, f"a{i}", i) for i in range(200)} | {7: (7, "a7", 70), 900: (900, "new", None)}
    assert sorted(x.k for x in store.read("t").collect()) == sorted(want) and {x.k: tuple(x) for x in store.read("t").collect()} == want
    assert {x.k for x in store.read("t", version=1).collect()} == set(range(200))
    with pytest.raises(ValueError, match="of one k"):
        store.begin().upsert("t", table(spark, [(1, "x", 1), (1, "y", 2)]))
    store.begin().upsert("t", table(spark, [(1, "x", 1), (1, "y", 2)]), order="b").commit()
    assert {x.a for x in store.read("t").where("k = 1").collect()} == {"y"}
    assert store.vacuum(keep=1) > 0 and len(store.versions()) == 1 and store.read("t").count() == 201


def test_store_commits_together_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    store.begin().upsert("t", table(spark, [(1, "a", 1)])).replace("c", table(spark, [(1,), (2,)], "p long"), table(spark, [(1, "x"), (1, "y"), (3, "z")], "p long, x string")).commit()
    assert rows(store.read("c")) == [(1, "x"), (1, "y")]  # 3 is no parent that was named
    killed = store.begin().upsert("t", table(spark, [(1, "b", 2)]))
    boom = spark.range(1).select(F.col("id").alias("p"), F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        killed.replace("c", table(spark, [(0,)], "p long"), boom)
    assert rows(store.read("t")) == [(1, "a", 1)] and store.versions() == [1]
    one, two = store.begin().upsert("t", table(spark, [(5, "one", 1)])), store.begin().upsert("t", table(spark, [(6, "two", 1)]))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert {x.k for x in store.read("t").collect()} == {1, 5}
    assert store.vacuum() > 0 and rows(store.read("c")) == [(1, "x"), (1, "y")]


def test_store_after_random_rounds(spark, tmp_path):
    store, r, want = Store(spark, str(tmp_path / "s"), TABLES), random.Random(2), {}
    for _ in range(5):
        new = {r.randrange(60): (r.choice(["p", "q", None]), r.choice([None, 1, 2])) for _ in range(15)}
        store.begin().upsert("t", table(spark, [(k, *v) for k, v in new.items()])).commit()
        for k, v in new.items():
            want[k] = tuple(n if n is not None else o for n, o in zip(v, want.get(k, (None, None))))
    assert {x.k: (x.a, x.b) for x in store.read("t").collect()} == want


DOC = "library_document_id string, title string, document_number string, source_checksum string, text string, status string"


def test_ingest(spark, tmp_path):
    store = I.open_store(spark, str(tmp_path / "s"))
    text = lambda w: f"Điều 1. {w} report on the budget\nsecond line about {w}"
    docs = [("1", "One", "1/A", "c1", text("river"), ""), ("2", "Two", "2/A", "c2", text("mountain"), ""), ("3", "Three", "3/A", "c3", "  ", "")]
    assert I.ingest(store, table(spark, docs, DOC), NOW, stream="s", batch=0) == {"total": 3, "processed": 3, "skipped": 0, "indexed": 2, "failed": 1, "deleted": 0}
    assert rows(store.read("state").select("library_document_id", "status")) == [("1", "indexed"), ("2", "indexed"), ("3", "failed")]
    assert rows(store.read("failures").select("library_document_id", "reason")) == [("3", "the text is empty")]
    assert {x.library_document_id for x in store.read("entities").collect()} == {"1", "2"}
    # The same batch again changes nothing; the same documents in a later one are skipped, but for the failed one.
    version = store.manifest()["version"]
    assert I.ingest(store, table(spark, docs, DOC), NOW, stream="s", batch=0)["total"] == 0 and store.manifest()["version"] == version
    assert I.ingest(store, table(spark, docs, DOC), NOW, stream="s", batch=1) == {"total": 3, "processed": 1, "skipped": 2, "indexed": 0, "failed": 1, "deleted": 0}
    queries = spark.createDataFrame([(1, "mountain"), (2, "river budget")], "query_id long, query_text string")
    best = {x.query_id: x.citation for x in I.search_text(store, queries, 3).where("rank = 1").collect()}
    assert (best[1].doc_id, best[1].title, best[1].document_number, best[1].chunk_order) == ("2", "Two", "2/A", 1) and best[2].doc_id == "1"
    # One changed, one gone.
    docs = [("1", "One", "1/A", "c9", text("desert"), ""), ("3", "Three", "3/A", "c4", text("river"), "")]
    assert I.ingest(store, table(spark, docs, DOC), NOW) == {"total": 2, "processed": 2, "skipped": 0, "indexed": 2, "failed": 0, "deleted": 1}
    assert rows(store.read("state").select("library_document_id", "status")) == [("1", "indexed"), ("2", "deleted"), ("3", "indexed")]
    assert store.read("failures").count() == 0 and {x.library_document_id for x in store.read("chunks").collect()} == {"1", "3"}
    hits = I.search_text(store, queries, 9).collect()
    assert {x.citation.doc_id for x in hits} == {"1", "3"} and "mountain" not in " ".join(x.text for x in hits)
    assert I.ingest(store, table(spark, docs, DOC), NOW, content="metadata")["skipped"] == 2
    # Only some documents are given: the others stay, but for those that are said to be deleted.
    assert I.ingest(store, table(spark, [("1", None, None, "c9", text("desert"), "deleted")], DOC), NOW, complete=False)["deleted"] == 1
    assert {x.library_document_id for x in store.read("chunks").collect()} == {"3"}


def test_ingest_of_a_folder(spark, tmp_path):
    root, folder = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    for i, w in enumerate(["alpha", "beta", "gamma"]):
        (root / f"{w}.txt").write_text(f"{w} first line\n{w} second line {i}", encoding="utf-8")
    (root / "copy.txt").write_bytes((root / "alpha.txt").read_bytes())
    (root / "~$x.txt").write_text("ignored")
    first = I.ingest_folder(spark, f"file:{root}", folder, NOW)
    assert (first["indexed"], first["skipped"]) == (4, 0)
    again = I.ingest_folder(spark, f"file:{root}", folder, NOW)
    assert (again["indexed"], again["skipped"], again["deleted"]) == (0, 4, 0)
    os.remove(root / "beta.txt")
    (root / "gamma.txt").write_text("delta now", encoding="utf-8")
    third = I.ingest_folder(spark, f"file:{root}", folder, NOW)
    assert (third["indexed"], third["skipped"], third["deleted"]) == (1, 2, 1)
    store = I.open_store(spark, folder)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    assert dict(rows(store.read("state").select(name("library_document_id"), "status"))) == {"alpha.txt": "indexed", "beta.txt": "deleted", "copy.txt": "indexed", "gamma.txt": "indexed"}
    status = dict(rows(store.read("catalogue").select("file_name", "status")))
    assert status["beta.txt"] == "deleted" and sorted(status[x] for x in ("alpha.txt", "copy.txt")) == ["duplicate", "need_review"]
    queries = spark.createDataFrame([(1, "delta")], "query_id long, query_text string")
    assert [x.text for x in I.search_text(store, queries, 1).collect()] == ["delta now"]


def test_ingest_of_arriving_files(spark, tmp_path):
    root, folder, seen = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    root.mkdir()
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    store = I.open_store(spark, folder)
    state = lambda: dict(rows(store.read("state").select(name("library_document_id"), "status")))
    run = lambda at: I.ingest_arriving_files(spark, f"file:{root}", folder, at, NOW).awaitTermination(240)
    (root / "a.txt").write_text("alpha line", encoding="utf-8")
    (root / "b.txt").write_text("beta line", encoding="utf-8")
    run(seen)
    assert state() == {"a.txt": "indexed", "b.txt": "indexed"}
    os.remove(root / "a.txt")
    (root / "c.txt").write_text("gamma line", encoding="utf-8")
    run(seen)
    assert state() == {"a.txt": "deleted", "b.txt": "indexed", "c.txt": "indexed"}
    assert dict(rows(store.read("catalogue").select("file_name", "status")))["a.txt"] == "deleted"
    # A stream whose own record is lost begins again with batch 0: the store has that one.
    version = store.manifest()["version"]
    run(seen + "-lost")
    assert store.manifest()["version"] == version and store.done("arriving") == 1
