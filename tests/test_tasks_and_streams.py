import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe.operators import tasks as T

DAY = dt.date(2024, 6, 30)


def tasks(spark):
    rows = [
        (1, "a", 1, T.DONE, DAY - dt.timedelta(9), 100, 5.0), (2, "b", 1, T.DOING, DAY - dt.timedelta(1), None, 2.345), (3, "c", 1, T.PENDING, DAY, 0, None),
        (4, "d", 2, T.WAITING, DAY + dt.timedelta(3), 50, 1.0), (5, "e", 2, T.PENDING, None, 20, 1.0), (6, "f", None, T.DOING, DAY + dt.timedelta(4), 10, 1.0),
    ]
    return spark.createDataFrame(rows, "id long, title string, assigned_to_id long, status string, deadline date, progress int, point double")


def test_statistics(spark):
    r = T.statistics(tasks(spark), F.lit(DAY)).first()
    assert (r.total, r.pending, r.doing, r.waiting, r.done, r.overdue, r.due_soon, r.avg_progress) == (6, 2, 2, 1, 1, 1, 2, 36.0)
    r = T.statistics(tasks(spark).limit(0), F.lit(DAY)).first()
    assert r.total == 0 and r.pending is None


def test_kpi(spark):
    staff = spark.createDataFrame([(1, "An"), (2, "Bình"), (3, "Chi")], "id long, full_name string")
    got = [tuple(r)[1:] for r in T.kpi_order(T.kpi(staff, tasks(spark), F.lit(DAY))).collect()]
    assert got == [("An", 3, 1, 1, 5.0, 7.35, 33.3), ("Bình", 2, 0, 0, 0.0, 2.0, 35.0), ("Chi", 0, 0, 0, 0.0, 0.0, 0.0)]


def test_order_and_limits(spark):
    assert [r.id for r in T.by_deadline(tasks(spark)).collect()] == [1, 2, 3, 4, 6, 5]
    assert [r.id for r in T.attention(tasks(spark), 2).collect()] == [2, 3]
    with pytest.raises(ValueError):
        T.attention(tasks(spark), 0)


def test_report_export(spark, tmp_path):
    T.export_report({"tasks": tasks(spark), "open": tasks(spark).where("progress < 100")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/tasks").count() == 6


def updates(spark, folder):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, 7, t(1), 10.0, "", "e1"), (2, 7, t(5), 100.0, "", None), (3, 7, t(3), 50.0, "x", "e3"), (4, 8, t(2), 30.0, "y", None), (4, 8, t(2), 30.0, "y", None), (5, 8, t(2), 40.0, "", None)]
    df = spark.createDataFrame(rows, "update_id long, task_id long, ts timestamp, progress double, status string, evidence_path string")
    df.coalesce(1).write.parquet(folder)
    return df


def drained(stream, name, tmp_path):
    q = stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_live_state_equals_the_batch(spark, tmp_path):
    from folioframe.streaming.live import live_task_state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = updates(spark, f"{tmp_path}/in")
    drained(live_task_state(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "live", tmp_path)
    columns = ["task_id", "progress", "status", "evidence_path", "n_updates"]
    want = T.latest_state(df.dropDuplicates(["update_id"])).select(*columns)
    assert sorted(map(tuple, spark.table("live").select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_review_monitor_equals_the_replay(spark, tmp_path):
    from folioframe.operators.drafting import replayed
    from folioframe.streaming.live import review_monitor

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = spark.createDataFrame([(1, 1, "approve_outline"), (1, 2, "export"), (1, 3, "generate_draft"), (2, 1, "export")], "result_id long, seq long, action string")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    drained(review_monitor(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")), "gates", tmp_path)
    assert sorted(map(tuple, spark.table("gates").collect())) == sorted(map(tuple, replayed(log).collect()))


def test_review_monitor_in_any_order(spark, tmp_path):
    """Shuffled, repeated and split into batches, the log gives the replay's rows; what comes after the watermark has passed it is late."""
    import random
    from datetime import datetime, timedelta

    from folioframe.operators.drafting import replayed
    from folioframe.streaming.live import review_monitor

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(7)
    names = ["approve_outline", "generate_draft", "save_review", "approve_draft", "export"]
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    log = [(k, seq, r.choice(names) if r.random() < 0.6 else names[seq % 5], day(seq)) for k in range(12) for seq in range(1, 15)]
    schema = "result_id long, seq long, action string, ts timestamp"
    want = {x.result_id: (x.status, x.n_refused) for x in replayed(spark.createDataFrame(log, schema).select("result_id", "seq", "action")).collect()}

    def run(name, batches, delay):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/b{i}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
        out = review_monitor(source, delay)
        seen = []
        write = lambda df, i: seen.append((i, [tuple(x) for x in df.collect()]))
        q = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return [x for _, rows in seen for x in rows]

    shuffled = [*log, *r.sample(log, 60)]
    r.shuffle(shuffled)
    last = {x[0]: x[1:] for x in run("any", [shuffled[i::3] for i in range(3)], None)}
    assert last == want
    # Within the delay in any order; the last batch's old action comes too late and changes nothing.
    ordered = sorted(log, key=lambda x: x[1] + r.uniform(-2, 2))
    batches = [ordered[:80], ordered[80:], [(0, 99, "nothing", day(400))], [(0, 100, "nothing", day(401))], [(3, 1, "export", day(1)), (4, 2, "export", day(399))]]
    rows = run("timed", batches, "20 days")
    assert {x[0]: x[1:3] for x in rows if x[3] is None and x[0]} == {k: v for k, v in want.items() if k}
    assert [x for x in rows if x[3] is not None] == [(4, None, None, 2)]
    assert {x[0]: x[1:3] for x in rows if x[3] is None}[0] == (want[0][0], want[0][1] + 2)


def test_entry_works_without_the_optional_part(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert not [q for q in entry.queries() if q.startswith("op")] and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_arriving_files(spark, tmp_path):
    from folioframe.streaming.live import catalogue_before, index_arriving_files

    root, folder = tmp_path / "in", f"file://{tmp_path}/catalogue"
    root.mkdir()
    run = lambda: index_arriving_files(spark, f"file://{root}", folder, f"file://{tmp_path}/checkpoint").awaitTermination()
    (root / "a.txt").write_text("first text")
    (root / "~$b.txt").write_text("ignored")
    run()
    (root / "copy.txt").write_text("first text")
    (root / "c.txt").write_text("other text")
    run()
    rows = {r.file_name: r for r in catalogue_before(spark, folder).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.txt": "need_review", "copy.txt": "duplicate", "c.txt": "need_review"}
    assert str(rows["a.txt"].id) in rows["copy.txt"].summary
    run()
    assert catalogue_before(spark, folder).count() == 3 and catalogue_before(spark, folder, 1).count() == 1


def test_lists_and_validation(spark):
    from folioframe.operators import lists as L
    from folioframe.operators import validation as V

    rows = spark.createDataFrame([(1, "new", 5.0, 2), (2, "new", 7.0, 1), (3, "old", 7.0, 1)], "id long, status string, score double, request_id long")
    rows = rows.selectExpr("*", "score AS updated_at", "score AS created_at", "'x' AS document_type", "id AS result_id", "'t' AS citation_type")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(L.draft_results(rows)) == [3, 2, 1] and ids(L.draft_results(rows, "new", 1)) == [2] and ids(L.templates(rows, "old")) == [3]
    assert ids(L.citations(rows, request_id=1)) == [2, 3] and ids(L.citations(rows, request_id=0)) == [2, 3, 1]
    with pytest.raises(ValueError):
        L.draft_requests(rows, limit=0)
    got = L.children(rows.select("id"), rows.select(F.col("request_id").alias("id"), "score", F.col("id").alias("child")), "id", ["child"], -F.col("score"), F.col("child")).collect()
    assert {r.id: [c.child for c in r.children] for r in got} == {1: [2, 3], 2: [1], 3: []}
    reasons = lambda df: [r.reject_reason for r in df.collect()]
    uploads = spark.createDataFrame([("a.PDF", 1), ("a.txt", 1), ("a.doc", 0), ("a.docx", 50 * 1024 * 1024 + 1), ("pdf", 1)], "file_name string, length long")
    assert reasons(V.uploads(uploads)) == [None, "unsupported extension", "empty file", "file too large", "unsupported extension"]
    docs = spark.createDataFrame([(" ", "f.TXT", "/p", "TXT ", 1, "c", ""), ("t", " ", "/p", "txt", 1, "c", "new"), ("t", "f", "/p", "txt", -1, "c", "new"), ("t", "f", "/p", "txt", 1, None, "new"), ("t", "f", "/p", "txt", 1, "c", "odd")], "title string, file_name string, file_path string, file_ext string, file_size long, checksum string, status string")
    out = V.library_documents(docs).collect()
    assert [r.reject_reason for r in out] == [None, "file_name is required", "file_size is negative", "checksum is required", "unknown status"]
    assert (out[0].title, out[0].status, out[0].file_ext) == ("f.TXT", "new", "txt")
    relations = spark.createDataFrame([(1, 2, "r"), (0, 2, "r"), (1, -1, "r"), (3, 3, "r"), (None, 3, " ")], "source_id long, target_id long, relation_type string")
    assert reasons(V.relations(relations)) == [None, "source_id is not positive", "target_id is not positive", "a document is related to itself", "relation_type is required"]
    templates = spark.createDataFrame([("n", "/a/b.DOCX", "", 1), ("n", "/a/b.txt", None, 1), ("n", "", "pdf", -1), (" ", "/a.d/b", "", 1)], "name string, source_path string, file_ext string, file_size long")
    out = V.templates(templates).collect()
    assert [(r.reject_reason, r.is_ready) for r in out] == [(None, True), ("unsupported extension", False), ("file_size is negative", False), (None, False)]
    entities = spark.createDataFrame([("t", "v", 1.0), ("", "v", 1.0), ("t", None, 1.0), ("t", "v", 0.0)], "entity_type string, entity_value string, weight double")
    assert reasons(V.entities(entities)) == [None, "entity_type is required", "entity_value is required", "weight is not positive"]
