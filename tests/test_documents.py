import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions import rules as R
from folioframe.operators import catalog as C
from folioframe.operators import drafting as D
from folioframe.operators import knowledge as K
from folioframe.operators import metadata as M
from folioframe.operators import vectors as V


def test_scan_index_and_delete(spark, tmp_path):
    from folioframe.sources import files as S

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("Số: 1-KH/TU\nngày 1 tháng 2 năm 2024", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "copy.txt").write_text("Số: 1-KH/TU\nngày 1 tháng 2 năm 2024", encoding="utf-8")
    (tmp_path / "~$x.docx").write_text("x")
    (tmp_path / "p.png").write_text("x")
    (tmp_path / "d.docx").write_text("x")
    found = S.with_checksum(S.scan_folder(spark, str(tmp_path)))
    empty = spark.createDataFrame([], "id long, file_path string, checksum string, status string, title string")
    report = S.scan_report(C.scan_states(found, empty)).first()
    assert (report.total, report.accepted, report.ignored, report.unsupported, report.new) == (6, 4, 1, 1, 6)
    catalogue, counts = S.index_folder(spark, f"file:{tmp_path}", empty)
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in catalogue.collect()}
    assert rows["a.txt"].document_number == "1-KH/TU" and {rows["a.txt"].status, rows["copy.txt"].status} == {"need_review", "duplicate"}
    assert rows["b.txt"].status == "need_review" and rows["d.docx"].status == "unsupported"
    kept = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(catalogue.collect())], catalogue.schema)
    (tmp_path / "b.txt").unlink()
    again, _ = S.index_folder(spark, f"file:{tmp_path}", kept)
    assert {r.file_path.rsplit("/", 1)[1]: r.status for r in again.collect()}["b.txt"] == "deleted"


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, note string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, title string, extra string")
    assert sorted(tuple(r) for r in C.upsert(old, new, "id").collect()) == [(1, "a", "x", None), (2, "b", "y", "n"), (3, "c", None, "m")]
    children = C.replace_children(spark.createDataFrame([(1, "o"), (2, "o")], "p int, v string"), spark.createDataFrame([(2, "n"), (2, "m")], "p int, v string"), "p")
    assert sorted(map(tuple, children.collect())) == [(1, "o"), (2, "m"), (2, "n")]
    with pytest.raises(ValueError):
        C.search(old.withColumn("updated_at", F.lit(1)), limit=0)


def model_relations(docs, values, ranks):
    """The loop over all documents in the order of their ids, rows kept by key."""
    rows = {}
    for s, (st, sf) in sorted(docs.items()):
        for k in [k for k in rows if k[0] == s]:
            del rows[k]
        for t, (tt, tf) in sorted(docs.items()):
            shared = values[s] & values[t]
            if s == t or not shared and sf != tf:
                continue
            if st == "Báo cáo" and tt in ("Kế hoạch", "Công văn"):
                kind = "reports"
            elif st in ("Công văn", "Kế hoạch") and tt in ("Quy định", "Quyết định"):
                kind = "implements"
            elif ranks.get(st, 99) > ranks.get(tt, 99):
                kind = "follows"
            elif shared:
                kind = "related"
            else:
                continue
            weight, text = float(max(1, len(shared))), ", ".join(sorted(shared)[:8])
            rows[s, t, kind] = (weight, 1.0, False, text)
            if kind == "related":
                rows[t, s, kind] = (weight, min(1.0, 0.5 + len(shared) * 0.1), True, text)
    return rows


def test_relations_match_a_plain_model(spark):
    r = random.Random(7)
    kinds = [*R.TYPE_RANKS, None, "Khác"]
    docs = {i: (r.choice(kinds), r.choice(["f", "g", None])) for i in range(25)}
    values = {i: {r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 4))} for i in docs}
    want = model_relations(docs, values, R.TYPE_RANKS)
    # The model rebuilds once; a second pass in the same order gives the settled state.
    d = spark.createDataFrame([(i, *x) for i, x in docs.items()], "doc_id long, document_type string, field string")
    v = spark.createDataFrame([(i, x) for i, s in values.items() for x in s], "doc_id long, entity_value string")
    got = {(x.source_id, x.target_id, x.relation_type): (x.weight, x.confidence, x.is_bidirectional, x.evidence) for x in K.relations(d, v).collect()}
    assert {k: x[:1] for k, x in got.items()} == {k: x[:1] for k, x in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want if k[0] < k[1] or want[k][2])


def test_all_relations_lose_no_shared_value(spark):
    from folioframe.plans import document_queries as Q
    from folioframe.plans.registry import queries

    d = "/root/testdata/sf0.001"
    values = {}
    for r in Q._all_values(spark, d).collect():
        values.setdefault(r.doc_id, set()).add(r.entity_value.lower())
    holders = {}
    for i, vs in values.items():
        for v in vs:
            holders.setdefault(v, set()).add(i)
    assert max(map(len, holders.values())) > 40
    want = {(a, b): (len(x), ", ".join(sorted(x)[:8])) for a in values for b in values if a < b and (x := values[a] & values[b])}
    assert {(r.a, r.b): (r.shared, r.evidence) for r in queries()["c7_all_shared_values"](spark, d).collect()} == want
    docs = {r.doc_id: (r.document_type, r.source) for r in Q._typed(spark, d).collect()}
    want = model_relations(docs, {i: values.get(i, set()) for i in docs}, R.TYPE_RANKS)
    got = {(r.source_id, r.target_id, r.relation_type): (r.weight, r.is_bidirectional, r.evidence) for r in queries()["h1_h2_all_relations"](spark, d).collect()}
    assert got == {k: (x[0], x[2], x[3]) for k, x in want.items()}


def test_all_pairs_share_metadata_too(spark):
    from folioframe.plans.registry import queries

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    pairs = {(r.a, r.b): r.shared for r in queries()["c7_all_shared_values"](spark, d).collect()}
    assert all(pairs.get((a, b), 0) >= sum(x == y for x, y in zip(docs[a], docs[b])) for a in docs for b in docs if a < b)


def test_whole_catalogue_fields_and_growing_seeds(spark):
    from folioframe.plans.registry import queries

    d = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {(r.source_id, r.target_id) for r in queries()["h5_relations_of_catalogue"](spark, d).collect()}
    assert got >= {(a, b) for a in lang for b in lang if a != b and lang[a] == lang[b]}
    old = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{d}/customer.parquet").collect()}
    new = {r.s_suppkey * 20: r.s_name for r in spark.read.parquet(f"{d}/supplier.parquet").collect()}
    assert {r.id: r.name for r in queries()["a15_seed_partners"](spark, d).collect()} == new | old and new.keys() & old.keys() != set()


def test_entities(spark):
    df = spark.createDataFrame([(1, "cán bộ cán bộ 12/KH 12/kh quyết", "Kế hoạch", "12/KH", "Ban", None, None)], "doc_id long, text string, document_type string, document_number string, issuing_agency string, signer string, field string")
    got = {(r.entity_type, r.entity_value): r.weight for r in K.entities(df).collect()}
    assert got["document_number", "12/KH"] == 10 and got["field", "Tổ chức"] == 7 and got["reference_number", "12/KH"] == 5
    assert got["keyword", "cán"] == 3.0 and ("person", None) not in got
    nodes, edges = K.graph(df.withColumn("title", F.lit("t")), spark.createDataFrame([(1, 2, "related", 1.0, 1.0)], "source_id long, target_id long, relation_type string, weight double, confidence double"))
    assert nodes.count() == 1 and edges.columns == ["source", "target", "type", "weight", "confidence"]


def test_vectors(spark):
    import hashlib

    texts = {1: "một hai hai", 2: "", 3: "ba"}
    got = {r.chunk_id: r.vector for r in V.hash_embedding(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"), size=16).collect()}
    for k, t in texts.items():
        v = [0.0] * 16
        for w in t.split():
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 16] += 1 if h[4] % 2 == 0 else -1
        n = sum(x * x for x in v) ** 0.5
        assert got[k] == pytest.approx([round(x / n, 8) if n else x for x in v])
    chunks = spark.createDataFrame([(1, "c1", "x y"), (2, "c1", "x y"), (3, "c2", "z")], "id long, source_checksum string, text string")
    none = spark.createDataFrame([], "key string, vector array<double>")
    out, fresh = V.embedded(chunks, none)
    assert fresh.count() == 2 and out.where("vector IS NULL").count() == 0
    assert V.embedded(chunks, fresh)[1].count() == 0
    two = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    assert two.select(V.similarity(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_authority_and_validity(spark):
    rows = [("Bộ Chính trị", "", "central"), ("Ban Xây dựng Đảng", "", "internal"), ("Đảng ủy xã", "", "party_committee"), ("", "Quyết định", "normative"), ("Sở", "", "known_agency"), (None, None, "unknown")]
    df = spark.createDataFrame(rows, "a string, t string, want string")
    assert all(r[0] == r[1] for r in df.select(M.authority_level(F.col("a"), F.col("t")), "want").collect())
    cases = [("2024-01-01", None, None, "valid"), ("2024-01-01", None, "2024-02-01", "expired"), ("2024-01-01", "2025-01-01", None, "pending"), (None, None, None, "unknown"), ("2026-02-30", None, None, "pending")]
    df = spark.createDataFrame(cases, "i string, e string, x string, want string")
    assert all(r[0] == r[1] for r in df.select(M.validity(F.col("i"), F.col("e"), F.col("x"), F.lit("2024-06-30")), "want").collect())


def test_requests(spark):
    req = spark.createDataFrame([(1, "Soạn công văn đề nghị phối hợp triển khai, kính gửi"), (2, "giúp tôi"), (3, None)], "request_id long, request_text string")
    got = {r.request_id: (r.document_type, r.confidence, r.requires_user_selection) for r in D.classified(req).collect()}
    assert got == {1: ("Cong van", 0.98, False), 2: (None, 0.0, True), 3: (None, 0.0, True)}


def test_review_replay(spark):
    log = [(1, 1, "approve_outline"), (1, 2, "generate_draft"), (1, 3, "export"), (1, 4, "approve_draft"), (1, 5, "save_review"), (1, 6, "approve_draft"), (1, 7, "export"), (2, 1, "generate_draft")]
    got = {r.result_id: (r.status, r.n_refused) for r in D.replayed(spark.createDataFrame(log, "result_id long, seq long, action string")).collect()}
    assert got == {1: ("exported", 1), 2: ("pending_outline_review", 1)}


def test_review_replay_gathers_no_log(spark):
    r = random.Random(5)
    acts = [a for _, a, _ in R.REVIEW_STEPS] + ["unknown", None]
    log = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(4000)]), r.choice(acts)) for _ in range(8000)]
    df = spark.createDataFrame(log, "result_id long, seq long, action string").repartition(7)
    steps, want = {(s, a): t for s, a, t in R.REVIEW_STEPS}, {}
    for key, _, act in sorted(log, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "")):
        state, n = want.get(key, ("pending_outline_review", 0))
        want[key] = (steps.get((state, act), state), n + ((state, act) not in steps))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = D.replayed(df)
        assert {x.result_id: (x.status, x.n_refused) for x in out.collect()} == want
        assert dict(out.dtypes) == {"result_id": "bigint", "status": "string", "n_refused": "int"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rangepartitioning" in out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(seq" not in plan


def test_json_metadata(spark):
    df = spark.createDataFrame([('{"summary": "s"}',), ("{bad",), ("[1]",), (None,)], "j string")
    assert [r[0].summary for r in df.select(C.parsed_metadata(F.col("j"))).collect()] == ["s", None, None, None]


def test_decoding_in_one_projection(spark):
    from folioframe.sources.files import decoded

    rows = [("a.txt", "txt", "đồng é".encode()), ("b.txt", "txt", "café".encode("cp1252")), ("c.png", "png", b"\x89\xff"), ("d.txt", "txt", b""), ("e.txt", "txt", None), ("f.txt", "txt", "\ufeffx".encode())]
    got = {x.file_name: tuple(x.read) for x in decoded(spark.createDataFrame(rows, "file_name string, file_ext string, content binary")).collect()}
    assert got["a.txt"] == ("đồng é", "utf-8", "read", None) and got["d.txt"] == ("", "utf-8", "read", None) and got["f.txt"] == ("\ufeffx", "utf-8", "read", None)
    assert got["b.txt"][0] == "café" and got["b.txt"][1] in ("cp1258", "cp1252") and got["b.txt"][2] == "read"
    assert got["c.png"] == (None, None, "unsupported", None) and got["e.txt"] == (None, None, "failed", "no content")


def test_upsert_of_repeated_keys(spark):
    from folioframe.operators.catalog import upsert

    old = spark.createDataFrame([(1, "a", 0)], "k long, v string, at int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "x", 1), (2, "y", 1)], "k long, v string, at int")
    assert sorted(map(tuple, upsert(old, new, "k", "at").collect())) == [(1, "b", 2), (2, "y", 1)]


def test_a_scan_is_planned_by_sizes_and_reads_no_content_unasked(spark, tmp_path):
    """Spark's own file source cuts a folder into tasks by size, and the listing of a folder opens no file."""
    from folioframe.sources import files as S

    for i in range(12):
        (tmp_path / f"{i}.txt").write_text("x" * 1000)
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1", "spark.sql.sources.binaryFile.maxLength": "10"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        listed = S.scan_folder(spark, str(tmp_path)).select("path", "length", "scan_class")
        assert listed.rdd.getNumPartitions() >= 4 and {(x.length, x.scan_class) for x in listed.collect()} == {(1000, "accepted")}
        with pytest.raises(Exception, match="(?i)length"):  # contents, were they read, would be too long
            S.with_checksum(S.scan_folder(spark, str(tmp_path))).select("checksum").collect()
    finally:
        for name in names:
            spark.conf.unset(name)
