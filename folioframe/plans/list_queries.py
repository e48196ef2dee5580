"""Ordered lists and validation over the driver's tables: orders are templates, drafts, results and suggestions, lines are citations and sections, parts are work codes and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import catalog as C
from folioframe.operators import lists as L
from folioframe.operators import validation as V
from folioframe.plans.document_queries import CAT, catalogue
from folioframe.plans.registry import query
from folioframe.plans.task_queries import table

ORDERS = "o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS document_type, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders)"


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("document_type"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


LINES = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS request_id, l_suppkey AS result_id, l_returnflag AS citation_type, l_quantity AS score, l_linestatus AS query_text, l_linenumber AS section_order FROM lineitem)"


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("result_id"), F.col("l_returnflag").alias("citation_type"),
        F.col("l_quantity").alias("score"), F.col("l_linestatus").alias("query_text"), F.col("l_linenumber").alias("section_order"),
    )


@query("b6_templates", f"WITH {ORDERS} SELECT id, created_at FROM o WHERE status = 'F' AND document_type = '1-URGENT'")
def _(spark, d):
    return L.templates(_orders(spark, d), "F", "1-URGENT").select("id", "created_at")


@query("b7_drafts", f"WITH {ORDERS} SELECT id, status FROM o WHERE status = 'P'")
def _(spark, d):
    return L.drafts(_orders(spark, d), "P").select("id", "status")


@query("b8_results", f"WITH {ORDERS} SELECT id, updated_at FROM o WHERE status = 'O' ORDER BY updated_at DESC, id DESC LIMIT 100")
def _(spark, d):
    return L.draft_results(_orders(spark, d), "O").select("id", "updated_at")


@query("b9_citations", f"WITH {LINES} SELECT id, score FROM l WHERE result_id = 7 AND citation_type = 'R'")
def _(spark, d):
    return L.citations(_lines(spark, d), result_id=7, citation_type="R").select("id", "score")


@query("b11_suggestions", f"WITH {ORDERS} SELECT id, created_at FROM o WHERE status = 'P'")
def _(spark, d):
    return L.suggestions(_orders(spark, d), "P").select("id", "created_at")


@query("b12_child_lists", "SELECT o_orderkey AS id, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_quantity DESC, l_linenumber), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10 GROUP BY 1")
def _(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    rows = table(spark, d, "lineitem").where("l_quantity > 10").withColumnRenamed("l_orderkey", "id")
    out = L.children(parents, rows, "id", ["l_linenumber"], -F.col("l_quantity"), F.col("l_linenumber"))
    return out.select("id", F.array_join(F.transform("children", lambda x: x["l_linenumber"].cast("string")), ",").alias("children"))


@query("b14_citation_metadata", f"WITH {LINES} SELECT id, score FROM l WHERE query_text = 'O' ORDER BY score DESC, id DESC LIMIT 50")
def _(spark, d):
    return L.citation_metadata(_lines(spark, d), "O").select("id", "score")


@query("b15_active_codes", "SELECT p_partkey AS id, p_brand AS axis, p_name AS code FROM part WHERE p_size > 25")
def _(spark, d):
    codes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("axis"), F.col("p_name").alias("code"), (F.col("p_size") > 25).cast("int").alias("active"))
    return L.active_work_codes(codes).drop("active")


_FILES = f"""WITH {CAT}, f AS (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 11 = 0 THEN ' ' ELSE file_name END AS file_name, CASE WHEN id % 13 = 0 THEN NULL ELSE file_path END AS file_path, CASE WHEN id % 17 = 0 THEN -1 ELSE n_chars END AS file_size, CASE WHEN id % 19 = 0 THEN '' ELSE checksum END AS checksum,
  CASE WHEN id % 23 = 0 THEN 'lost' WHEN id % 3 = 0 THEN '' ELSE status END AS status FROM cat)"""


@query("b20_rejected_documents", f"""{_FILES} SELECT id, CASE WHEN trim(title) = '' THEN trim(file_name) ELSE trim(title) END AS title, CASE WHEN status = '' THEN 'new' ELSE status END AS status, CASE WHEN trim(file_name) = '' THEN 'file_name is required' WHEN file_path IS NULL THEN 'file_path is required'
  WHEN file_size < 0 THEN 'file_size is negative' WHEN checksum = '' THEN 'checksum is required' WHEN status = 'lost' THEN 'unknown status' END AS reject_reason FROM f""")
def _(spark, d):
    every = lambda n, value, c: F.when(F.col("id") % n == 0, value).otherwise(F.col(c)).alias(c)
    c = catalogue(spark, d).select(
        "id", every(7, "", "title"), every(11, " ", "file_name"), every(13, None, "file_path"), "file_ext", F.when(F.col("id") % 17 == 0, -1).otherwise(F.col("n_chars")).alias("file_size"), every(19, "", "checksum"),
        F.when(F.col("id") % 23 == 0, "lost").when(F.col("id") % 3 == 0, "").otherwise(F.col("status")).alias("status"),
    )
    return V.library_documents(c).select("id", "title", "status", "reject_reason")


@query("b20_rejected_relations", "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey - 5 <= 0 THEN 'source_id is not positive' WHEN l_suppkey - 5 <= 0 THEN 'target_id is not positive' WHEN l_partkey = l_suppkey THEN 'a document is related to itself' END AS reject_reason FROM lineitem")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") - 5).alias("source_id"), (F.col("l_suppkey") - 5).alias("target_id"), F.lit("related").alias("relation_type"))
    return V.relations(r).select("id", "n", "reject_reason")


@query("b20_rejected_uploads", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'unsupported extension' WHEN p_size < 10 THEN 'empty file' WHEN p_size > 45 THEN 'file too large' END AS reject_reason FROM part")
def _(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".doc", ".DOCX", ".pdf"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    size = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") > 45, 50 * 1024 * 1024 + 1).otherwise(F.col("p_size"))
    return V.uploads(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", ext).alias("file_name"), size.cast("long").alias("length"))).select("id", "reject_reason")


@query("c5_inner_titles", "SELECT l_orderkey AS source_id, l_partkey AS target_id, a.p_name AS source_title, b.p_name AS target_title FROM lineitem JOIN part a ON a.p_partkey = l_orderkey JOIN part b ON b.p_partkey = l_partkey")
def _(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return C.titled_relations(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")), docs, "inner")


@query("f19_embedding_keys", "SELECT doc_id, sha256('v1:hash:128:' || source || ':' || sha256(text)) AS key FROM documents")
def _(spark, d):
    from folioframe.functions import text as X

    return table(spark, d, "documents").select("doc_id", X.embedding_key("v1:hash:128", F.col("source"), F.col("text")).alias("key"))
