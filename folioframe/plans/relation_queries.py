"""Relations of documents, factorised by classes, and each source's best ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import knowledge as K
from folioframe.plans.document_queries import _RELATIONS, ALL_PAIRS, ENTITIES, _entities, _typed
from folioframe.plans.registry import query

_CLASSES = f"""{ENTITIES},
  doc AS (
    SELECT doc_id, CASE lang WHEN 'en' THEN 'Báo cáo' WHEN 'fr' THEN 'Kế hoạch' WHEN 'de' THEN 'Quyết định' ELSE 'Công văn' END AS t, source AS f,
           CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 4 END AS r
    FROM documents
  ),
  val AS (SELECT DISTINCT doc_id, lower(entity_value) AS v FROM e WHERE entity_value <> ''),
  known AS (SELECT DISTINCT lower(entity_value) AS v FROM e WHERE entity_type IN ('document_type', 'agency', 'person', 'field') AND entity_value <> ''),
  signed AS (SELECT doc_id, list_sort(list(v)) AS vals FROM val JOIN known USING (v) GROUP BY doc_id),
  own AS (SELECT doc_id, t, f, r, coalesce(vals, []) AS vals FROM doc LEFT JOIN signed USING (doc_id)),
  class AS (SELECT t, f, r, vals, count(*) AS n FROM own GROUP BY t, f, r, vals)"""


def _classes(spark, d):
    return K.relation_classes(_typed(spark, d).select("doc_id", "document_type", F.col("source").alias("field")), _entities(spark, d))


@query("h1_relation_classes", f"""WITH {_CLASSES},
  p AS (
    SELECT x.t AS s_type, x.f AS s_field, x.vals AS s_values, y.t AS t_type, y.f AS t_field, y.vals AS t_values, x.r AS sr, y.r AS tr, len(list_intersect(x.vals, y.vals)) AS shared,
           x.n * (y.n - (x.t = y.t AND x.f = y.f AND x.vals = y.vals)::INT) AS n_pairs
    FROM class x, class y
  ),
  k AS (
    SELECT *, CASE WHEN shared = 0 AND s_field <> t_field THEN NULL WHEN s_type = 'Báo cáo' AND t_type IN ('Kế hoạch', 'Công văn') THEN 'reports'
      WHEN s_type IN ('Công văn', 'Kế hoạch') AND t_type IN ('Quy định', 'Quyết định') THEN 'implements' WHEN sr > tr THEN 'follows' WHEN shared > 0 THEN 'related' END AS relation_type
    FROM p
  )
  SELECT s_type, s_field, array_to_string(s_values, '|') AS s_values, t_type, t_field, array_to_string(t_values, '|') AS t_values, shared, relation_type, n_pairs FROM k WHERE relation_type IS NOT NULL AND n_pairs > 0""")  # fmt: skip
def _(spark, d):
    f = _classes(spark, d)
    of = lambda c: f.classes.select(F.col("class").alias(c), F.col("document_type").alias(f"{c}_type"), F.col("field").alias(f"{c}_field"), F.array_join("values", "|").alias(f"{c}_values"))
    return f.pairs.drop("values").join(of("s"), "s").join(of("t"), "t").drop("s", "t")


@query("h1_class_members", f"WITH {_CLASSES} SELECT doc_id, t AS document_type, f AS field, array_to_string(vals, '|') AS class_values, n AS n_documents FROM own JOIN class USING (t, f, r, vals)")
def _(spark, d):
    f = _classes(spark, d)
    sizes = f.classes.select("class", F.array_join("values", "|").alias("class_values"), "n_documents")
    return f.members.join(sizes, "class").drop("class")


@query("h1_postings", f"""WITH {_CLASSES}, rest AS (SELECT doc_id, v FROM val WHERE v NOT IN (SELECT v FROM known))
  SELECT doc_id, v, n_documents FROM rest JOIN (SELECT v, count(*) AS n_documents FROM rest GROUP BY v HAVING count(*) > 1) USING (v)""")
def _(spark, d):
    return _classes(spark, d).postings


@query("h1_top_relations", f"""SELECT * FROM (WITH {ALL_PAIRS}, {_RELATIONS}) WHERE source_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, relation_type) <= 10""")
def _(spark, d):
    """Ten relations each of every hundredth document, against all."""
    f = _classes(spark, d)
    out = K.top_relations(f, f.members.where("doc_id % 100 = 0").select("doc_id"), 10)
    return out.drop("rank").withColumn("confidence", F.round("confidence", 6))
