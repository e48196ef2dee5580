"""The registered text search takes every row of its query set."""

from folioframe.plans import registry
from folioframe.plans.task_queries import table


def test_text_search_answers_rows_of_every_role(spark):
    d = "/root/testdata/sf0.001"
    rows = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "role").where("id % 100 = 0").collect()
    assert {x.role for x in rows} > {"user"}
    hits = registry.queries()["h12_text_search"](spark, d).collect()
    assert sorted((x.query_id, x["rank"]) for x in hits) == sorted((x.id, k) for x in rows for k in range(1, 6))
