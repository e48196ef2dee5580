"""Ordered lists of the stored tables: filters that are given, a fixed order, a limit where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.tasks import positive


def listed(df: DataFrame, *order: Column, limit: int | None = None, **given) -> DataFrame:
    """Rows that equal the values given (None and empty ones filter nothing), in order; limit None is all of them."""
    for name, value in given.items():
        if value is not None and value != "":
            df = df.where(F.col(name) == value)
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(positive(limit))


def templates(df: DataFrame, status: str | None = None, document_type: str | None = None) -> DataFrame:
    return listed(df, F.desc("created_at"), F.desc("id"), status=status, document_type=document_type)


def drafts(df: DataFrame, status: str | None = None) -> DataFrame:
    return listed(df, F.desc("updated_at"), F.desc("id"), status=status)


def draft_requests(df: DataFrame, status: str | None = None, limit: int | None = 100) -> DataFrame:
    return listed(df, F.desc("updated_at"), F.desc("id"), limit=limit, status=status)


def draft_results(df: DataFrame, status: str | None = None, limit: int | None = 100) -> DataFrame:
    return listed(df, F.desc("updated_at"), F.desc("id"), limit=limit, status=status)


def citations(df: DataFrame, request_id: int | None = None, result_id: int | None = None, citation_type: str | None = None) -> DataFrame:
    """Best score first; 0 is no id."""
    return listed(df, F.desc("score"), F.asc("id"), request_id=request_id or None, result_id=result_id or None, citation_type=citation_type)


def suggestions(df: DataFrame, status: str | None = None) -> DataFrame:
    return listed(df, F.desc("created_at"), F.desc("id"), status=status)


def chunks(df: DataFrame, document_id: int | None = None) -> DataFrame:
    return listed(df, F.asc("document_id"), F.asc("chunk_order"), F.asc("id"), document_id=document_id or None)


def entities(df: DataFrame, document_id: int | None = None) -> DataFrame:
    order = [F.desc("weight"), F.asc("entity_type"), F.asc("entity_value")] if document_id else [F.desc("weight"), F.asc("entity_value")]
    return listed(df, *order, document_id=document_id or None)


def keywords(df: DataFrame, document_id: int | None = None) -> DataFrame:
    return listed(df, F.desc("weight"), F.asc("keyword"), document_id=document_id or None)


def sections(df: DataFrame, template_id: int | None = None) -> DataFrame:
    return listed(df, F.asc("template_id"), F.asc("section_order"), F.asc("id"), template_id=template_id or None)


def children(parents: DataFrame, df: DataFrame, key: str, columns: list[str], *order: Column, name: str = "children") -> DataFrame:
    """parents with an array of their rows of df, in order, empty where there are none: a list per parent for a whole table of parents.

    order is part of each element, so that the sort is by it; df is reduced to one row per parent before it meets them.
    """
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    each = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), F.struct(*columns).alias("row")))).alias("rows"))
    each = each.select(key, F.transform("rows", lambda x: x["row"]).alias(name))
    out = parents.join(each, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))


def citation_metadata(df: DataFrame, query_text: str | None = None, limit: int | None = 50) -> DataFrame:
    return listed(df, F.desc("score"), F.desc("id"), limit=limit, query_text=query_text)


def active_work_codes(df: DataFrame) -> DataFrame:
    return listed(df, F.asc("axis"), F.asc("code"), active=1)


def kpi_rules(df: DataFrame) -> DataFrame:
    return listed(df, F.desc("point"))


def staff(df: DataFrame) -> DataFrame:
    return listed(df, F.asc("id"))


def workspaces(df: DataFrame) -> DataFrame:
    return listed(df, F.desc("updated_at"), F.desc("id"))
