"""Aggregates that follow changes: sums over groups, where a changed row takes back what it gave.

A view's state has one row per group: the values that form it, n (its rows) and exact sums. What
a change does to it is a table of the same columns, made of the touched rows before and after;
states and such parts are added up group by group, in any order, and a group whose rows are all
gone vanishes. Sums are integers or decimals: a double that is taken back leaves a rest, so a
view that sums doubles is refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.operators.catalog import upsert
from folioframe.operators.tasks import DOING, DONE, PENDING, WAITING


class View(NamedTuple):
    """Groups and sums by name, as SQL expressions of a row; rows that don't meet `where` count nowhere.

    Null is a group of its own; null in a sum counts as 0. each: an SQL array of structs of which
    every one is a row of its own, with its fields beside the row's.
    """

    groups: Mapping[str, str]
    sums: Mapping[str, str] = {}
    where: str = "true"
    each: str | None = None

    @property
    def columns(self) -> list[str]:
        return [*self.groups, "n", *self.sums]


def _measured(view: View, rows: DataFrame, sign: int) -> DataFrame:
    rows = rows.select("*", F.inline(F.expr(view.each))) if view.each else rows
    out = rows.where(view.where).select(*(F.expr(e).alias(c) for c, e in view.groups.items()), F.lit(sign).cast("long").alias("n"), *(F.expr(e).alias(c) for c, e in view.sums.items()))
    exact = []
    for name in view.sums:
        kind = out.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            kind = T.DecimalType(38, kind.scale)
        elif isinstance(kind, T.IntegralType):
            kind = T.LongType()
        else:
            raise TypeError(f"{name}: a sum of {kind.simpleString()} can't be taken back exactly; cast it to a decimal")
        exact.append((F.col(name).cast(kind) * F.lit(sign)).cast(kind).alias(name))
    return out.select(*view.groups, "n", *exact)


def merged(view: View, *parts: DataFrame) -> DataFrame:
    """The sum of states and parts of changes; what has neither rows nor sums left is no row."""
    rows = reduce(DataFrame.unionByName, (p.select(*view.columns) for p in parts))
    kinds = {f.name: f.dataType for f in rows.schema}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(kinds[c]).alias(c)
    out = rows.groupBy(*view.groups).agg(*(total(c) for c in view.columns[len(view.groups) :]))
    return out.where(reduce(Column.__or__, (F.col(c) != 0 for c in view.columns[len(view.groups) :])))


def state(view: View, rows: DataFrame) -> DataFrame:
    """The state over whole rows: a full count."""
    return merged(view, _measured(view, rows, 1))


def part(view: View, before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change of rows, from before to after, adds to and takes from a state. Equal rows on both sides cancel out."""
    return merged(view, _measured(view, before, -1), _measured(view, after, 1))


def change_rows(old: DataFrame, new: DataFrame | None, gone: DataFrame | None, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(before, after): the rows that overlaying old by new (as `upsert`) and deleting the keys of gone touch; a key in both is deleted."""
    keys = reduce(DataFrame.unionByName, (x.select(key) for x in (new, gone) if x is not None)).distinct()
    before = old.join(keys, key, "left_semi")
    after = upsert(before, new, key, order) if new is not None else before
    return before, after.join(gone.select(key).distinct(), key, "left_anti") if gone is not None else after


def by_column(column: str) -> View:
    """Rows per value, as `counts_by`."""
    return View({column: column})


def filter_values_view(columns: list[str]) -> View:
    """Rows per (name, value) of several columns: the values that `filter_values` lists, known until their last row goes."""
    pairs = ", ".join(f"struct('{c}' AS name, CAST({c} AS STRING) AS value)" for c in columns)
    return View({"name": "name", "value": "value"}, where="value IS NOT NULL AND value <> ''", each=f"array({pairs})")


def tiles_of(by_status: DataFrame) -> DataFrame:
    """`tiles` from the state by status."""
    n = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0)).cast("long")
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return by_status.agg(total.alias("total"), n("need_review", "indexed").alias("indexed"), n("new").alias("new"), n("failed").alias("failed"), n("duplicate").alias("duplicate"))


#: Tasks by status and deadline: statistics as of any day, without the tasks. Progress with six decimals.
BY_DAY = View({"status": "status", "deadline": "deadline"}, {"progress": "CAST(progress AS DECIMAL(18, 6))", "with_progress": "CAST(progress IS NOT NULL AS INT)"})
#: Tasks by person; points with six decimals.
BY_PERSON = View(
    {"id": "assigned_to_id"},
    {
        "completed": f"CAST(coalesce(status = '{DONE}', false) AS INT)",
        "completed_points": f"CASE WHEN status = '{DONE}' THEN CAST(point AS DECIMAL(18, 6)) END",
        "assigned_points": "CAST(point AS DECIMAL(18, 6))",
        "progress": "CAST(progress AS DECIMAL(18, 6))",
    },
)
#: Open tasks by person and deadline: who is overdue as of any day.
OPEN_BY_PERSON = View({"id": "assigned_to_id", "deadline": "deadline"}, where=f"status <> '{DONE}' AND deadline IS NOT NULL")


def statistics_of(by_day: DataFrame, as_of: Column) -> DataFrame:
    """`statistics` from the state of BY_DAY. Sums over nothing are null, as there."""
    open_ = F.col("status") != DONE
    n = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return by_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), *(n(F.col("status") == s).alias(c) for c, s in (("pending", PENDING), ("doing", DOING), ("waiting", WAITING), ("done", DONE))),
        n((F.col("deadline") < as_of) & open_).alias("overdue"), n(F.col("deadline").between(as_of, F.date_add(as_of, 3)) & open_).alias("due_soon"),
        F.round(F.sum("progress").cast("double") / F.nullif(F.sum("with_progress"), F.lit(0)), 1).alias("avg_progress"),
    )


def kpi_of(staff: DataFrame, by_person: DataFrame, open_by_person: DataFrame, as_of: Column) -> DataFrame:
    """`kpi` from the states of BY_PERSON and OPEN_BY_PERSON."""
    late = open_by_person.where(F.col("deadline") < as_of).groupBy("id").agg(F.sum("n").alias("late"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    tenth = lambda c, digits: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), digits)
    sums = by_person.select("id", "n", "completed", F.col("completed_points").alias("cp"), F.col("assigned_points").alias("ap"), (F.col("progress").cast("double") / F.col("n")).alias("pr"))
    return staff.join(sums, "id", "left").join(late, "id", "left").select(
        *staff.columns, zero("n").alias("total_tasks"), zero("completed").alias("completed_tasks"), zero("late").alias("overdue_tasks"),
        tenth(F.col("cp"), 2).alias("completed_points"), tenth(F.col("ap"), 2).alias("assigned_points"), tenth(F.col("pr"), 1).alias("avg_progress"),
    )
