"""Task analytics: filtered lists, statistics, KPI per person, timelines, promotion of suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.rules import ALL, DOING, DONE, PENDING, WAITING
from folioframe.functions.text import ascii_like

DISPLAY_COLUMNS = ["id", "title", "work_code", "assigned_to", "deadline", "priority", "status", "progress", "workspace_name", "field", "point"]
#: Rows and characters (as JSON) up to which a dimension is sent to all executors; larger ones are shuffled.
DIMENSION_ROWS, DIMENSION_CHARS = 200_000, 64_000_000


def dimension(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where a look at its rows shows that it is small."""
    seen = df.limit(DIMENSION_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("chars")).first()
    return F.broadcast(df) if seen["n"] <= DIMENSION_ROWS and seen["chars"] <= DIMENSION_CHARS else df


def with_dimensions(tasks: DataFrame, staff: DataFrame, work_codes: DataFrame, workspaces: DataFrame) -> DataFrame:
    """tasks with assigned_to, work_code, work_name and workspace_name; missing ones stay null."""
    return (
        tasks.join(dimension(staff.select(F.col("id").alias("assigned_to_id"), F.col("full_name").alias("assigned_to"))), "assigned_to_id", "left")
        .join(dimension(work_codes.select(F.col("id").alias("work_code_id"), F.col("code").alias("work_code"), F.col("task_name").alias("work_name"))), "work_code_id", "left")
        .join(dimension(workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))), "workspace_id", "left")
    )


def search(tasks: DataFrame, status: str | None = None, assigned_to_id: int | None = None, field: str | None = None, workspace_id: int | None = None, keyword: str | None = None) -> DataFrame:
    """Filters that are given; the value for "all" and empty ones are none."""
    for name, value in (("status", status), ("field", field), ("assigned_to_id", assigned_to_id), ("workspace_id", workspace_id)):
        if value and value != ALL:
            tasks = tasks.where(F.col(name) == value)
    if keyword:
        hit = F.lit(False)
        for name in ("title", "description", "related_document", "workspace_name"):
            hit = hit | ascii_like(F.col(name), F.lit(f"%{keyword}%"))
        tasks = tasks.where(hit)
    return tasks


def by_deadline(tasks: DataFrame) -> DataFrame:
    """Earliest deadline first, none last, newest first among equals."""
    return tasks.orderBy(F.asc_nulls_last("deadline"), F.desc("id"))


def attention(tasks: DataFrame, n: int = 10) -> DataFrame:
    """The n open tasks that are due first."""
    return by_deadline(tasks.where(F.col("status") != DONE)).limit(positive(n))


def positive(n: int) -> int:
    if n <= 0:
        raise ValueError("a limit must be positive")
    return n


def displayed(tasks: DataFrame) -> DataFrame:
    return tasks.select(*[c for c in DISPLAY_COLUMNS if c in tasks.columns])


def _sum_if(condition: Column, value=1) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def overdue(as_of: Column) -> Column:
    return (F.col("deadline") < as_of) & (F.col("status") != DONE)


def statistics(tasks: DataFrame, as_of: Column) -> DataFrame:
    """One row: total, per status, overdue, due within three days, mean progress. Sums over nothing are null."""
    soon = F.col("deadline").between(as_of, F.date_add(as_of, 3)) & (F.col("status") != DONE)
    return tasks.agg(
        F.count(F.lit(1)).alias("total"), *(_sum_if(F.col("status") == s).alias(n) for n, s in (("pending", PENDING), ("doing", DOING), ("waiting", WAITING), ("done", DONE))),
        _sum_if(overdue(as_of)).alias("overdue"), _sum_if(soon).alias("due_soon"), F.round(F.avg("progress"), 1).alias("avg_progress"),
    )


def kpi(staff: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """Counts, points and mean progress per person; a person without tasks has zeros.

    Tasks are summed per person before they meet the staff, so a person with a third of all
    tasks is one partial sum per partition.
    """
    point, progress = F.coalesce("point", F.lit(0.0)), F.coalesce("progress", F.lit(0))
    done = F.col("status") == DONE
    sums = tasks.groupBy(F.col("assigned_to_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_tasks"), _sum_if(done).alias("completed_tasks"), _sum_if(overdue(as_of)).alias("overdue_tasks"),
        F.sum(F.when(done, point).otherwise(0.0)).alias("cp"), F.sum(point).alias("ap"), F.avg(progress).alias("pr"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return staff.join(sums, "id", "left").select(
        *staff.columns, *(zero(F.col(c)).alias(c) for c in ("total_tasks", "completed_tasks", "overdue_tasks")),
        F.round(F.coalesce("cp", F.lit(0.0)), 2).alias("completed_points"), F.round(F.coalesce("ap", F.lit(0.0)), 2).alias("assigned_points"), F.round(F.coalesce("pr", F.lit(0.0)), 1).alias("avg_progress"),
    )


def kpi_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("completed_points"), F.desc("total_tasks"), "full_name")


def updates_of(updates: DataFrame, tasks: DataFrame, staff: DataFrame) -> DataFrame:
    """Updates with their task's title and its person's name; updates without a task are left out."""
    named = updates.join(tasks.select(F.col("id").alias("task_id"), F.col("title").alias("task_title"), "assigned_to_id"), "task_id")
    return named.join(dimension(staff.select(F.col("id").alias("assigned_to_id"), F.col("full_name").alias("assigned_to"))), "assigned_to_id", "left")


def files_of(files: DataFrame, tasks: DataFrame) -> DataFrame:
    return files.join(tasks.select(F.col("id").alias("task_id"), F.col("title").alias("task_title")), "task_id")


def newest(df: DataFrame, *columns: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(*(F.desc(c) for c in columns))
    return out.limit(positive(n)) if n is not None else out


def task_point(point: Column, coefficient: Column) -> Column:
    """point x coefficient; no point is 0, no coefficient or 0 is 1."""
    return F.coalesce(point, F.lit(0.0)) * F.coalesce(F.nullif(coefficient, F.lit(0.0)), F.lit(1.0))


def status_after(status: Column, progress: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.when(progress >= 100, DONE).otherwise(DOING))


def is_done(status: Column, progress: Column) -> Column:
    return F.coalesce((status == DONE) | (progress >= 100), F.lit(False))


def promoted(suggestions: DataFrame, work_codes: DataFrame, staff: DataFrame, tasks: DataFrame) -> DataFrame:
    """New tasks from pending suggestions that name a known code and person and are not promoted yet."""
    codes = work_codes.select(F.col("code").alias("suggested_code"), F.col("id").alias("work_code_id"), "point", "coefficient")
    people = staff.select(F.col("full_name").alias("suggested_assignee"), F.col("id").alias("assigned_to_id"))
    open_ = suggestions.where("status = 'pending'").join(tasks.select(F.col("suggestion_id").alias("id")), "id", "left_anti")
    return open_.join(dimension(codes), "suggested_code").join(dimension(people), "suggested_assignee").select(
        F.col("id").alias("suggestion_id"), F.col("suggested_title").alias("title"), "work_code_id", "assigned_to_id",
        F.lit(PENDING).alias("status"), F.lit(0).alias("progress"), task_point(F.col("point"), F.col("coefficient")).alias("point"),
    )


def rejected(tasks: DataFrame) -> DataFrame:
    """tasks with reject_reason, null where the row is valid."""
    reason = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "empty title").when(~F.coalesce("progress", F.lit(0)).between(0, 100), "progress out of range")
    return tasks.withColumn("reject_reason", reason.cast(T.StringType()))


def export_report(parts: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each part to its own folder below one, in place of what is there. `sources.report` has parts that appear together."""
    for name, df in parts.items():
        df.write.mode("overwrite").format(form).option("header", "true").save(f"{folder}/{name}")


def latest_state(updates: DataFrame) -> DataFrame:
    """Per task: last progress and status, the last evidence that is not null; by ts, then update_id. The batch twin of the stream."""
    at = F.struct("ts", "update_id")
    return updates.groupBy("task_id").agg(
        F.max_by("progress", at).alias("progress"), F.max_by(status_after(F.col("status"), F.col("progress")), at).alias("status"),
        F.max_by("evidence_path", F.when(F.col("evidence_path").isNotNull(), at)).alias("evidence_path"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_updates"),
    )
