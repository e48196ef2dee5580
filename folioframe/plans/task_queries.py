"""Task analytics over the driver's tables: customers are staff, orders are tasks, parts are work codes, nations are workspaces, events are updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import maintained as M
from folioframe.operators import tasks as T
from folioframe.plans.registry import query

AS_OF = "1998-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", T.DONE).when(F.col("o_orderstatus") == "P", T.DOING).otherwise(T.PENDING)
    progress = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 50).otherwise(0)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Task "), F.col("o_orderkey")).alias("title"), F.col("o_custkey").alias("assigned_to_id"), F.pmod("o_orderkey", F.lit(500)).alias("work_code_id"),
        F.pmod("o_orderkey", F.lit(30)).alias("workspace_id"), F.col("o_orderpriority").alias("priority"), status.alias("status"), F.to_date("o_orderdate").alias("deadline"), progress.alias("progress"),
        F.col("o_totalprice").alias("point"), F.col("o_orderpriority").alias("field"), F.lit("").alias("description"), F.lit("").alias("related_document"),
    )


def staff(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("field"))


def codes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("C"), F.col("p_partkey")).alias("code"), F.col("p_name").alias("task_name"), F.col("p_retailprice").alias("point"), F.col("p_size").cast("double").alias("coefficient"))


def workspaces(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


def updates(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("update_id"), F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("progress"),
        F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("evidence_path"),
    )


TASKS = """tasks AS (
  SELECT o_orderkey AS id, 'Task ' || o_orderkey AS title, o_custkey AS assigned_to_id, o_orderkey % 500 AS work_code_id, o_orderkey % 30 AS workspace_id, o_orderpriority AS priority,
    CASE o_orderstatus WHEN 'F' THEN 'Hoàn thành' WHEN 'P' THEN 'Đang thực hiện' ELSE 'Chưa thực hiện' END AS status, o_orderdate::DATE AS deadline,
    CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 50 ELSE 0 END AS progress, o_totalprice AS point, o_orderpriority AS field FROM orders
), named AS (
  SELECT t.*, c_name AS assigned_to, 'C' || p_partkey AS work_code, p_name AS work_name, n_name AS workspace_name
  FROM tasks t LEFT JOIN customer ON c_custkey = assigned_to_id LEFT JOIN part ON p_partkey = work_code_id LEFT JOIN nation ON n_nationkey = workspace_id
), updates AS (
  SELECT event_id AS update_id, user_id AS task_id, ts, value AS progress, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS status, CASE WHEN event_type = 'purchase' THEN props END AS evidence_path FROM events
)"""
_NAMED = ["id", "title", "assigned_to", "work_code", "work_name", "workspace_name", "status", "deadline", "progress"]


def named(spark, d):
    return T.with_dimensions(tasks(spark, d), staff(spark, d), codes(spark, d), workspaces(spark, d))


@query("c1_tasks_with_dimensions", f"WITH {TASKS} SELECT {', '.join(_NAMED)} FROM named")
def _(spark, d):
    return named(spark, d).select(*_NAMED)


@query("b4_task_search", f"WITH {TASKS} SELECT {', '.join(_NAMED)} FROM named WHERE status = 'Đang thực hiện' AND field = '5-LOW' AND workspace_name ILIKE '%nation_1%'")
def _(spark, d):
    return T.search(named(spark, d), status=T.DOING, field="5-LOW", keyword="nation_1").select(*_NAMED)


@query("b16_task_display", f"WITH {TASKS} SELECT id, title, work_code, assigned_to, deadline, priority, status, progress, workspace_name, field, point FROM named")
def _(spark, d):
    return T.displayed(named(spark, d))


@query("b17_attention", f"WITH {TASKS} SELECT id, title, deadline, status FROM tasks WHERE status <> 'Hoàn thành' ORDER BY deadline NULLS LAST, id DESC LIMIT 10")
def _(spark, d):
    return T.attention(tasks(spark, d)).select("id", "title", "deadline", "status")


@query("c2_updates_of_tasks", f"WITH {TASKS} SELECT update_id, task_id, title AS task_title, c_name AS assigned_to, updates.progress FROM updates JOIN tasks ON tasks.id = task_id LEFT JOIN customer ON c_custkey = assigned_to_id")
def _(spark, d):
    return T.updates_of(updates(spark, d), tasks(spark, d), staff(spark, d)).select("update_id", "task_id", "task_title", "assigned_to", "progress")


@query("c3_files_of_tasks", f"WITH {TASKS} SELECT l_orderkey AS task_id, l_linenumber AS file_no, l_extendedprice AS file_size, title AS task_title FROM lineitem JOIN tasks ON id = l_orderkey")
def _(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("file_no"), F.col("l_extendedprice").alias("file_size"))
    return T.files_of(files, tasks(spark, d)).select("task_id", "file_no", "file_size", "task_title")


@query("d1_task_statistics", f"""WITH {TASKS} SELECT count(*) AS total, sum((status = 'Chưa thực hiện')::INT) AS pending, sum((status = 'Đang thực hiện')::INT) AS doing, sum((status = 'Chờ duyệt')::INT) AS waiting, sum((status = 'Hoàn thành')::INT) AS done,
  sum((deadline < DATE '{AS_OF}' AND status <> 'Hoàn thành')::INT) AS overdue, sum((deadline BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 3 AND status <> 'Hoàn thành')::INT) AS due_soon, round(avg(progress), 1) AS avg_progress FROM tasks""")
def _(spark, d):
    return T.statistics(tasks(spark, d), F.lit(AS_OF).cast("date"))


@query("d2_kpi_by_staff", f"""WITH {TASKS} SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS field, count(t.id) AS total_tasks, count(*) FILTER (status = 'Hoàn thành') AS completed_tasks, count(*) FILTER (deadline < DATE '{AS_OF}' AND status <> 'Hoàn thành') AS overdue_tasks,
  round(coalesce(sum(CASE WHEN status = 'Hoàn thành' THEN point END), 0), 2) AS completed_points, round(coalesce(sum(point), 0), 2) AS assigned_points, round(coalesce(avg(progress), 0), 1) AS avg_progress FROM customer LEFT JOIN tasks t ON assigned_to_id = c_custkey GROUP BY ALL""")
def _(spark, d):
    return T.kpi(staff(spark, d), tasks(spark, d), F.lit(AS_OF).cast("date"))


@query("e4_update_timeline", f"WITH {TASKS} SELECT update_id, task_id, epoch_us(ts) AS at_us FROM updates ORDER BY ts DESC, update_id DESC LIMIT 200")
def _(spark, d):
    return T.newest(updates(spark, d), "ts", "update_id", n=200).select("update_id", "task_id", F.unix_micros("ts").alias("at_us"))


@query("b19_promoted_suggestions", """WITH s AS (SELECT event_id AS id, 'Suggestion ' || event_id AS title, 'C' || (event_id % 3000) AS code, user_id FROM events WHERE event_type = 'click')
  SELECT s.id AS suggestion_id, s.title, p_partkey AS work_code_id, c_custkey AS assigned_to_id, 'Chưa thực hiện' AS status, 0 AS progress, p_retailprice * coalesce(nullif(p_size::DOUBLE, 0), 1) AS point
  FROM s JOIN part ON 'C' || p_partkey = code JOIN customer ON c_custkey = user_id WHERE s.id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, d):
    e = table(spark, d, "events")
    people = staff(spark, d)
    s = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "pending").otherwise("seen").alias("status"), F.concat(F.lit("Suggestion "), F.col("event_id")).alias("suggested_title"), F.concat(F.lit("C"), F.pmod("event_id", F.lit(3000))).alias("suggested_code"), "user_id")
    s = s.join(people.select(F.col("id").alias("user_id"), F.col("full_name").alias("suggested_assignee")), "user_id")
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("suggestion_id"))
    return T.promoted(s, codes(spark, d), people, done)


@query("b20_task_validation", "SELECT CASE WHEN trim(p_name) = '' THEN 'empty title' WHEN NOT p_size * 4 BETWEEN 0 AND 100 THEN 'progress out of range' END AS reject_reason, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_name").alias("title"), (F.col("p_size") * 4).alias("progress"))
    return T.rejected(t).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("i1_latest_task_state", f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, update_id DESC) AS k, row_number() OVER (PARTITION BY task_id, evidence_path IS NULL ORDER BY ts DESC, update_id DESC) AS e FROM updates)
  SELECT task_id, max(progress) FILTER (k = 1) AS progress, max(CASE WHEN status <> '' THEN status WHEN progress >= 100 THEN 'Hoàn thành' ELSE 'Đang thực hiện' END) FILTER (k = 1) AS status, max(evidence_path) FILTER (e = 1) AS evidence_path, count(*) AS n_updates FROM r GROUP BY task_id""")
def _(spark, d):
    return T.latest_state(updates(spark, d)).drop("ts")


@query("i0_update_activity", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS status, count(*) AS n, round(avg(value), 6) AS avg_progress FROM events GROUP BY ALL")
def _(spark, d):
    from folioframe.streaming.live import activity

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), F.col("value").alias("progress"))
    return activity(e).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "status", "n", F.round("avg_progress", 6).alias("avg_progress"))


@query("a15_seed_dimensions", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 23, r_name FROM region WHERE r_regionkey + 23 NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    from folioframe.operators.catalog import insert_or_ignore

    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return insert_or_ignore(old, table(spark, d, "region").select((F.col("r_regionkey") + 23).alias("id"), F.col("r_name").alias("name")), "id")


@query("a15_seed_partners", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 20, s_name FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    """As a15_seed_dimensions, over tables that grow."""
    from folioframe.operators.catalog import insert_or_ignore

    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return insert_or_ignore(old, table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name")), "id")


# Statistics and KPI that follow a change: old tasks were pending all, newer rows overlay them, some are deleted.
CHANGED = """changed AS (
  SELECT id, assigned_to_id, deadline, point, CASE WHEN deadline < DATE '1995-01-01' THEN 'Chưa thực hiện' ELSE status END AS status,
    CASE WHEN deadline < DATE '1995-01-01' THEN 0 ELSE progress END AS progress
  FROM tasks WHERE NOT (field = '5-LOW' AND status = 'Hoàn thành')
)"""


def _followed(spark, d, *views: M.View) -> list[DataFrame]:
    """Each view's state after the change: the one before, and the change's part in it."""
    now = tasks(spark, d).select("id", "assigned_to_id", "deadline", "point", "status", "progress", "field")
    old = now.where("deadline < DATE'1997-01-01'").withColumns({"status": F.lit(T.PENDING), "progress": F.lit(0)})
    gone = now.where((F.col("field") == "5-LOW") & (F.col("status") == T.DONE)).select("id")
    before, after = M.change_rows(old, now.where("deadline >= DATE'1995-01-01'"), gone, "id")
    return [M.merged(v, M.state(v, old), M.part(v, before, after)) for v in views]


@query("d1_maintained_statistics", f"""WITH {TASKS}, {CHANGED}
  SELECT count(*) AS total, sum((status = 'Chưa thực hiện')::INT) AS pending, sum((status = 'Đang thực hiện')::INT) AS doing,
    sum((status = 'Chờ duyệt')::INT) AS waiting, sum((status = 'Hoàn thành')::INT) AS done,
    sum((deadline < DATE '{AS_OF}' AND status <> 'Hoàn thành')::INT) AS overdue,
    sum((deadline BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 3 AND status <> 'Hoàn thành')::INT) AS due_soon, round(avg(progress), 1) AS avg_progress
  FROM changed""")  # fmt: skip
def _(spark, d):
    return M.statistics_of(_followed(spark, d, M.BY_DAY)[0], F.lit(AS_OF).cast("date"))


@query("d2_maintained_kpi", f"""WITH {TASKS}, {CHANGED}
  SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS field, count(t.id) AS total_tasks, count(*) FILTER (status = 'Hoàn thành') AS completed_tasks,
    count(*) FILTER (deadline < DATE '{AS_OF}' AND status <> 'Hoàn thành') AS overdue_tasks,
    round(coalesce(sum(CASE WHEN status = 'Hoàn thành' THEN point::DECIMAL(18, 6) END), 0)::DOUBLE, 2) AS completed_points,
    round(coalesce(sum(point::DECIMAL(18, 6)), 0)::DOUBLE, 2) AS assigned_points, round(coalesce(avg(progress), 0), 1) AS avg_progress
  FROM customer LEFT JOIN changed t ON assigned_to_id = c_custkey GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    people, open_ = _followed(spark, d, M.BY_PERSON, M.OPEN_BY_PERSON)
    return M.kpi_of(staff(spark, d), people, open_, F.lit(AS_OF).cast("date"))


@query("a16_report_parts", f"""WITH {TASKS}
  SELECT 'tasks' AS part, id, 0 AS no FROM tasks UNION ALL SELECT 'kpi', c_custkey, 0 FROM customer
  UNION ALL SELECT 'timeline', update_id, 0 FROM updates WHERE task_id IN (SELECT id FROM tasks)
  UNION ALL SELECT 'evidence', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT id FROM tasks)
  UNION ALL SELECT 'audit', event_id, 0 FROM events WHERE event_type = 'error'""")  # fmt: skip
def _(spark, d):
    """What each part of the report holds."""
    from folioframe.sources import report

    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("int").alias("no"))
    log = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    parts = report.parts(named(spark, d), staff(spark, d), updates(spark, d), files, log, F.lit(AS_OF).cast("date"))
    key = {"timeline": "update_id", "evidence": "task_id"}
    rows = [p.select(F.lit(n).alias("part"), F.col(key.get(n, "id")).alias("id"), (F.col("no") if n == "evidence" else F.lit(0)).alias("no")) for n, p in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("f25_done_updates", f"WITH {TASKS} SELECT update_id, coalesce(status = 'view' OR progress >= 100, FALSE) AS done FROM updates")
def _(spark, d):
    """Which updates say that their task is done; a view is taken as the word for it."""
    said = F.when(F.col("status") == "view", T.DONE).otherwise(F.col("status"))
    return updates(spark, d).select("update_id", T.is_done(said, F.col("progress")).alias("done"))
