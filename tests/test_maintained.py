"""Maintained aggregates: after every change the state is what a full count gives."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioframe.operators import catalog as C
from folioframe.operators import maintained as M
from folioframe.operators import tasks as T
from folioframe.sources.store import Store, Table

TASK = "id long, assigned_to_id long, status string, deadline date, progress double, point double"
VIEWS = {"by_day": ("tasks", M.BY_DAY), "by_person": ("tasks", M.BY_PERSON), "open": ("tasks", M.OPEN_BY_PERSON), "values": ("tasks", M.filter_values_view(["status", "assigned_to_id"]))}
AS_OF = "2024-03-10"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(r, ids):
    """Tasks with nulls in all columns, and one person who holds a third of them."""
    day = lambda: r.choice([None, *(date(2024, 3, 1) + timedelta(days=i) for i in range(20))])
    return [(i, r.choice([1, 1, 2, 3, 4, None]), r.choice([T.DONE, T.DOING, T.PENDING, None]), day(), r.choice([None, 0.0, 33.3, 100.0]), r.choice([None, 0.1, 0.2, 7.25])) for i in ids]


def test_ten_random_rounds_equal_a_recount(spark, tmp_path):
    r = random.Random(5)
    store = Store(spark, str(tmp_path / "s"), {"tasks": Table("id", TASK, 4)}, VIEWS)
    staff = spark.createDataFrame([(i, f"p{i}") for i in range(1, 7)], "id long, full_name string")
    held = set()
    for _ in range(10):
        change, kind = store.begin(), r.choice(["upsert", "upsert", "delete"])
        if kind == "upsert" or not held:
            ids = r.sample(range(60), 12)
            change.upsert("tasks", spark.createDataFrame(some(r, ids), TASK))
            held |= set(ids)
        else:
            ids = r.sample(sorted(held), min(6, len(held)))
            change.replace("tasks", spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(some(r, ids[:2]), TASK))
            held -= set(ids[2:])
        change.commit()
    tasks = store.read("tasks")
    assert {x.id for x in tasks.collect()} == held
    for name, (_, view) in VIEWS.items():
        assert rows(store.read(name).select(*view.columns)) == rows(M.state(view, tasks)), name
    assert rows(M.statistics_of(store.read("by_day"), F.lit(AS_OF).cast("date"))) == rows(T.statistics(tasks, F.lit(AS_OF).cast("date")))
    assert rows(M.kpi_of(staff, store.read("by_person"), store.read("open"), F.lit(AS_OF).cast("date"))) == rows(T.kpi(staff, tasks, F.lit(AS_OF).cast("date")))
    assert rows(store.read("values").select("name", "value")) == rows(C.filter_values(tasks, ["status", "assigned_to_id"]))
    # All go: no group stays.
    store.begin().replace("tasks", tasks.select("id"), tasks.limit(0)).commit()
    assert all(store.read(name).count() == 0 for name in VIEWS)
    assert rows(M.statistics_of(store.read("by_day"), F.lit(AS_OF).cast("date"))) == rows(T.statistics(tasks.limit(0), F.lit(AS_OF).cast("date")))


def test_a_change_of_some_rows_reads_no_others(spark):
    old = spark.createDataFrame([(1, "new"), (2, "new"), (3, None), (4, "failed")], "id long, status string")
    new = spark.createDataFrame([(2, "indexed"), (5, "new"), (3, None)], "id long, status string")
    gone = spark.createDataFrame([(4,), (9,)], "id long")
    before, after = M.change_rows(old, new, gone, "id")
    assert rows(before) == [(2, "new"), (3, None), (4, "failed")] and rows(after) == [(2, "indexed"), (3, None), (5, "new")]
    view = M.by_column("status")
    change = M.part(view, before, after)
    assert rows(change) == [("failed", -1), ("indexed", 1)]  # new loses one and gains one
    now = M.merged(view, M.state(view, old), change)
    assert rows(now) == rows(M.state(view, C.upsert(old, new, "id").where("id <> 4")))
    assert rows(M.tiles_of(now)) == rows(C.tiles(C.upsert(old, new, "id").where("id <> 4")))
    assert rows(M.merged(view, now, M.part(view, after, before))) == rows(M.state(view, old))  # undone


def test_states_add_up_in_any_order_and_doubles_are_refused(spark):
    r = random.Random(3)
    thirds = [spark.createDataFrame(some(r, range(i * 20, i * 20 + 20)), TASK) for i in range(3)]
    a, b, c = (M.state(M.BY_PERSON, t) for t in thirds)
    whole = rows(M.state(M.BY_PERSON, thirds[0].union(thirds[1]).union(thirds[2])))
    assert rows(M.merged(M.BY_PERSON, c, a, b)) == rows(M.merged(M.BY_PERSON, M.merged(M.BY_PERSON, a, b), c)) == whole
    with pytest.raises(TypeError, match="taken back"):
        M.state(M.View({"id": "id"}, {"p": "point"}), thirds[0])
    cents = spark.createDataFrame([(1, Decimal("0.10")), (1, Decimal("0.20"))], "k int, x decimal(5,2)")
    assert rows(M.part(M.View({"k": "k"}, {"x": "x"}), cents, cents)) == []


def test_a_view_that_is_newer_than_its_table(spark, tmp_path):
    tables, view = {"t": Table("k", "k long, status string", 4)}, {"v": ("t", M.by_column("status"))}
    Store(spark, str(tmp_path / "s"), tables).begin().upsert("t", spark.createDataFrame([(i, "a") for i in range(20)], "k long, status string")).commit()
    store = Store(spark, str(tmp_path / "s"), tables, view)
    assert rows(store.read("v")) == []
    store.begin().upsert("t", spark.createDataFrame([(3, "b")], "k long, status string")).commit()
    assert rows(store.read("v").select("status", "n")) == [("a", 19), ("b", 1)]
    # A killed change leaves both as they were; a recount gives the same.
    store.begin().upsert("t", spark.createDataFrame([(4, "b")], "k long, status string"))
    assert rows(store.read("v").select("status", "n")) == [("a", 19), ("b", 1)]
    store.begin().recount("v").commit()
    assert rows(store.read("v").select("status", "n")) == [("a", 19), ("b", 1)]
