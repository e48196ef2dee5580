"""The report of tasks: five parts as tables of one folder, which appear together or not at all.

An export writes its parts to a folder of its own and is then named by one numbered manifest. A
reader sees the parts of one export, the last or an earlier one; what a failed export has
written is named by none, and `vacuum` deletes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from folioframe.operators import tasks as T
from folioframe.sources.manifests import Manifests

PARTS = ("tasks", "kpi", "timeline", "evidence", "audit")
_FORMS = ("parquet", "csv")


def parts(tasks: DataFrame, staff: DataFrame, updates: DataFrame, files: DataFrame, log: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The five parts: tasks with names, KPI per person, updates and files of tasks, and the log as it is.

    tasks have their dimensions (`tasks.with_dimensions`) and assigned_to_id; log is any table.
    """
    return {"tasks": T.displayed(tasks), "kpi": T.kpi(staff, tasks, as_of), "timeline": T.updates_of(updates, tasks, staff), "evidence": T.files_of(files, tasks), "audit": log}


def export(spark: SparkSession, parts: Mapping[str, DataFrame], folder: str, form: str = "parquet", note: str = "") -> int:
    """Writes the parts and makes them the folder's next report, whose number is returned.

    Each part is written by its own tasks in as many files as it has partitions; a part without
    rows keeps its columns. Raises Conflict where another export was faster.
    """
    if form not in _FORMS:
        raise ValueError(f"a report is {' or '.join(_FORMS)}, not {form}")
    held = Manifests(spark, folder)
    number, place = max(held.versions(), default=0) + 1, f"data/{uuid.uuid4().hex}"
    content = {"form": form, "note": note, "parts": {}}
    for name, df in parts.items():
        path = f"{place}/{name}"
        df.write.format(form).option("header", "true").save(f"{held.folder}/{path}")
        content["parts"][name] = {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
    return held.commit(number, content)


def read(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The parts of the last report, or of one of a number; none where there is no report."""
    held = Manifests(spark, folder)
    number = max(held.versions(), default=0) if number is None else number
    if number == 0:
        return {}
    content = held.read(number)
    reader = lambda schema: spark.read.format(content["form"]).option("header", "true").schema(schema)
    return {name: reader(part["schema"]).load(f"{held.folder}/{part['path']}") for name, part in content["parts"].items()}


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Deletes all reports but the last `keep`, and what failed exports have left; returns how many folders. Not while others write."""
    held = Manifests(spark, folder)
    kept = held.versions()[-T.positive(keep) :]
    named = {part["path"].rsplit("/", 1)[0] for v in kept for part in held.read(v)["parts"].values()}
    for version in set(held.versions()) - set(kept):
        held.delete(version)
    data, gone = held.path("data"), 0
    for export_ in held.files.listStatus(data) if held.files.exists(data) else []:
        if f"data/{export_.getPath().getName()}" not in named:
            gone += bool(held.files.delete(export_.getPath(), True))
    return gone
