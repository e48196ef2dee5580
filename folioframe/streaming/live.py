"""Incremental operators: live task state, review gates, arriving documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from folioframe.functions import rules as R
from folioframe.operators.tasks import DOING, DONE

TASK_STATE = "task_id long, ts timestamp, update_id long, progress double, status string, evidence_path string, n_updates long"


class _TaskState(StatefulProcessor):
    """Last progress and status by (ts, update_id), last evidence that is not null, number of updates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, update_id long, progress double, status string, evidence_path string, e_ts timestamp, e_id long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        ts, uid, progress, status, evidence, e_ts, e_id, n = state if state is not None else (None, None, None, None, None, None, None, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                n += 1
                if ts is None or (r.ts, r.update_id) >= (pd.Timestamp(ts), uid):
                    ts, uid, progress = r.ts, r.update_id, r.progress
                    status = r.status if r.status else (DONE if r.progress is not None and r.progress >= 100 else DOING)
                if r.evidence_path is not None and (e_ts is None or (r.ts, r.update_id) >= (pd.Timestamp(e_ts), e_id)):
                    evidence, e_ts, e_id = r.evidence_path, r.ts, r.update_id
        self.last.update((ts, uid, progress, status, evidence, e_ts, e_id, n))
        yield pd.DataFrame({"task_id": [key[0]], "ts": [ts], "update_id": [uid], "progress": [progress], "status": [status], "evidence_path": [evidence], "n_updates": [n]})

    def close(self) -> None:
        pass


def live_task_state(updates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of updates (update_id, task_id, ts, progress, status, evidence_path) -> each task's state after each batch that touches it. Needs the RocksDB state store; repeated update_ids within the delay count once, rows later than it are dropped."""
    once = updates.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["update_id"])
    return once.groupBy("task_id").transformWithStateInPandas(statefulProcessor=_TaskState(), outputStructType=TASK_STATE, outputMode="Update", timeMode="None")


class _ReviewGate(StatefulProcessor):
    """Actions by seq, replayed in their order after each batch, from the state of those that can no longer be overtaken.

    An action that comes again has its seq already and changes nothing. With event time, a timer
    folds the first actions into the state once the watermark has passed them, and forgets them;
    an action of a seq below those is given back as late.
    """

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, refused int, seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "action string, at long")
        self.steps = {}
        for now, action, then in R.REVIEW_STEPS:
            self.steps.setdefault((now, action), then)

    def _settled(self) -> tuple:
        return tuple(self.settled.get()) if self.settled.exists() else ("pending_outline_review", 0, None)

    def _waiting(self) -> list[tuple]:
        return sorted((key[0], value[0], value[1]) for key, value in self.waiting.iterator())

    def _played(self, status: str, refused: int, actions: list[tuple]) -> tuple[str, int]:
        for _, action, _ in actions:
            then = self.steps.get((status, action))
            status, refused = (then, refused) if then else (status, refused + 1)
        return status, refused

    def _rows(self, key: Any, late: list[int], status: str, refused: int) -> pd.DataFrame:
        out = {"result_id": [key[0]] * (len(late) + 1), "status": [None] * len(late) + [status], "n_refused": pd.array([None] * len(late) + [refused], "Int32")}
        return pd.DataFrame({**out, **({"late_seq": pd.array([*late, None], "Int64")} if self.timed else {})})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, refused, last = self._settled()
        late = []
        for batch in rows:
            for r in batch.itertuples(index=False):
                seq = int(r.seq)
                if last is not None and seq <= last:
                    late.append(seq)
                elif not self.waiting.containsKey((seq,)):
                    at = int(r.at) if self.timed else 0
                    self.waiting.updateValue((seq,), (r.action, at))
                    if self.timed:
                        self.handle.registerTimer(at)
        yield self._rows(key, late, *self._played(status, refused, self._waiting()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, (status, refused, last), done = timerValues.getCurrentWatermarkInMs(), self._settled(), []
        for seq, action, at in self._waiting():
            if at > passed:
                break  # what follows it may still change
            done.append((seq, action, at))
        if done:
            status, refused = self._played(status, refused, done)
            self.settled.update((status, refused, done[-1][0]))
            for seq, _, _ in done:
                self.waiting.removeKey((seq,))
        return iter(())

    def close(self) -> None:
        pass


def review_monitor(actions: DataFrame, delay: str | None = None) -> DataFrame:
    """A stream of actions (result_id, seq, action) -> each result's status and number of refused actions, after each batch that touches it.

    The same as `replayed` over all actions so far, in whatever order and how often they come.
    Without a delay all of a result's actions are kept. With one, actions have a time ts that
    grows with seq: those that the watermark has passed are folded into the state. Rows older than
    the watermark are dropped, as Spark's progress counts them (numRowsDroppedByWatermark); a newer one
    whose seq lies below a folded one is a row of its own with its late_seq and no status. Needs the
    RocksDB store.
    """
    columns = "result_id long, status string, n_refused int"
    if delay is None:
        return actions.groupBy("result_id").transformWithStateInPandas(statefulProcessor=_ReviewGate(False), outputStructType=columns, outputMode="Update", timeMode="None")
    timed = actions.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("result_id").transformWithStateInPandas(statefulProcessor=_ReviewGate(True), outputStructType=f"{columns}, late_seq long", outputMode="Update", timeMode="EventTime")


def activity(updates: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Updates per window and status; works on a stream and on a table alike."""
    return updates.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"), F.avg("progress").alias("avg_progress"))


def _in_batches(stream: DataFrame, index, checkpoint: str):
    return stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CATALOGUE = (
    "id long, file_path string, file_name string, file_ext string, file_size long, checksum string, title string, document_type string, document_number string, issued_date date, "
    "issuing_agency string, signer string, summary string, keywords string, field string, status string"
)


def catalogue_before(spark: SparkSession, folder: str, batch_id: int | None = None) -> DataFrame:
    """The newest version of the catalogue in folder, of those before batch_id; none gives an empty one."""
    hadoop, path = spark.sparkContext._jvm.org.apache.hadoop, None
    root = hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(root):
        done = [p for p in (x.getPath() for x in files.listStatus(root)) if p.getName().startswith("v=") and files.exists(hadoop.fs.Path(p, "_SUCCESS"))]
        versions = {int(p.getName()[2:]): p.toString() for p in done}
        path = max(((v, p) for v, p in versions.items() if batch_id is None or v < batch_id), default=(None, None))[1]
    return spark.read.schema(CATALOGUE).parquet(path) if path else spark.createDataFrame([], CATALOGUE)


def index_arriving_files(spark: SparkSession, root: str, folder: str, checkpoint: str):
    """Starts a stream that indexes files as they arrive below root: each batch makes version v=<batch id> of the catalogue in folder from the one before it.

    A batch that is run again after a failure starts from the same version and overwrites its
    own, so it is idempotent. A copy of a file that is known is a row of status duplicate. Ids
    are hashes of the paths, so they don't depend on how files fall into batches.
    """
    from folioframe.sources import files as S

    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)

    def index(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        found = S.with_checksum(S.classified(batch).where("scan_class = 'accepted'"))
        new, _ = S.index_files(found, catalogue_before(session, folder, batch_id))
        fields = StructType.fromDDL(CATALOGUE)
        rows = new.withColumn("id", F.coalesce("id", F.abs(F.xxhash64("file_path")))).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
        rows.write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    return _in_batches(arriving, index, checkpoint)
