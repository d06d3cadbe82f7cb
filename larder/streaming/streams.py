"""Continuous forms of sync, deduplication, attempt folding and staleness, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.aggregates import text_docs
from ..operators.backlog import ATTEMPTS
from ..operators.ranking import placed
from ..operators.sync import classify, mark_absent, needs_hash, new_assets
from ..operators.textindex import reindex
from ..sources.catalog import Catalog
from ..sources.shared import settled, shared_folder

_STORE, _DEFAULT = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def ingest(catalog: Catalog, files: DataFrame, stamp: Column, scanned: DataFrame | None = None) -> DataFrame:
    """Merge a listing (path, content_hash, kind, title, mode, root_id, size, mtime) into a catalogue's items, locations and text index.

    Files whose size and time are known keep their item; new contents become items; paths seen are present, and those
    of ``scanned`` roots (id) that are not are absent. Items that are new, or whose files' names may have changed, are
    indexed anew. Only what changes is written, and all of it becomes visible in one commit: a batch that stops leaves
    the catalogue as it was, and of two writers one fails. Returns the files with their status. Merging a listing
    again changes no item and no location but for ``last_seen``.
    """
    change = catalog.begin()
    listing = settled(files.groupBy("path").agg(F.max_by(F.struct("content_hash", "kind", "title", "mode", "root_id", "size", "mtime"), "mtime").alias("x")).select("path", "x.*"))
    asset, location = change.read("asset"), change.read("location")
    to_hash = needs_hash(listing, location)
    known = listing.join(to_hash.select("path"), "path", "left_anti").join(location.select(F.col("abs_path").alias("path"), "asset_id"), "path")
    fresh = settled(new_assets(to_hash, asset, stamp))
    items = asset.select("id", "content_hash").union(fresh.select("id", "content_hash"))
    status = classify(to_hash, asset.select("id", "content_hash"), location)
    hashed = status.drop("asset_id").join(items.select(F.col("content_hash").alias("_h"), F.col("id").alias("asset_id")), F.col("content_hash") == F.col("_h")).drop("_h")
    seen = settled(hashed.select("path", "asset_id", "root_id", "size", "mtime", "status").union(known.select("path", "asset_id", "root_id", "size", "mtime", F.lit("unchanged"))))
    old = location.select("abs_path", F.col("id").alias("_id"), F.col("asset_id").alias("_old"))
    places = settled(seen.select(F.col("path").alias("abs_path"), "asset_id", "root_id", "size", "mtime").join(old, "abs_path", "left").withColumns({"last_seen": stamp, "present": F.lit(True)}))
    last = location.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_last"))  # one row
    added = placed(places.where("_id is null"), F.asc("abs_path"), name="_new").join(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_new"))
    changed = places.where("_id is not null").withColumnRenamed("_id", "id").drop("_old").unionByName(added.drop("_id", "_old", "_new", "_last"))
    if scanned is not None:
        gone = mark_absent(location.join(seen.select(F.col("path").alias("abs_path")), "abs_path", "left_anti").where("present"), stamp, scanned).where("not present")
        changed = changed.unionByName(gone.select(*changed.columns))
    if not change.parts("asset") or fresh.limit(1).count():
        change.put("asset", fresh)
    change.put("location", changed)
    moved = places.where("not _old <=> asset_id")  # a path that is new to its item
    touched = fresh.select("id").union(moved.select("asset_id")).union(moved.where("_old is not null").select("_old")).distinct()
    if moved.limit(1).count():
        touched = settled(touched)
        reindex(change, text_docs(change, touched), touched)
    change.commit()
    return seen.select("path", "asset_id", "status")


def start_ingest(rows: DataFrame, catalog: Catalog, checkpoint: str, scanned: DataFrame | None = None) -> StreamingQuery:
    """``ingest`` each batch of a stream of listings; with ``scanned`` every batch is all that those roots hold.

    Items are known by content and locations by path, so a batch that is replayed after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        ingest(catalog, batch, F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz"), scanned)  # one stamp a batch

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten ``delay`` behind the latest time, so the state is bounded."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _keyed_state(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB, on the workers' disks and in the checkpoint; a session that names no store gets that one."""
    if spark.conf.get(_STORE, _DEFAULT) == _DEFAULT:
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Forgetting(StatefulProcessor):
    """State of a key that ends when its time is due. One timer a key is under way: where it is too early, for rows have come since, it is set anew."""

    fields = ""

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", f"{self.fields}, due long")

    def held(self, *new):
        """What is known of the key, and when it is due (None: no timer is under way)."""
        return self.state.get() if self.state.exists() else (*new, None)

    def keep(self, *values, due: int, before: int | None) -> None:
        self.state.update((*values, due))
        if before is None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *values, due = self.state.get()
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
            return
        self.state.clear()
        yield from self.ended(key, *values)

    def ended(self, key, *values) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


class _Fold(_Forgetting):
    fields = "attempts long, last string, seen long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        attempts, last, seen, due = self.held(0, "", 0)
        newest = 0
        for r in sorted(rows, key=lambda r: (r["_us"], r["seq"])):
            seen, newest = seen + 1, r["_us"]
            if r["outcome"] == "requeue":
                attempts, last = 0, ""
            elif r["outcome"] in ("success", "failure"):
                attempts, last = attempts + (r["outcome"] == "failure"), r["outcome"]
        self.keep(attempts, last, seen, due=max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + self.hold, before=due)
        now = "done" if last == "success" else "failed" if attempts >= ATTEMPTS else "pending"
        yield Row(key=key[0], state=now, attempts=attempts, seen=seen)


class _Watch(_Forgetting):
    fields = "seen long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, due = self.held(0)
        seen = max(seen, max(r["_us"] for r in rows))
        # a key that is overdue already waits for the next advance of the watermark
        self.keep(seen, due=max(seen // 1000 + self.hold, timerValues.getCurrentWatermarkInMs() + 1), before=due)
        return iter(())

    def ended(self, key, seen) -> Iterator[Row]:
        yield Row(key=key[0], last_us=seen)


def _stateful(rows: DataFrame, delay: str, work: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    _keyed_state(rows.sparkSession)
    return rows.withColumn("_us", F.unix_micros("ts")).withWatermark("ts", delay).groupBy("key").transformWithState(work, schema, mode, "EventTime")


def fold_attempts_stream(log: DataFrame, delay: str = "1 hour", keep: str = "90 days") -> DataFrame:
    """State of each key of a stream of attempts (key, ts, seq, outcome) after each batch: key, state, attempts, seen.

    ``seen`` counts the key's rows, so the row with the largest is the latest. Rows later than ``delay`` are dropped. A
    key without attempts for ``keep`` is forgotten (it begins anew), so the state is that of the keys of that time.
    """
    hold, kind = int(pd.Timedelta(keep).total_seconds() * 1000), dict(log.dtypes)["key"]
    return _stateful(log, delay, _Fold(hold), f"key {kind}, state string, attempts long, seen long", "Update")


def absent_stream(rows: DataFrame, keep: str, delay: str) -> DataFrame:
    """(key, last_seen) of keys of a stream (key, ts) that were not seen for ``keep`` before the watermark."""
    hold, kind = int(pd.Timedelta(keep).total_seconds() * 1000), dict(rows.dtypes)["key"]
    return _stateful(rows, delay, _Watch(hold), f"key {kind}, last_us long", "Append").select("key", F.timestamp_micros("last_us").alias("last_seen"))


def drain(rows: DataFrame, spark: SparkSession, mode: str = "append", shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Run a stream over what is there and return all that it emitted, as a table."""
    out = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")
