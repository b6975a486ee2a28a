"""Structured Streaming jobs (ST-01..ST-03) over the same operators as the batch.

Every job takes a streaming DataFrame and starts one query; the caller chooses trigger and
checkpoint location. Sinks are idempotent: a repeated micro-batch overwrites its own partition.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from termweave.operators import coding as C
from termweave.operators import review as RV


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """One directory per micro-batch, replaced as a whole when the batch is run again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Ids that the batches before this one have taken."""
    nothing = spark.createDataFrame([], "encounter_id string")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/accepted")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return nothing
    taken = spark.read.schema("encounter_id string, batch long").parquet(f"{path}/accepted")
    return taken.where(F.col("batch") < batch_id).select("encounter_id")


def take_in(batch: DataFrame, batch_id: int, path: str, process: Callable[[DataFrame], DataFrame], stored: DataFrame | None = None) -> None:
    """One micro-batch of documents (value, received_at): every document goes to exactly one of two sinks.

    `accepted` has the valid documents whose id is new, the first of it by (received_at, content); `quarantine` all others
    with their rules, or "already stored" or "repeated". `items` has what `process` makes of the accepted ones. Ids are
    compared with `stored` and with the earlier batches only, and each batch replaces its own folders, so a batch that is
    run again changes nothing.
    """
    spark = batch.sparkSession
    _write_batch(batch.select("value", "received_at", F.monotonically_increasing_id().alias("row")), batch_id, f"{path}/arrived")
    arrived = spark.read.parquet(f"{path}/arrived/batch={batch_id}")
    checked = C.validate_encounters(arrived)
    known = _earlier(spark, path, batch_id)
    known = known if stored is None else known.unionByName(stored.select("encounter_id"))
    order = F.struct("received_at", F.xxhash64("value").alias("content"), "row")
    valid = checked.where(F.size("violations") == 0).select(F.col("e.encounter_id").alias("encounter_id"), "value", "received_at", "row", order.alias("order"))
    judged = C.reject_duplicates(valid, known, "order").drop("order")
    invalid = checked.where(F.size("violations") > 0).select("value", "received_at", "row", F.col("violations").alias("reasons"))
    refused = judged.where("rejected is not null").select("value", "received_at", "row", F.array("rejected").alias("reasons"))
    _write_batch(invalid.unionByName(refused), batch_id, f"{path}/quarantine")
    _write_batch(judged.where("rejected is null").select("encounter_id", "value", "received_at"), batch_id, f"{path}/accepted")
    taken = spark.read.parquet(f"{path}/accepted/batch={batch_id}").select("value", "received_at")
    _write_batch(process(C.accepted(C.validate_encounters(taken))), batch_id, f"{path}/items")


def stream_intake(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame] = C.flatten_items,
    stored: DataFrame | None = None,
) -> StreamingQuery:
    """ST-01: encounter documents (value, received_at) -> `accepted`, `quarantine` and `items` tables below `path`.

    `process` turns the accepted encounters of one micro-batch into the rows to keep; the coding batch fits here as well.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        take_in(batch, batch_id, path, process, stored)

    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_counts(events: DataFrame, watermark: str, window: str) -> DataFrame:
    """ST-02: events per action and tumbling window; later events than the watermark are dropped."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), "action")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "action", "events")
    )


def stream_audit_counts(events: DataFrame, watermark: str, window: str, path: str, checkpoint: str) -> StreamingQuery:
    return (
        audit_counts(events, watermark, window).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


OUTPUT = "encounter_id string, closed_at long, accepted long, refused long, resolved long, needed long"
CLOCK = "clock"
#: Groups of encounters that share a key of the state; a checkpoint keeps to the number it began with.
BUCKETS = 8192
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _refusal(event, item: tuple | None, closed: bool, resolved: int) -> str | None:
    """Why an event does not count; `item` is (assigned code, resolved) of a scored item."""
    if closed:
        return "already approved"
    if event.kind in RV.SCORING:
        return None
    if event.kind == RV.APPROVAL:
        return None if resolved == event.needed else "items still need review"
    if not event.coded:
        return "not coded"
    if item is None:
        return "pending"
    if event.kind == "approve" and not item[0]:
        return "nothing to approve"
    if event.kind == "override":
        if not event.code:
            return "override without code"
        return None if event.is_billable else "not billable"
    return "code without override" if event.code else None


class _Kept:
    """Counts and items of one encounter while it is replayed."""

    def __init__(self):
        self.load(None)

    def load(self, found: tuple | None) -> None:
        self.row, self.known = None, {}
        if found is not None:
            self.row, self.known = tuple(found[:6]), {k: tuple(v) for k, v in json.loads(found[6]).items()}

    def value(self) -> tuple:
        return (*self.row, json.dumps(self.known))


class _Counts:
    """The counts of a `_Kept`, as a value state."""

    def __init__(self, kept: _Kept):
        self.kept = kept

    def exists(self) -> bool:
        return self.kept.row is not None

    def get(self) -> tuple:
        return self.kept.row

    def update(self, row: tuple) -> None:
        self.kept.row = row


class _Items:
    """The items of a `_Kept`, as a map state of (item_id) -> (assigned, resolved)."""

    def __init__(self, kept: _Kept):
        self.kept = kept

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self.kept.known

    def getValue(self, key: tuple) -> tuple:
        return self.kept.known[key[0]]

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.kept.known[key[0]] = value

    def clear(self) -> None:
        self.kept.known = {}


class ReviewState(StatefulProcessor):
    """The encounters of one bucket: events that wait for the watermark, and each encounter's items and counts.

    Events may come in any order within the watermark: they wait in a list until it passes their time and are then
    replayed, per encounter in order of time and seq. A call into the state, and a call for a key, cost far more than an
    event: so the events of a delivery are one element of the list, an encounter's items and counts one entry of a map, and
    encounters share buckets. A closed encounter drops its items at once, refuses what still comes, and leaves the state
    `retention_ms` after it was closed.
    """

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms
        self.kept = _Kept()
        self.counts, self.items = _Counts(self.kept), _Items(self.kept)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.encounters = handle.getMapState(
            "encounters", "name string",
            "closed_at long, accepted long, refused long, resolved long, needed long, leaves_at long, items string",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events, first = [], []
        for frame in rows:
            events += [e for e in frame["event"].tolist() if e is not None]
            first += frame["ms"].tolist()
        if events:
            self.waiting.appendValue((f"[{','.join(events)}]",))
            self.handle.registerTimer(int(min(first)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due, later = defaultdict(list), []
        for delivery in list(self.waiting.get()):
            for event in json.loads(delivery[0]):
                if event["at"] <= until:
                    due[event.pop("name")].append(_Waiting(**event))
                else:
                    later.append(event)
        stored = {json.loads(k[0]): tuple(v) for k, v in list(self.encounters.iterator())}
        if due:
            if later:
                self.waiting.put([(json.dumps(later),)])
            else:
                self.waiting.clear()
        out = []
        for name, events in due.items():
            self.kept.load(stored.get(name))
            out.append(self._replayed((name,), sorted(events)))
            stored[name] = self.kept.value()
            self.encounters.updateValue((json.dumps(name),), stored[name])
        waits = {event["name"] for event in later}
        for name in [n for n, row in stored.items() if n not in due and n not in waits and 0 <= row[5] <= until]:
            self.encounters.removeKey((json.dumps(name),))
            del stored[name]
        # A timer now past fires with the next batch; an encounter with events that wait leaves when they are replayed.
        leaving = [row[5] for name, row in stored.items() if row[5] >= 0 and name not in waits]
        if ahead := [event["at"] for event in later] + leaving:
            self.handle.registerTimer(min(ahead))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _replayed(self, key, due: list) -> tuple:
        # An encounter without counts has no items to look for or remove.
        before = self.counts.get() if self.counts.exists() else None
        closed_at, accepted, refused, resolved, needed, leaves_at = before or (-1, 0, 0, 0, 0, -1)
        stored = before is not None and closed_at < 0
        known: dict[str, tuple | None] = {}
        for event in due:
            needed, name = event.needed, event.item_id
            if name is not None and name not in known:
                known[name] = tuple(self.items.getValue((name,))) if stored and self.items.containsKey((name,)) else None
            item = known.get(name)
            if _refusal(event, item, closed_at >= 0, resolved):
                refused += 1
                continue
            accepted += 1
            if event.kind == RV.APPROVAL:
                closed_at, leaves_at = event.seq, event.at + self.retention_ms
            elif event.kind in RV.SCORING:
                resolved -= bool(item and item[1])
                known[name] = (event.code, False)
            else:
                resolved += not item[1]
                known[name] = (item[0], True)
        if closed_at >= 0:
            if stored:
                self.items.clear()
        else:
            for name, item in known.items():
                if item is not None:
                    self.items.updateValue((name,), item)
        self.counts.update((closed_at, accepted, refused, resolved, needed, leaves_at))
        return key[0], closed_at, accepted, refused, resolved, needed

    def close(self) -> None:
        pass


class _Waiting(NamedTuple):
    at: int
    seq: int
    item_id: str | None
    kind: str
    code: str | None
    is_billable: bool
    coded: bool
    needed: int


def _event() -> Column:
    """An encounter's name and the fields of its `_Waiting` as JSON; none for a row of the clock."""
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_billable", "coded")]
    fields = F.struct(F.col("encounter_id").alias("name"), F.unix_millis("at").alias("at"), "seq", "item_id", "kind", "code", *flags, "needed")
    return F.when(~F.col("kind").eqNullSafe(CLOCK), F.to_json(fields, {"ignoreNullFields": "false"}))


def review_states(events: DataFrame, watermark: str, retention_ms: int = 7 * 86_400_000) -> DataFrame:
    """ST-03: the current review state per encounter (closed_at is -1 while open), sent whenever it changes.

    events: encounter_id, at (event time), item_id, seq, kind, code, is_billable, coded, needed - the batch replay's events
    (through `review.with_dotted_overrides`) joined to the static tables. Events behind the watermark are dropped. A row of
    kind `clock` belongs to no item and only moves the watermark on, as a source without new events would else hold back
    the last ones for ever.
    """
    typed = events.select(
        "encounter_id", "at", F.col("seq").cast("bigint").alias("seq"), F.col("item_id").cast("bigint").cast("string").alias("item_id"),
        "kind", "code", "is_billable", "coded", F.col("needed").cast("bigint").alias("needed"),
    )
    bucket = F.pmod(F.xxhash64("encounter_id"), F.lit(BUCKETS))
    packed = typed.select(bucket.alias("bucket"), "at", F.unix_millis("at").alias("ms"), _event().alias("event"))
    return packed.withWatermark("at", watermark).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ReviewState(retention_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )


def stream_review_state(events: DataFrame, path: str, checkpoint: str, watermark: str, retention_ms: int = 7 * 86_400_000) -> StreamingQuery:
    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, path)

    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)  # the only state store with typed state and timers; a query keeps what it starts with
    try:
        return (
            review_states(events, watermark, retention_ms).writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def latest_states(written: DataFrame) -> DataFrame:
    """The newest state per encounter from the written updates (column `batch` names the micro-batch)."""
    rest = [c for c in written.columns if c not in ("encounter_id", "batch")]
    return written.groupBy("encounter_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("encounter_id", "s.*")
