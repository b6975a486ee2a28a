from datetime import datetime, timedelta

from pyspark.sql import functions as F

from termweave.streaming import jobs as J


def test_late_audit_events_are_dropped(spark, tmp_path):
    start = datetime(2026, 1, 1)
    source = str(tmp_path / "in")
    schema = "ts timestamp, action string"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def deliver(name, minutes):
        rows = [(start + timedelta(minutes=m), "item.scored") for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")
        events = spark.readStream.schema(schema).parquet(f"{source}/*")
        J.stream_audit_counts(events, "10 minutes", "10 minutes", out, state).awaitTermination()

    deliver("a", [1, 2, 31, 45])
    deliver("b", [3, 48, 90])  # minute 3 is behind the watermark (minute 35), 48 is not
    got = {r.window_start.minute: r.events for r in spark.read.parquet(out).collect() if r.window_start.hour == 0}
    assert got == {0: 2, 30: 1, 40: 2}


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    df = spark.range(5)
    J._write_batch(df, 3, str(tmp_path))
    J._write_batch(df, 3, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 5
    written = spark.createDataFrame([("e", 0, 1), ("e", 2, 9), ("f", 1, 4)], "encounter_id string, batch int, accepted int")
    assert {(r.encounter_id, r.accepted) for r in J.latest_states(written.withColumn("x", F.lit(1))).collect()} == {("e", 9), ("f", 4)}


def review_events(spark, rows):
    """(encounter, minute, item, seq, kind, code) as review events of an encounter with two coded items."""
    start = datetime(2026, 1, 1)
    full = [(e, start + timedelta(minutes=m), i, s, k, c, True, True, 2) for e, m, i, s, k, c in rows]
    return spark.createDataFrame(full, "encounter_id string, at timestamp, item_id long, seq long, kind string, code string, is_billable boolean, coded boolean, needed long")


def test_review_events_are_replayed_in_order_whatever_batch_they_come_in(spark, tmp_path):
    one = [("a", 1, 1, 1, "scored", "X"), ("a", 2, 2, 2, "scored", None), ("a", 3, 2, 3, "approve", None), ("a", 4, 2, 4, "override", "Y"),
           ("a", 5, None, 5, "encounter.approve", None), ("a", 6, 1, 6, "approve", None), ("a", 7, None, 7, "encounter.approve", None), ("a", 8, 1, 8, "remove", None)]
    # the override before its scoring, the approval before what it waits for, the same events of b in one go
    deliveries = [[one[3], one[6]], [one[7], one[1], one[4]], [one[0], one[5], one[2]] + [("b", m, i, s, k, c) for _, m, i, s, k, c in one[:4]],
                  [("", 10_000, None, -1, J.CLOCK, None)], [("a", 1, 1, 9, "remove", None), ("b", 10_001, 1, 10, "approve", None), ("", 30_000, None, -2, J.CLOCK, None)]]
    out, state, source = (str(tmp_path / n) for n in ("out", "state", "in"))
    states = []
    for k, rows in enumerate(deliveries):
        events = review_events(spark, rows)
        events.coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{source}/*")
        J.stream_review_state(stream, out, state, "1 hour", retention_ms=86_400_000).awaitTermination()
        seen = spark.read.schema(J.OUTPUT + ", batch int").parquet(out)
        states.append({r.encounter_id: (r.closed_at, r.accepted, r.refused, r.resolved, r.needed) for r in J.latest_states(seen).collect()})
    # nothing is judged before the watermark has passed it
    assert states[:3] == [{}, {}, {}]
    # refused: the approval of an item without a code, the early closing, the removal after the closing
    assert states[3] == {"a": (7, 5, 3, 2, 2), "b": (-1, 3, 1, 1, 2)}
    # an event far behind the watermark is dropped; b goes on from its state
    assert states[4] == {"a": (7, 5, 3, 2, 2), "b": (-1, 4, 1, 2, 2)}


def test_every_document_is_in_one_sink_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    start, path = datetime(2026, 1, 1), str(tmp_path / "out")

    def document(name, note="note"):
        return f'{{"encounter_id": "{name}", "patient_id": "p", "soap_note": "{note}", "conditions": [{{"text": "pain"}}]}}'

    def batch(*rows):
        return spark.createDataFrame([(v, start + timedelta(minutes=m)) for v, m in rows], "value string, received_at timestamp")

    first = batch((document("a"), 3), (document("a", "earlier"), 1), (document("b"), 1), (document("b"), 1), ("no json", 2), (document(""), 2), (None, 4))
    second = batch((document("a"), 9), (document("c"), 9), (document("s"), 9))
    stored = spark.createDataFrame([("s",)], "encounter_id string")

    def state():
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        taken = sorted((r.encounter_id, r.received_at, r.batch) for r in read("accepted").collect())
        return taken, sorted((str(r.value), r.reasons[0], r.batch) for r in read("quarantine").collect()), sorted((r.encounter_id, r.text) for r in read("items").collect())

    J.take_in(first, 0, path, J.C.flatten_items, stored)
    J.take_in(second, 1, path, J.C.flatten_items, stored)
    taken, refused, items = state()
    assert [(e, b) for e, _, b in taken] == [("a", 0), ("b", 0), ("c", 1)] and taken[0][1] == start + timedelta(minutes=1)
    assert len(taken) + len(refused) == first.count() + second.count()
    assert [r for _, r, _ in refused].count("repeated") == 2 and [r for _, r, _ in refused].count("already stored") == 2
    assert items == [("a", "pain"), ("b", "pain"), ("c", "pain")]
    for again in ((first, 0), (second, 1)):
        J.take_in(*again, path, J.C.flatten_items, stored)
        assert state() == (taken, refused, items)


class _Kept:
    """A state variable of one key that counts the calls."""

    def __init__(self, calls, value=None):
        self.calls, self.value, self.map = calls, value, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "exists":
                return self.value is not None
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            if name == "containsKey":
                return args[0] in self.map
            if name == "getValue":
                return self.map[args[0]]
            if name == "updateValue":
                self.map[args[0]] = args[1]
            if name == "clear":
                self.map, self.value = {}, None

        return call


def test_a_new_encounter_asks_the_state_for_no_items():
    state, calls, item_calls = J.ReviewState(1000), [], []
    state.handle, state.counts, state.items = _Kept(calls), _Kept(calls), _Kept(item_calls)
    event = lambda seq, item, kind: J._Waiting(seq, seq, item, kind, "A1" if kind == "scored" else None, True, True, 3)
    state._replayed(("e",), [event(k, str(k), "scored") for k in range(3)])
    assert item_calls == ["updateValue"] * 3
    state._replayed(("e",), [event(9, "0", "approve"), event(10, "1", "approve")])  # an open one finds what it has kept
    assert state.counts.value == (-1, 5, 0, 2, 3, -1) and item_calls[3:].count("containsKey") == 2
    state._replayed(("e",), [event(11, "2", "approve"), event(12, None, J.RV.APPROVAL), event(13, "1", "remove")])
    assert state.counts.value == (12, 7, 1, 3, 3, 1012) and item_calls[-1] == "clear" and not state.items.map
    asked = len(item_calls)
    state._replayed(("e",), [event(14, "1", "remove")])
    assert state.counts.value[2] == 2 and len(item_calls) == asked


class _Store:
    """A list and a map state of one key that count the calls."""

    def __init__(self):
        self.calls, self.list, self.map, self.timers = 0, [], {}, []

    def _called(self, value=None):
        self.calls += 1
        return value

    def getListState(self, *_):
        return self

    getMapState = getListState

    def registerTimer(self, at):
        self._called(self.timers.append(at))

    def appendValue(self, value):
        self._called(self.list.append(value))

    def put(self, values):
        self.list = self._called(list(values))

    def get(self):
        return self._called(iter(self.list))

    def clear(self):
        self.list = self._called([])

    def iterator(self):
        return self._called(iter(list(self.map.items())))

    def updateValue(self, key, value):
        self._called(self.map.update({key: value}))

    def removeKey(self, key):
        self._called(self.map.pop(key))


class _Time:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_bucket_of_encounters_makes_few_calls_into_the_state(spark):
    """F2. Calls do not grow with the events: one an encounter; others wait, and closed ones leave."""
    rows = [(f"e{n}", 1 + i, i, i, "scored", "A1") for n in range(50) for i in range(20)]
    rows += [("e0", 30 + i, i, 30 + i, "approve", None) for i in range(2)] + [("e0", 40, None, 99, J.RV.APPROVAL, None), ("e7", 60, 1, 60, "approve", None)]
    events = review_events(spark, rows).withColumn("item_id", F.col("item_id").cast("string"))
    # an encounter of two items is closed, one has an event that waits
    events = events.where("encounter_id <> 'e0' OR kind <> 'scored' OR seq < 2")
    frame = events.select(F.unix_millis("at").alias("ms"), J._event().alias("event")).toPandas()
    state, store = J.ReviewState(1000), _Store()
    state.init(store)
    start = int(frame["ms"].min()) - 60_000
    list(state.handleInputRows((0,), iter([frame[:300], frame[300:]]), None))
    assert store.calls == 2 and store.timers == [start + 60_000]
    until = _Time(start + 50 * 60_000)
    out = list(state.handleExpiredTimer((0,), until, until))
    got = {r.encounter_id: (r.closed_at, r.accepted, r.refused, r.resolved) for r in out[0].itertuples()}
    assert got["e0"] == (99, 5, 0, 2) and got["e7"] == (-1, 20, 0, 0) and len(got) == 50
    assert store.calls <= 50 + 8 and len(store.list) == 1 and len(store.map) == 50
    assert store.timers[-1] == start + 40 * 60_000 + 1000  # the closed one leaves first
    later = _Time(start + 70 * 60_000)
    out = list(state.handleExpiredTimer((0,), later, later))
    assert [(r.encounter_id, r.accepted, r.resolved) for r in out[0].itertuples()] == [("e7", 21, 1)]
    assert len(store.map) == 49 and not store.list
