"""Statuses by stream: a failure in mid-batch, late and rejected rows, any cut into batches."""

import pytest
from pyspark.sql import functions as F

from cathlight.streaming import status as S

HOUR = 3_600_000
ROWS = [(1, 1, "a", "start"), (2, 3, "a", "start"), (3, 4, "b", "start"), (4, 2, "a", "fail"), (5, 9, "b", "done"), (6, 30, "a", "start"), (7, 31, None, "start"), (8, 32, "a", "odd"), (9, 33, "b", "fail"), (10, 80, "c", "start"), (11, 5, "c", "done"), (12, 120, "c", "done")]
SCHEMA = "id long, ts timestamp, key string, event string"


def events(spark, folder, cuts):
    """One file a batch, in order."""
    before = 0
    for n, end in enumerate([*cuts, len(ROWS)]):
        rows = [(i, h * 3600, k, e) for i, h, k, e in ROWS[before:end]]
        df = spark.createDataFrame(rows, "id long, s long, key string, event string").select("id", F.timestamp_seconds("s").alias("ts"), "key", "event")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{n:02d}")
        before = end
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, folder, cuts, after=lambda batch: None, attempts=1, made=None):
    stream = made or events(spark, f"{folder}/in", cuts)
    status = F.when(F.col("event") == "start", "in_progress").when(F.col("event") == "done", "completed").when(F.col("event") == "fail", "error")
    late = S.write_by_batch(S.transitions(stream, "key", "ts", "id", status, 10 * HOUR, "8 hours"), f"{folder}/out", f"{folder}/check", after)
    read = lambda kind: sorted((tuple(r) for r in S.status_table(spark, f"{folder}/out", kind).collect()), key=str)
    return read("changed"), read("rejected"), late


# c's row of hour 5 is late once hour 80 was seen in an earlier batch; its row of hour 120 has not passed the watermark
CHANGED = sorted([("a", HOUR, "in_progress", 1), ("a", 2 * HOUR, "error", 1), ("a", 3 * HOUR, "in_progress", 2), ("a", 13 * HOUR, "stalled", 2), ("a", 30 * HOUR, "in_progress", 3), ("a", 40 * HOUR, "stalled", 3), ("b", 4 * HOUR, "in_progress", 1), ("b", 9 * HOUR, "completed", 1), ("b", 33 * HOUR, "error", 1), ("c", 80 * HOUR, "in_progress", 1), ("c", 90 * HOUR, "stalled", 1)], key=str)


@pytest.mark.parametrize("cuts", [[10], [3, 6, 10], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]])
def test_any_cut_gives_the_same_changes(spark, tmp_path, cuts):
    changed, rejected, late = run(spark, str(tmp_path), cuts)
    assert changed == CHANGED and late == 1
    assert {(k, at) for k, at, *_ in rejected} == {(None, 31 * HOUR), ("a", 32 * HOUR)}


def test_a_failure_in_mid_batch_changes_nothing(spark, tmp_path):
    stream, broken = events(spark, f"{tmp_path}/in", [3, 6, 10]), []

    def fail(batch):
        if batch == 1 and not broken:
            broken.append(batch)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, str(tmp_path), None, fail, made=stream)
    changed, rejected, _ = run(spark, str(tmp_path), None, made=stream)
    assert broken and changed == CHANGED and len(rejected) == 2


class Store:
    """A key's state and timers in memory, counting the calls a state server would answer."""

    def __init__(self):
        self.calls, self.timers, self.value, self.items = 0, set(), None, {}

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def counted(self):
        self.calls += 1

    def registerTimer(self, at):
        self.counted()
        self.timers.add(at)

    def exists(self):
        self.counted()
        return self.value is not None

    def update(self, value):
        self.counted()
        self.value = value

    def get(self):
        self.counted()
        return self.value

    def updateValue(self, place, value):
        self.counted()
        self.items[place] = value

    def removeKey(self, place):
        self.counted()
        del self.items[place]

    def iterator(self):
        self.counted()
        return iter(list(self.items.items()))


class Listed(Store):
    """The waiting events, apart from the status."""

    def __init__(self, calls):
        super().__init__()
        self.of, self.rows = calls, []

    def counted(self):
        self.of.calls += 1

    def appendList(self, rows):
        self.counted()
        self.rows += rows

    def put(self, rows):
        self.counted()
        self.rows = list(rows)

    def clear(self):
        self.counted()
        self.rows = []

    def get(self):
        self.counted()
        return iter(list(self.rows))


def test_a_key_of_many_events_calls_its_state_a_few_times_a_batch():
    from types import SimpleNamespace

    store = Store()
    waiting = Listed(store)
    store.getListState = lambda *_: waiting
    machine, got, seen = S.Machine(10), [], []
    machine.init(store)
    events = [(at, tie, ("in_progress", "completed", "error")[(at + tie) % 3]) for at in range(0, 4000, 7) for tie in (0, 1)]
    batches, mark = [events[1::2] + events[0::4], events[2::4] + [(2100, 0, "error"), (2100, 0, "completed")]], 0
    for mark, batch in [(0, batches[0]), (2000, []), (2000, [r for r in batches[1] if r[0] >= 2000]), (5000, [])]:
        before, times = store.calls, SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        seen += batch
        if batch:
            assert not list(machine.handleInputRows(("k",), iter([SimpleNamespace(at=a, tie=t, status=s) for a, t, s in batch]), times))
        while any(t <= mark for t in store.timers):
            store.timers.remove(min(store.timers))
            got += [tuple(r) for r in machine.handleExpiredTimer(("k",), times, None)]
        assert store.calls - before < 20
    want, status, last, attempts = [], None, 0, 0
    for (at, _), new in sorted({(a, t): s for a, t, s in seen}.items()):
        if status == "in_progress" and at - last > 10:
            want.append(("k", last + 10, status := "stalled", attempts))
        if new != status:
            attempts += new == "in_progress"
            want.append(("k", at, new, attempts))
        status, last = new, at
    want += [("k", last + 10, "stalled", attempts)] if status == "in_progress" else []
    assert got == want
