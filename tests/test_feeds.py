"""Change feeds: any dealing of rows over batches tells the same, what is kept is bounded, and a stream goes on from a snapshot."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.streaming import events as E
from tidemill.streaming import feeds as D

MS = 1000
KEEP, BEAT = 50 * MS, 20 * MS


class _List:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Value:
    value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    """States and timers of one key, in memory."""

    def __init__(self):
        self.timers, self.lists, self.now = set(), {}, 0

    def getListState(self, name, schema):
        return self.lists.setdefault(name, _List())

    def getValueState(self, name, schema):
        return _Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def run(batches, delay_ms, end_ms=None):
    """What a feed tells of batches of (at, id, item, status, terminal), and the most rows that it kept at a time."""
    feed, handle, out, most, seen = D.Feed(KEEP, BEAT), _Handle(), [], 0, 0
    feed.init(handle)

    def wake():
        for at in sorted(t for t in handle.timers if t <= handle.now):
            handle.timers.discard(at)
            for part in feed.handleExpiredTimer((1,), handle, None):
                out.extend(tuple(None if pd.isna(v) else v for v in r) for r in part.itertuples(index=False))

    for batch in [*batches, None]:
        if batch:
            frame = pd.DataFrame(batch, columns=["at", "id", "item", "status", "terminal"])
            for part in feed.handleInputRows((1,), iter([frame]), handle):
                out.extend(tuple(None if pd.isna(v) else v for v in r) for r in part.itertuples(index=False))
            seen = max(seen, *(r[0] // MS for r in batch))
        handle.now = max(handle.now, seen - delay_ms if batch or end_ms is None else end_ms)
        wake()
        wake()
        most = max(most, sum(len(x.rows) for x in handle.lists.values()))
    return sorted(out, key=repr), most, feed


def plain(rows, upto):
    """The rules one row after another."""
    out, began = [], None
    rows = sorted(r for r in rows if r[0] <= upto)

    def close(until, fin):
        for k in range(1, 10_000):
            at = began + k * BEAT
            if at > until or (fin is not None and at >= fin):
                break
            out.append((1, "heartbeat", at, None, None, None))

    for at, id_, item, status, terminal in rows:
        if began is not None and at - last > KEEP:
            close(last + KEEP, fin)
            began = None
        if began is None:
            began, fin, told = at, None, set()
        last = at
        if fin is not None:
            continue
        if (item, status) not in told:
            told.add((item, status))
            out.append((1, "change", at, id_, item, status))
        if terminal:
            fin = at
            out.append((1, "end", at, id_, None, status))
    if began is not None:
        close(min(upto, last + KEEP), fin)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_any_dealing_tells_the_same(seed):
    r = random.Random(seed)
    at, rows = 1000 * MS, []
    for i in range(150):
        at += r.choice([0, 1, 3, 9, 20, 60]) * MS + r.randint(0, 999)
        rows.append((at, i, r.choice("abc") if r.random() > 0.02 else None, r.choice(["run", "done"]), r.random() < 0.06))
    delay = 300
    end = rows[-1][0] // MS - delay
    want = plain(rows, end * MS)
    assert run([rows], delay)[0] == want
    # Rows out of order by less than the delay, in batches of any size.
    late = sorted(rows, key=lambda x: x[0] + r.randint(0, delay - 1) * MS)
    batches, k = [], 0
    while k < len(late):
        n = r.randint(1, 9)
        batches.append(late[k:k + n])
        k += n
    got, most, _ = run(batches, delay)
    assert got == want and most < 150


def test_state_stays_small_and_goes():
    rows = [(t * 5 * MS, t, f"i{t % 3}", "run", False) for t in range(20_000)]
    got, most, feed = run([rows[k:k + 10] for k in range(0, len(rows), 10)], 10)
    assert most <= 20 and sum(x[1] == "change" for x in got) == 3
    got, most, feed = run([rows[:50]], 10, end_ms=10**9)
    assert not feed.open.exists() and not feed.told.rows and not feed.pending.rows


def test_an_ended_feed_keeps_no_pairs():
    rows = [(1000 * MS, 1, "a", "run", False), (1010 * MS, 2, "a", "done", True), *((1010 * MS + i * MS, 2 + i, "b", "run", False) for i in range(1, 40))]
    got, _, feed = run([rows], 0)
    assert [x[1] for x in sorted(got, key=lambda x: x[2])].count("end") == 1 and not any(x[4] == "b" for x in got)
    assert feed.told.rows == [] and feed.open.get()[3] is True


def test_stream_over_many_batches_goes_on_from_a_snapshot(spark, tmp_path):
    r = random.Random(3)
    rows, at = [], 1_700_000_000_000_000
    for i in range(400):
        at += r.randint(0, 4_000_000)
        rows.append((at, r.randint(1, 4), i, r.choice("ab"), r.choice(["run", "done"]), r.random() < 0.02))
    schema = "at bigint, workflow bigint, id bigint, item string, status string, terminal boolean"
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")).drop("at")
    cut = rows[150][0]
    for k in range(5):
        part = table.where((F.unix_micros("ts") >= cut + k * 120_000_000) & (F.unix_micros("ts") < cut + (k + 1) * 120_000_000 + (10**15 if k == 4 else 0)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    known = D.snapshot(table.where(F.unix_micros("ts") < cut), KEEP // MS)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    with D.state_provider(spark):
        told = E.run_once(D.change_feed(stream, "150 seconds", KEEP // MS, BEAT // MS, known))
    told = [x for x in told.collect() if x["kind"] != "heartbeat"]
    upto = rows[-1][0] // MS * MS - 150_000_000
    want = []
    for w in range(1, 5):
        mine = [(a, i, item, status, end) for a, g, i, item, status, end in rows if g == w]
        want += [(w, *x[1:]) for x in plain(mine, upto) if x[1] != "heartbeat" and x[2] >= cut]
    assert sorted(map(repr, (tuple(x) for x in told))) == sorted(map(repr, want))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
