"""Streams with state: restart, repeats and late rows give what the whole table gives."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clauseloom.shared import settings
from clauseloom.streaming import incremental as I
from clauseloom.streaming import stateful as S

DAY = datetime(2024, 3, 1)
FILES = "path string, at timestamp, event_id long, content string"


def guarded(rows, rest):
    """The events to act on, one file after the other."""
    state, out = {}, []
    for path, at, seq, content in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen, until, n = state.get(path, (None, None, 0))
        if (until is None or at >= until) and content != seen:
            state[path] = (content, at + timedelta(seconds=rest), n + 1)
            out.append((path, at, seq, n + 1))
    return sorted(out)


def run_files(spark, tmp_path, batches, late="1 hour", rest=5):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(source)
        stream = S.guarded_file_events(spark.readStream.schema(FILES).parquet(source), rest_seconds=rest, late=late)
        S.start(stream, table, str(tmp_path / "cp")).awaitTermination()
    return sorted((r.path, r.at, r.event_id, r.n) for r in spark.read.parquet(table).collect())


def test_file_events_over_restarts_equal_the_whole_table(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["a.py", "b_prompt.txt", "d/c.py"]), DAY + timedelta(milliseconds=rng.randrange(600_000)), i, rng.choice("xyz")) for i in range(400)]
    rows += rows[:40]  # the same events again
    shuffled = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(60)))
    end = [("end.py", DAY + timedelta(days=1), 0, "")]
    got = run_files(spark, tmp_path, [shuffled[:150], shuffled[150:300], shuffled[300:], end])
    assert got == guarded(rows, 5)


def test_file_events_wait_for_the_watermark_and_drop_what_is_later(spark, tmp_path):
    t = lambda s: DAY + timedelta(seconds=s)
    first = [("a.py", t(100), 1, "x"), ("a.py", t(101), 2, "y"), ("a.py", t(106), 3, "x"), ("a.py", t(107), 4, "z"), ("a.log", t(50), 5, "x"), (".a.py", t(50), 6, "x"), ("d/.a.py", t(50), 6, "x"), (None, t(50), 7, "x"), ("b.py", t(108), 8, None)]
    assert run_files(spark, tmp_path, [first], late="10 seconds") == []
    later = [("a.py", t(99), 9, "w"), ("b.py", t(200), 10, "q")]  # within the hour of the first run's watermark
    assert run_files(spark, tmp_path, [later], late="10 seconds") == [("a.py", t(99), 9, 1), ("a.py", t(106), 3, 2), ("b.py", t(108), 8, 1)]
    too_late = [("a.py", t(150), 11, "v"), ("c.py", t(400), 12, "e")]
    got = run_files(spark, tmp_path, [too_late], late="10 seconds")
    assert ("b.py", t(200), 10, 2) in got and not any(r[2] == 11 for r in got)


class _Kept(dict):
    """A state of a key; calls counts what it is asked."""

    calls = 0

    def _asked(f):  # noqa: N805
        def g(self, *args):
            _Kept.calls += 1
            return f(self, *args)

        return g

    exists = _asked(lambda self: bool(self))
    update = _asked(lambda self, v: self.__setitem__(None, v))
    updateValue = _asked(lambda self, k, v: self.__setitem__(k, v))
    getValue = _asked(lambda self, k: self[k])
    containsKey = _asked(lambda self, k: k in self)
    removeKey = _asked(lambda self, k: self.pop(k))
    registerTimer = _asked(lambda self, t: self.__setitem__(t, 1))
    deleteTimer = _asked(lambda self, t: self.pop(t))

    def get(self):
        _Kept.calls += 1
        return self[None]


def test_file_events_ask_the_state_by_the_hour():
    timers, states, _Kept.calls = _Kept(), {}, 0
    timers.getMapState = timers.getValueState = lambda name, *schema: states.setdefault(name, _Kept())
    guard = S.FileGuard(5_000_000)
    guard.init(timers)
    rows = [Row(us=1_700_000_000_000_000 + i * 1_000_000, seq=i, hash="xyz"[i % 3]) for i in range(3000)]
    random.Random(1).shuffle(rows)
    guard.handleInputRows(("a.py",), iter(rows), None)
    end = SimpleNamespace(getCurrentWatermarkInMs=lambda: 1_700_000_000_000 + 2_000_000, getExpiryTimeInMs=lambda: min(timers))
    out = list(guard.handleExpiredTimer(("a.py",), end, end))
    assert [r.seq for r in out] == sorted(r.seq for r in out) and out[0].seq == 0 and all(b.us - a.us >= 5_000_000 for a, b in zip(out, out[1:]))
    assert len(out) == 400 and _Kept.calls < 40


CANDIDATES = "match_id string, score double, at timestamp, present boolean"
DECISIONS = "match_id string, decision string, notes string, at timestamp, seq long"


def test_decisions_over_restarts_equal_the_batch_merge(spark, tmp_path):
    rng = random.Random(3)
    t = lambda s: DAY + timedelta(seconds=s)
    cands = [(f"m{i}", float(i), t(i), True) for i in range(40)] + [(f"m{i}", float(i), t(1000 + i), False) for i in range(5)] + [(f"m{i}", -1.0, t(-5), True) for i in range(10)]
    decs = [(f"m{rng.randrange(60)}", rng.choice(["yes", "n", "later", "Accept"]), f"n{i}", t(rng.randrange(500)), i) for i in range(200)]
    rng.shuffle(cands), rng.shuffle(decs)
    parts = [(cands[:20], decs[:70]), (cands[20:], decs[70:150]), (cands[:10], decs[150:] + decs[:30])]
    table = str(tmp_path / "out")
    for c, d in parts:
        spark.createDataFrame(c, CANDIDATES).write.mode("append").parquet(str(tmp_path / "c"))
        spark.createDataFrame(d, DECISIONS).write.mode("append").parquet(str(tmp_path / "d"))
        stream = S.decision_stream(spark.readStream.schema(CANDIDATES).parquet(str(tmp_path / "c")), spark.readStream.schema(DECISIONS).parquet(str(tmp_path / "d")))
        S.start(stream, table, str(tmp_path / "cp")).awaitTermination()
    got = S.current(spark.read.parquet(table))
    latest = lambda rows, order: {r[0]: r for r in sorted(rows, key=order)}
    c, d = latest(cands, lambda r: r[2]), latest(decs, lambda r: (r[3], r[4]))
    present = spark.createDataFrame([r[:2] for r in c.values() if r[3]], "match_id string, score double")
    queue = spark.createDataFrame([r[:3] for r in d.values()], "match_id string, decision string, notes string")
    expected = {(r.match_id, r.decision, r.notes) for r in I.merge_queue(present, queue).collect()}
    shown = got.where("present OR history > 0").collect()
    assert {(r.match_id, r.decision, r.notes) for r in shown} == expected
    counts = {m: len({(x[3], x[4]) for x in decs if x[0] == m}) for m in d}
    assert {r.match_id: r.history for r in shown if r.history} == counts
    versions = spark.read.parquet(table)
    assert versions.count() == versions.select("match_id", "version").distinct().count()


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path):
    t = lambda s: DAY + timedelta(seconds=s)
    run_files(spark, tmp_path, [[("a.py", t(0), 1, "x"), ("a.py", t(10), 2, "y")]])
    spark.createDataFrame([("a.py", t(20), 3, "z"), ("end.py", t(90_000), 4, "")], FILES).write.mode("append").parquet(str(tmp_path / "in"))
    boom = F.udf(lambda x: 1 // 0, "string")
    broken = spark.readStream.schema(FILES).parquet(str(tmp_path / "in")).withColumn("content", boom("content"))
    with pytest.raises(Exception):
        S.start(S.guarded_file_events(broken), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = run_files(spark, tmp_path, [[("a.py", t(0), 1, "x")]])
    assert [r[2] for r in got] == [1, 2, 3]


def test_settings_are_given_back(spark):
    with settings(spark, spark__sql__shuffle__partitions="3", spark__made__up="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.made.up") == "x"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.made.up", None) is None
