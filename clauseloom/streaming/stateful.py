"""Streams with state of their own: file events with a guard, and a decision queue that keeps its history.

Both keep a little state for each key in the state store, so they read each row once and never the rows of earlier batches.
``start`` runs a stream into a Parquet table; the sink's log and the checkpoint make restarts and repeated batches exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import text as X
from ..shared import settings

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Milliseconds of events that wait together.
_HOUR = 3_600_000


class FileGuard(StatefulProcessor):
    """Acts on an event of a file whose content is not that of the last action, and rests for a while after each action.

    Events wait, by the hour, until the watermark has passed their millisecond, so they are judged in the order of their times
    however late they come in. A file has one timer, for its earliest event, which settles all that the watermark has passed.
    """

    def __init__(self, rest_us: int):
        self.rest_us = rest_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("hours", "hour long", "events string")
        self.plan = handle.getValueState("plan", "timer long, hours string")
        self.last = handle.getValueState("last", "hash string, until long, n long")

    def _planned(self) -> tuple[int | None, set[int]]:
        timer, hours = self.plan.get() if self.plan.exists() else (None, "")
        return timer, {int(x) for x in hours.split(",") if x}

    def _plan(self, timer: int, hours: set[int]) -> None:
        self.handle.registerTimer(timer)
        self.plan.update((timer, ",".join(map(str, sorted(hours)))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list[str]] = {}
        first = None
        for r in rows:
            ms = r.us // 1000
            first = ms if first is None else min(first, ms)
            new.setdefault(ms // _HOUR, []).append(f"{r.us} {r.seq} {r.hash}")
        if new:
            timer, hours = self._planned()
            for hour, events in new.items():
                before = [self.waiting.getValue((hour,))[0]] if hour in hours else []
                self.waiting.updateValue((hour,), ("\n".join(before + events),))
            if timer is not None and first + 1 < timer:
                self.handle.deleteTimer(timer)
            self._plan(first + 1 if timer is None else min(timer, first + 1), hours | set(new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        hours, timer = self._planned()[1], None
        seen, until, n = self.last.get() if self.last.exists() else (None, None, 0)
        before = n
        for hour in sorted(hours):
            if hour * _HOUR >= passed:
                timer = hour * _HOUR + 1
                break
            events = [(int(us), int(seq), h) for us, seq, h in (x.split(" ", 2) for x in self.waiting.getValue((hour,))[0].split("\n"))]
            for us, seq, hash_ in sorted(e for e in events if e[0] // 1000 < passed):
                if (until is None or us >= until) and hash_ != seen:
                    seen, until, n = hash_, us + self.rest_us, n + 1
                    yield Row(key=key[0], us=us, seq=seq, hash=hash_, n=n)
            rest = [e for e in events if e[0] // 1000 >= passed]
            if rest:
                self.waiting.updateValue((hour,), ("\n".join(f"{us} {seq} {h}" for us, seq, h in rest),))
                timer = min(rest)[0] // 1000 + 1
                break
            self.waiting.removeKey((hour,))
            hours = hours - {hour}
        if n > before:
            self.last.update((seen, until, n))
        if timer is None:
            self.plan.clear()
        else:
            self._plan(timer, hours)

    def close(self) -> None:
        pass


def guarded_file_events(events: DataFrame, key: str = "path", content: str = "content", at: str = "at", order: str = "event_id", rest_seconds: float = 5, late: str = "1 hour", watched: str = r"(\.py|_prompt\.txt)$") -> DataFrame:
    """(key, at, order, hash, n) of the events to act on, numbered for each file, as a stream.

    Files that do not match ``watched`` and hidden ones are left out. An event is acted on when its content (MD5) is not that of the file's last
    action and the file's rest of ``rest_seconds`` after that action is over; other events change nothing. Events count by time, ties by the
    whole number in ``order``; those later than the watermark of ``late`` are dropped. Repeated events are not acted on again. Rows with a null key, time or order
    are left out, null content is empty.
    """
    path = F.col(key)
    known = events.where(path.rlike(watched) & ~path.rlike(r"(^|/)\.[^/]*$") & F.col(at).isNotNull() & F.col(order).isNotNull())
    time = F.col(at).cast("timestamp")
    rows = known.select(path.alias("key"), time.alias("time"), F.unix_micros(time).alias("us"), F.col(order).cast("long").alias("seq"), F.md5(F.coalesce(F.col(content).cast("string"), F.lit(""))).alias("hash"))
    acted = rows.withWatermark("time", late).groupBy("key").transformWithState(FileGuard(int(rest_seconds * 1_000_000)), "key string, us long, seq long, hash string, n long", "Append", "EventTime")
    return acted.select(F.col("key").alias(key), F.timestamp_micros("us").alias(at), F.col("seq").alias(order), "hash", "n")


class DecisionQueue(StatefulProcessor):
    """For each match the candidate that stands, the newest decision, and every decision once."""

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "version long, present boolean, score double, candidate_us long, decision string, notes string, decided_us long, decided_seq long")
        self.past = handle.getMapState("past", "us long, seq long", "decision string, notes string")
        self.known = handle.getValueState("known", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, present, score, c_us, decision, notes, d_us, d_seq = self.now.get() if self.now.exists() else (0, False, None, None, None, None, None, None)
        n = self.known.get()[0] if self.known.exists() else 0
        before = (present, score, decision, notes, n)
        for r in rows:
            if r.kind == "candidate":
                if c_us is None or r.us >= c_us:
                    present, score, c_us = r.present, r.score, r.us
            elif not self.past.containsKey((r.us, r.seq)):
                self.past.updateValue((r.us, r.seq), (r.decision, r.notes))
                n += 1
                if d_us is None or (r.us, r.seq) > (d_us, d_seq):
                    decision, notes, d_us, d_seq = r.decision, r.notes, r.us, r.seq
        if (present, score, decision, notes, n) == before and version:
            return
        version += 1
        self.now.update((version, present, score, c_us, decision, notes, d_us, d_seq))
        self.known.update((n,))
        yield Row(key=key[0], version=version, present=present, score=score, decision=decision, notes=notes, decided_us=d_us, n=n)

    def close(self) -> None:
        pass


def decision_stream(candidates: DataFrame, decisions: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, version, present, score, decision, notes, decided_at, history) whenever a match changes, as a stream.

    candidates: (key, score, at), and optionally present (false takes a candidate away); the latest by ``at`` stands. decisions: (key, decision, notes, at, seq);
    the latest by (at, seq) holds, however late it comes in, and one that comes in again counts once. history is the number of decisions
    so far. A match without a decision needs review; one whose candidate is gone keeps its decision with present = false. The last version of each
    match (``current``) is what the batch form gives.
    """
    us = F.unix_micros(F.col("at").cast("timestamp")).alias("us")
    there = F.coalesce(F.col("present"), F.lit(True)) if "present" in candidates.columns else F.lit(True)
    c = candidates.select(F.col(key).alias("key"), F.lit("candidate").alias("kind"), us, F.lit(0).cast("long").alias("seq"), there.alias("present"), F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("notes"))
    d = decisions.select(F.col(key).alias("key"), F.lit("decision").alias("kind"), us, F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.lit(None).cast("boolean").alias("present"), F.lit(None).cast("double").alias("score"), X.decision(F.col("decision")).alias("decision"), "notes")
    kind = candidates.schema[key].dataType.simpleString()
    rows = c.unionByName(d).where("key IS NOT NULL AND us IS NOT NULL")
    out = rows.groupBy("key").transformWithState(DecisionQueue(), f"key {kind}, version long, present boolean, score double, decision string, notes string, decided_us long, n long", "Append", "None")
    return out.select(F.col("key").alias(key), "version", "present", "score", F.coalesce("decision", F.lit("Needs Review")).alias("decision"), "notes", F.timestamp_micros("decided_us").alias("decided_at"), F.col("n").alias("history"))


def current(versions: DataFrame, key: str = "match_id") -> DataFrame:
    """The last version of each match."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(key, "s.*")


def start(stream: DataFrame, table: str, checkpoint: str):
    """Runs the stream over all that is there, into the Parquet table; a later call with the same checkpoint goes on where this one ended."""
    spark = stream.sparkSession
    with settings(spark, spark__sql__streaming__stateStore__providerClass=_STORE):
        return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
