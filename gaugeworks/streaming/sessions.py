"""Limits of a session's phases and the standing of late answers, as events stream in and over a whole log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.events import answer_class

#: What an event waits for, and for how many seconds at most.
WAITS = {"env_begin": ("ready", 600), "ingest": ("ingest_ack", 3600), "query": ("answer", 300)}
TIMEOUTS = "env_id string, seq long, phase string, deadline timestamp"


def phase_timeouts(log: DataFrame, until: Column | None = None) -> DataFrame:
    """(env_id, seq, phase, deadline) of requests of a log (env_id, seq, at, type) whose reply did not come in time.

    A request waits for its reply until its limit, the session's end or the next request.  Requests whose limit lies
    after ``until``, the end of the log unless given, are still open and not told.
    """
    marks = [*WAITS, *(reply for reply, _ in WAITS.values()), "env_end"]
    rows = log.where(F.col("type").isin(marks)).select("env_id", "seq", "at", "type")
    end = log.agg((until if until is not None else F.max("at")).alias("__until"))
    reply = F.create_map(*(F.lit(x) for k, (r, _) in WAITS.items() for x in (k, r)))
    limit = F.create_map(*(F.lit(x) for k, (_, s) in WAITS.items() for x in (k, s)))
    order = Window.partitionBy("env_id").orderBy("at", "seq").rowsBetween(1, Window.unboundedFollowing)
    # Only what ends the wait counts: its reply, another request or the end; other replies pass it by.
    ends = lambda kind: F.first(F.when(F.col("type").isin([WAITS[kind][0], *WAITS, "env_end"]), F.col("at")), ignorenulls=True).over(order)
    over = F.coalesce(*(F.when(F.col("type") == kind, ends(kind)) for kind in WAITS))
    asked = rows.withColumn("__over", over).where(F.col("type").isin(list(WAITS))).withColumn("deadline", F.timestamp_seconds(F.unix_micros("at") / 1_000_000 + limit[F.col("type")]))
    late = asked.crossJoin(F.broadcast(end)).where("coalesce(__over > deadline, true) and deadline < __until")  # one row
    return late.select("env_id", "seq", reply[F.col("type")].alias("phase"), "deadline")


class PhaseTimers:
    """The same as events stream in, for ``transformWithStateInPandas``: a timer ends the wait and clears the state.

    The state of an environment is the one request it waits for, in milliseconds of event time.  Its events must come in
    order; those of different environments need not.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "seq long, phase string, deadline long")

    def _clear(self, timed: bool = True) -> None:
        if self.wait.exists():
            if timed:
                self.handle.deleteTimer(self.wait.get()[2])
            self.wait.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        late = []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            now = r.at.value // 1_000_000
            wait = self.wait.get() if self.wait.exists() else None
            if wait and now > wait[2] and (r.type in WAITS or r.type in (wait[1], "env_end")):
                late.append((key[0], wait[0], wait[1], wait[2]))
            if r.type in WAITS:
                self._clear()
                phase, seconds = WAITS[r.type]
                self.wait.update((int(r.seq), phase, now + 1000 * seconds))
                self.handle.registerTimer(now + 1000 * seconds)
            elif wait and r.type in (wait[1], "env_end"):
                self._clear()
        yield _timeouts(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late = []
        if self.wait.exists() and self.wait.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            seq, phase, deadline = self.wait.get()
            late.append((key[0], seq, phase, deadline))
            self._clear(timed=False)
        yield _timeouts(late)

    def close(self) -> None:
        pass


def _timeouts(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["env_id", "seq", "phase", "deadline"])
    out["deadline"] = pd.to_datetime(out["deadline"].astype("int64"), unit="ms")
    return out


def stream_timeouts(log: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``phase_timeouts`` of a streamed log (env_id, seq, at, type) that has no later events of an environment before earlier ones."""
    rows = log.select("env_id", "seq", "at", "type").withWatermark("at", late).groupBy("env_id")
    return rows.transformWithStateInPandas(PhaseTimers(), TIMEOUTS, "Append", "EventTime")


def late_answers(log: DataFrame, keys: list[str], span: str, late: str = "10 seconds") -> DataFrame:
    """Answers (keys, id, at, standing) of a streamed log (keys, id, at, type): orphan, late or on time.

    Rows that are told again within the watermark count once.  Each answer is joined with the queries and timeouts of its
    keys at most ``span`` before it, by an outer join with a time bound, so state is dropped after ``span``, and answers
    without a partner come out once none can come; one row an answer is left, whatever it met.  ``id`` must be
    unique, and times of a key must differ.
    """
    rows = log.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    answers = rows.where("type = 'answer'").select(*keys, "id", "at")
    marks = rows.where("type in ('query', 'timeout')").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("at").alias("__at"), F.col("type").alias("__type"))
    within = (F.col("__at") < F.col("at")) & (F.col("__at") >= F.col("at") - F.expr(f"INTERVAL {span}"))
    met = answers.join(marks, [*(F.col(k) == F.col(f"__{k}") for k in keys), within], "leftOuter")
    seen = lambda kind: F.coalesce(F.bool_or(F.col("__type") == kind), F.lit(False))
    told = met.groupBy(*keys, "id", F.window("at", "1 minute")).agg(F.max("at").alias("at"), answer_class(seen("query"), seen("timeout")).alias("standing"))
    return told.select(*keys, "id", "at", "standing")
