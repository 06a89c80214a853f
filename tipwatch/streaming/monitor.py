"""Watching running tests by their console: crash, silence, overall timeout.

Live, the decision is a small pure function, ``advance``; Spark keeps its state per run and calls it with each batch and
when a deadline passes, by arrival, so no line is ever late. Before the shuffle every task folds its events to one row
per run, so that a run with very many lines costs the stateful task no more than one with few.

A recorded console is replayed on its own clock, as if watched without pause: the earliest of age, regular stop, crash and
silence ends a run. Every batch folds to facts per run and time slot, in the JVM, and when the recording is read the
facts of all batches together give the verdicts. Facts add up in any order, so late files and one file or many make no
difference; a silence reaches over the end of a slot, so first and last line of each slot are all it takes to find it.
Events without a time or a run say nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tipwatch.functions.text import first_alert_text, is_crash
from tipwatch.session import scratch_path
from tipwatch.streaming.runs import batches, each_batch_once

HANG_MS = 1200 * 1000
TIMEOUT_MS = 3600 * 1000

CONDENSED = (
    "run string, lines long, first_us long, last_us long, stopped boolean,"
    " crash_us long, crash_seq long, crash_message string"
)
FACTS = (
    "run string, slot long, lines long, first_us long, last_us long, line_first_us long, line_last_us long, stop_us long,"
    " crash struct<us:bigint,seq:bigint,message:string>"
)
ALERTS = "run string, status string, message string, at_ms long"
STATE = "status string, start_ms long, last_ms long"


@dataclass(frozen=True)
class Limits:
    hang_ms: int = HANG_MS
    timeout_ms: int = TIMEOUT_MS


@dataclass(frozen=True)
class RunState:
    status: str
    start_ms: int
    last_ms: int

    @property
    def ended(self) -> bool:
        return self.status != "running"

    def deadline(self, limits: Limits) -> int:
        """First moment at which silence or age ends the run."""
        return min(self.last_ms + limits.hang_ms, self.start_ms + limits.timeout_ms) + 1


@dataclass(frozen=True)
class News:
    """What one batch says about one run."""

    lines: int = 0
    stopped: bool = False
    crash: str | None = None


def advance(state: RunState, news: News, now_ms: int, limits: Limits) -> tuple[RunState, str | None]:
    """Next state and, when the run ends, the message. Age comes first, then a regular stop, crash and silence.

    The texts of the messages are fixed.
    """
    if state.ended:
        return state, None
    age = now_ms - state.start_ms
    if age > limits.timeout_ms:
        return replace(state, status="timeout"), f"task wait timeout exceeded after {age // 1000}s"
    if news.stopped:
        return replace(state, status="stopped"), ""
    if news.lines:
        state = replace(state, last_ms=now_ms)
        if news.crash is not None:
            return replace(state, status="crash"), f"kernel crash detected in VM: {news.crash}"
    elif now_ms - state.last_ms > limits.hang_ms:
        return replace(state, status="hang"), f"no VM console output for {limits.hang_ms // 1000}s"
    return state, None


def condense(events: DataFrame) -> DataFrame:
    """Per task and batch, one row per run from ``(run, ts, seq, message, stopped)``."""
    ended = F.coalesce("stopped", F.lit(False))
    marked = events.select(
        "run",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "seq",
        ended.cast("int").alias("stopped"),
        (~ended).cast("int").alias("lines"),
        F.when(is_crash(F.col("message")), first_alert_text(F.col("message"))).alias("crash_message"),
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            groups = batch.groupby("run", sort=False)
            rows = groups[["lines", "stopped"]].sum().join(groups["us"].agg(first_us="min", last_us="max"))
            rows["stopped"] = rows["stopped"] > 0
            hits = batch[batch["crash_message"].notna()].sort_values(["us", "seq"]).drop_duplicates("run").set_index("run")
            rows = rows.join(hits[["us", "seq", "crash_message"]].rename(columns={"us": "crash_us", "seq": "crash_seq"}))
            rows = rows.astype({"crash_us": "Int64", "crash_seq": "Int64"}).reset_index()
            yield rows[[f.split()[0] for f in CONDENSED.split(", ")]]

    return marked.mapInPandas(fold, CONDENSED)


class _Folded:
    """One run's condensed rows taken together; there are a few per task, not one per line."""

    def __init__(self) -> None:
        self.lines, self.stopped = 0, False
        self.first_us: int | None = None
        self.last_us: int | None = None
        self.crash: tuple[int, int, str] | None = None

    def add(self, rows: pd.DataFrame) -> None:
        self.lines += int(rows["lines"].sum())
        self.stopped = self.stopped or bool(rows["stopped"].any())
        low, high = int(rows["first_us"].min()), int(rows["last_us"].max())
        self.first_us = low if self.first_us is None else min(low, self.first_us)
        self.last_us = high if self.last_us is None else max(high, self.last_us)
        for us, seq, message in zip(rows["crash_us"], rows["crash_seq"], rows["crash_message"]):
            if message is not None and (self.crash is None or (us, seq) < self.crash[:2]):
                self.crash = (int(us), int(seq), str(message))

    def news(self) -> News:
        return News(self.lines, self.stopped, self.crash[2] if self.crash else None)


def run_monitor(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Alerts ``(run, status, message, at_ms)`` as lines arrive: one per run when it ends, one ``running`` when first
    seen alive. Silence counts by arrival, which also works when nothing arrives at all. A run that has ended stays so:
    its state, three fields, is kept.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        folded = _Folded()
        if not held.hasTimedOut:
            for batch in batches:
                if not batch.empty:
                    folded.add(batch)
        now = held.getCurrentProcessingTimeMs()
        known = held.exists
        state = RunState(*held.get) if known else RunState("running", now, now)
        if state.ended:
            return
        state, message = advance(state, folded.news(), now, limits)
        held.update((state.status, state.start_ms, state.last_ms))
        if not state.ended:
            held.setTimeoutDuration(max(state.deadline(limits) - now, 1))
        if state.ended or not known:
            yield pd.DataFrame([(key[0], state.status, message or "", now)], columns=["run", "status", "message", "at_ms"])

    return condense(events).groupBy("run").applyInPandasWithState(watch, ALERTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def facts(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """FACTS per run and slot, as long as the silence that counts, of ``(run, ts, seq, message, stopped)``."""
    ended = F.coalesce("stopped", F.lit(False))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    line = F.when(~ended, us)
    crash = F.when(is_crash(F.col("message")), F.struct(us.alias("us"), F.col("seq").cast("long").alias("seq"), first_alert_text(F.col("message")).alias("message")))
    slot = F.floor(us / max(1, limits.hang_ms * 1000)).alias("slot")
    return events.filter("run is not null and ts is not null").groupBy("run", slot).agg(
        F.count_if(~ended).alias("lines"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.min(line).alias("line_first_us"),
        F.max(line).alias("line_last_us"),
        F.min(F.when(ended, us)).alias("stop_us"),
        F.min(crash).alias("crash"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """FACTS of several batches as one row per run and slot."""
    least = [F.min(c).alias(c) for c in ("first_us", "line_first_us", "stop_us", "crash")]
    return rows.groupBy("run", "slot").agg(F.sum("lines").alias("lines"), *least, *[F.max(c).alias(c) for c in ("last_us", "line_last_us")])


def judged(known: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Alerts of whole runs from their merged facts: the earliest ending; of equal moments age, stop, crash, silence.

    The recording ends at the latest event of any run, so that silence and age up to there count too. A deadline is the
    first microsecond beyond it. Slots must be no longer than ``limits.hang_ms``.
    """
    hang, timeout = limits.hang_ms * 1000, limits.timeout_ms * 1000
    end = known.agg(F.max("last_us")).scalar()
    run = Window.partitionBy("run")
    begun = F.min("first_us").over(run)
    heard = F.coalesce(F.max("line_last_us").over(run.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), begun)
    slots = known.withColumn("_heard", heard).withColumn("_gap", F.when(F.col("line_first_us") - F.col("_heard") > hang, F.col("_heard") + hang + 1))
    least = [F.min(c).alias(c) for c in ("first_us", "stop_us", "crash", "_gap")]
    runs = slots.groupBy("run").agg(*least, F.max("line_last_us").alias("_last")).withColumn("_end", end)
    quiet = F.coalesce("_last", "first_us")
    silence = F.coalesce("_gap", F.when(F.col("_end") - quiet > hang, quiet + hang + 1))
    aged = F.when(F.col("_end") - F.col("first_us") > timeout, F.col("first_us") + timeout + 1)
    moments = [(aged, "timeout"), (F.col("stop_us"), "stopped"), (F.col("crash.us"), "crash"), (silence, "hang")]
    endings = F.array(*[F.struct(at.alias("us"), F.lit(turn).alias("turn"), F.lit(status).alias("status")) for turn, (at, status) in enumerate(moments)])
    first = F.array_min(F.filter(endings, lambda e: e["us"].isNotNull()))
    status = F.coalesce("_first.status", F.lit("running"))
    # fixed message texts
    message = (
        F.when(F.col("_first.status") == "timeout", F.lit(f"task wait timeout exceeded after {limits.timeout_ms // 1000}s"))
        .when(F.col("_first.status") == "crash", F.concat(F.lit("kernel crash detected in VM: "), "crash.message"))
        .when(F.col("_first.status") == "hang", F.lit(f"no VM console output for {limits.hang_ms // 1000}s"))
        .otherwise("")
    )
    at = F.floor(F.coalesce("_first.us", "_end") / 1000).alias("at_ms")
    return runs.withColumn("_first", first).select("run", status.alias("status"), message.alias("message"), at)


def replay(spark: SparkSession, events: DataFrame, limits: Limits = Limits(), name: str = "replay") -> DataFrame:
    """Alerts of a recorded stream, read to its end; every file counts, in whatever order the files come."""
    out = scratch_path(spark, name)
    step = lambda batch, _: {"facts": facts(batch, limits)}
    each_batch_once(events, step, out, f"{out}/checkpoint", availableNow=True).awaitTermination()
    return judged(merged(batches(spark, f"{out}/facts", FACTS)), limits)


def final_states(alerts: DataFrame) -> DataFrame:
    """Last known status per run: an ending, else running."""
    ended = F.col("status") != "running"
    last = F.max(F.struct(ended.alias("ended"), "status", "message")).alias("m")
    return alerts.groupBy("run").agg(last).select("run", "m.status", "m.message")


def crash_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'crash'")


def hang_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'hang'")


def run_timeouts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'timeout'")
