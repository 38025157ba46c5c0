"""Streams: session verdicts and budgets in keyed state variables, and the scan of arriving texts.

A session's state is three variables: the turns it keeps (list), the signals that outlive their turn (map) and its standing (value). Sessions
without turns for an age are stale: a later turn starts a new one, and a timer removes them. Ages go by the clock or, with an event-time column
under a watermark, by the turns' own times. A row of role `reset` clears the state. State is in RocksDB under the stream's checkpoint, so a
stream that starts again goes on from it.

Defined results: a session's turns of a micro-batch go in order of event time and turn, null first; rows without a session id form one session; turns
that repeat count each; rows older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textward.functions.paths import shared_path
from textward.operators import scan, unified
from textward.operators.sessions import BUDGET, BUDGETS, VERDICT, Session, budget_requests, spend

#: Milliseconds after its last turn at which a session is forgotten, and after its first request at which a budget is.
SESSION_AGE, BUDGET_AGE = 3_600_000, 86_400_000
#: A turn of this role asks for its session to be reset.
RESET = "reset"
#: State variables need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionState(StatefulProcessor):
    """Folds each session's turns. kind: the fold's class; take(state, row) gives the values of `columns`."""

    def __init__(self, kind: type[Session], profile: str, take: Callable, columns: list[str], age_ms: int | None, event_time: bool):
        self.kind, self.profile, self.take, self.columns = kind, profile, take, columns
        self.age, self.event_time = age_ms, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn bigint, text string, score double")
        self.signals = handle.getMapState("signals", "name string", "phase string, confidence double, turn bigint")
        self.standing = handle.getValueState("standing", "profile string, count bigint, risk double, locked boolean, seen bigint, last bigint")

    def _clear(self) -> None:
        self.turns.clear()
        self.signals.clear()
        self.standing.clear()
        for timer in list(self.handle.listTimers()) if self.age else ():
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, seen, last = None, 0, None
        if self.standing.exists():
            *status, seen, last = self.standing.get()
            session = self.kind.restored(tuple(status), list(self.turns.get()), {k[0]: tuple(v) for k, v in self.signals.iterator()})
        now = timerValues.getCurrentProcessingTimeInMs() if self.age and not self.event_time else 0
        batch, out = pd.concat(list(rows)), []
        for row in batch.sort_values(["at_ms", "turn"] if self.event_time else ["turn"], kind="stable", na_position="first").itertuples(index=False):
            at = now if not self.event_time else (last or 0) if pd.isna(row.at_ms) else int(row.at_ms)
            if session is not None and self.age and at - last > self.age:
                session = None
            if row.role == RESET:
                session, last = None, None
                continue
            if session is None:
                session, seen = self.kind(self.profile), 0
            seen, last = seen + 1, at
            out.append((row.conv_id, row.turn, *self.take(session, row), seen))
        self._clear()
        if session is not None:
            self.standing.update((*session.status(), seen, last))
            if session.messages:
                self.turns.put([tuple(m) for m in session.messages])
            for name, signal in session.signals.items():
                self.signals.updateValue((name,), signal)
            if self.age:
                self.handle.registerTimer(last + self.age + 1)
        yield pd.DataFrame(out, columns=["conv_id", "turn", *self.columns, "session_turn"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        yield pd.DataFrame(columns=["conv_id", "turn", *self.columns, "session_turn"])

    def close(self) -> None:
        pass


def _by_session(rows: DataFrame):
    """Grouped by a key that is never null."""
    return rows.withColumn("session_key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))).groupBy("session_key")


def _folded(rows: DataFrame, kind: type[Session], profile: str, take: Callable, verdict: str, age_ms: int | None, event_time: str | None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.unix_millis(F.col(event_time)) if event_time else F.lit(None).cast("long")
    rows = rows.withColumn("at_ms", at)
    fold = SessionState(kind, profile, take, [x.split()[0] for x in verdict.split(", ")], age_ms, event_time is not None)
    mode = "None" if age_ms is None else "EventTime" if event_time else "ProcessingTime"
    return _by_session(rows).transformWithStateInPandas(fold, f"conv_id bigint, turn bigint, {verdict}, session_turn bigint", "append", mode)


def stream_sessions(turns: DataFrame, profile: str = "balanced", age_ms: int | None = SESSION_AGE, event_time: str | None = None) -> DataFrame:
    """Verdicts of a stream of turns (conv_id, turn, role, text) and each turn's number in its session. Each session's state is the fold of the
    batch form; a blocked session stays blocked.

    age_ms: without turns for so long a session is forgotten; None keeps all. event_time: a timestamp column under a watermark by which ages go.
    """
    rows = turns.select("conv_id", "turn", "role", "text", *([event_time] if event_time else []))
    return _folded(rows, Session, profile, lambda session, row: session.turn(row.text or ""), VERDICT, age_ms, event_time)


def stream_unified_sessions(turns: DataFrame, profile: str | None = None, age_ms: int | None = SESSION_AGE) -> DataFrame:
    """Unified verdicts of a stream of turns (conv_id, turn, role, text and any optional layer), by the fold of the batch form."""
    return _folded(unified.turn_signals(turns, profile), unified.Unified, "balanced", lambda session, row: session.take(row), unified.VERDICT, age_ms, None)


class BudgetState(StatefulProcessor):
    """What a session has used of its budget. The opening expires an age after the first request, whatever comes later; with it goes the rest."""

    def __init__(self, budget: dict, age_ms: int):
        self.budget, self.age = budget, age_ms

    def init(self, handle) -> None:
        self.opened = handle.getValueState("opened", "turn bigint", ttlDurationMs=self.age)
        self.used = handle.getValueState("used", "tokens bigint, turns bigint, calls bigint, cost double", ttlDurationMs=self.age)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, out = pd.concat(list(rows)).sort_values("turn", kind="stable", na_position="first"), []
        used = list(self.used.get()) if self.opened.exists() and self.used.exists() else None
        if used is None:
            self.opened.update((batch["turn"].iloc[0],) if not pd.isna(batch["turn"].iloc[0]) else (None,))
            used = [0, 0, 0, 0.0]
        for row in batch.itertuples(index=False):
            allowed, advice, limit, used = spend(used, int(row.need), bool(row.far), self.budget)
            out.append((row.conv_id, row.turn, allowed, advice, limit, *used))
        self.used.update(tuple(used))
        yield pd.DataFrame(out, columns=["conv_id", "turn", *(x.split()[0] for x in BUDGETS.split(", "))])

    def close(self) -> None:
        pass


def stream_budgets(turns: DataFrame, budget: dict | None = None, remote: str = "role = 'user'", age_ms: int = BUDGET_AGE) -> DataFrame:
    """session_budget over a stream of turns (conv_id, turn, role, text); a budget is forgotten age_ms after its first request (by the clock)."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    fold = BudgetState(BUDGET | (budget or {}), age_ms)
    return _by_session(budget_requests(turns, remote)).transformWithStateInPandas(fold, f"conv_id bigint, turn bigint, {BUDGETS}", "append", "ProcessingTime")


def stream_scan(texts: DataFrame) -> DataFrame:
    """Output scan of a stream of texts (doc_id, text), with the decision; stateless, so it runs on a batch alike."""
    found = scan.scan_output(texts, scan.rules(scan.OUTPUT_CATEGORIES))
    return found.withColumn("decision", F.when(F.col("risk_level") == "CRITICAL", "BLOCK").otherwise("PASS"))


def write_split(batch: DataFrame, number: int, passed: str, blocked: str) -> None:
    """A micro-batch into both sinks, each under a folder of the batch's number: one that is run again replaces what it wrote."""
    batch.persist()
    for decision, path in (("PASS", passed), ("BLOCK", blocked)):
        batch.filter(F.col("decision") == decision).write.mode("overwrite").parquet(f"{path}/batch={number}")
    batch.unpersist()


def split_sinks(scanned: DataFrame, passed: str, blocked: str, checkpoint: str):
    """Start the stream into two Parquet sinks, passed and blocked, each with the batch's number as a partition column."""
    write = lambda batch, number: write_split(batch, number, passed, blocked)
    return scanned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream. All files that are there come in one batch: they don't follow one another in time, so
    a session's turns would be out of order, and events late, if they came one by one."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, as a stream's plain path must be a folder


def run_to_end(stream: DataFrame, stateful: bool = False, path: str | None = None) -> DataFrame:
    """All that the stream has given so far for the files that are there now. path: of its checkpoint and rows; run again with it, the stream goes on.

    stateful: for a stream whose state ages by the clock, which would run empty batches for ever; what is there is taken in one batch.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark)
    trigger = {"once": True} if stateful else {"availableNow": True}
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(**trigger).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
