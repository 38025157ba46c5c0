"""Queries that run a stream over a given table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from textward.functions.tables import sql_values
from textward.operators import scan
from textward.plans import conversations
from textward.plans.planted import TURN_ROWS
from textward.streaming import sessions as st

_OUT = [(i, r[0], int(r[2]), r[4]) for i, r in enumerate(scan.rules(scan.OUTPUT_CATEGORIES))]


def _turns(s, d):
    return st.table_stream(s, d, "conversations")


def _visits(s, d, reset="false"):
    """Events as turns of their users' sessions; those for which reset holds ask for a new session."""
    rows = st.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return rows.selectExpr("user_id as conv_id", "event_id as turn", f"case when {reset} then 'reset' else 'user' end as role", "event_type as text", "ts")


_NUMBERED = "select conv_id, turn, row_number() over (partition by conv_id, part order by ts, turn) as session_turn from parts"

QUERIES = {
    "t1_stream_sessions": lambda s, d: st.run_to_end(st.stream_sessions(_turns(s, d), age_ms=None)),
    "t2_session_expiry": lambda s, d: st.run_to_end(st.stream_sessions(_visits(s, d), event_time="ts")).select("conv_id", "turn", "session_turn"),
    "t3_stream_scan": lambda s, d: st.run_to_end(st.stream_scan(st.table_stream(s, d, "documents").selectExpr("doc_id", "coalesce(text, '') as text"))).select("doc_id", "risk_score", "decision"),
    "t4_session_lock": lambda s, d: st.run_to_end(st.stream_sessions(_turns(s, d), "strict", None)).groupBy("conv_id").agg(F.count_if(F.col("pattern_name") == "locked").alias("locked_turns"), F.count("*").alias("turns")),
    "t5_session_reset": lambda s, d: st.run_to_end(st.stream_sessions(_visits(s, d, "event_type = 'error'"), event_time="ts", age_ms=10**12)).select("conv_id", "turn", "session_turn"),
    "t6_stream_budgets": lambda s, d: st.run_to_end(st.stream_budgets(_turns(s, d), conversations.LIMITS), stateful=True).withColumn("cost", F.round("cost", 9)),
}
ORACLE = {
    "t2_session_expiry": f"with steps as (select user_id as conv_id, event_id as turn, ts, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) over (partition by user_id order by ts, event_id)) > {st.SESSION_AGE}, false) as stale from events), parts as (select *, count(*) filter (stale) over (partition by conv_id order by ts, turn) as part from steps) {_NUMBERED}",
    "t3_stream_scan": f"with rules(ord, name, severity, regex) as (values {sql_values(_OUT)}), h as (select doc_id, cast(sum(severity) as integer) as r from documents join rules on regexp_matches(text, regex) where strlen(text) >= 10 group by doc_id) select doc_id, coalesce(r, 0) as risk_score, case when r >= 100 then 'BLOCK' else 'PASS' end as decision from documents left join h using (doc_id)",
    "t5_session_reset": f"with steps as (select user_id as conv_id, event_id as turn, ts, event_type, count(*) filter (event_type = 'error') over (partition by user_id order by ts, event_id) as part from events), parts as (select * from steps where event_type <> 'error') {_NUMBERED}",
    "t6_stream_budgets": conversations.ORACLE["m24_session_budget"].replace(TURN_ROWS, "turns as (select conv_id, turn, role, coalesce(text, '') as text from conversations)"),
}
