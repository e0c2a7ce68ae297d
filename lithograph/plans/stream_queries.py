"""Streaming queries over events, each with the batch SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.plans.tables import Catalog
from lithograph.streaming import events as S

catalog = Catalog()


@catalog.add("SELECT event_id, user_id, value FROM events WHERE event_type = 'signup'")
def stream_audit_append(spark, sf):
    return S.append_log(spark, sf, "signup").select("event_id", "user_id", "value")


@catalog.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_upsert_latest(spark, sf):
    return S.upsert_latest(spark, sf).select("user_id", "event_type", "event_id", "value")


@catalog.add("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def stream_tumbling_counts(spark, sf):
    return S.tumbling_counts(spark, sf).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


_ASKED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.JOB_STATES.items()) + " END"
_ALLOWED = " OR ".join(f"(s.state = '{state}' AND e.state IN ({', '.join(repr(n) for n in after)}))" for state, after in S.TRANSITIONS.items())


@catalog.add(f"""WITH o AS (SELECT user_id, max(ts) AS last, list({{'state': {_ASKED}, 'steps': 0, 'refused': 0}} ORDER BY ts, event_id) AS asked FROM events GROUP BY user_id),
j AS (SELECT user_id, last, list_reduce(list_prepend({{'state': 'none', 'steps': 0, 'refused': 0}}, asked), lambda s, e: CASE WHEN {_ALLOWED} THEN {{'state': e.state, 'steps': s.steps + 1, 'refused': s.refused}} ELSE {{'state': s.state, 'steps': s.steps, 'refused': s.refused + 1}} END) AS s FROM o),
d AS (SELECT *, s.state IN ('pending', 'running') AND last + INTERVAL 2 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS overdue FROM j)
SELECT user_id, CASE WHEN overdue THEN 'failed' ELSE s.state END AS status, CAST(s.steps AS BIGINT) AS steps, CAST(s.refused AS BIGINT) AS refused, CAST(0 AS BIGINT) AS late, CAST(overdue AS BIGINT) AS stuck FROM d""")
def stream_job_states(spark, sf):
    """A state machine for each user: allowed steps taken, others refused and counted, jobs that stopped failed by a timer."""
    return S.job_states(spark, sf)


@catalog.add("""SELECT conv_id, max(turn) AS last_turn, string_agg(turn || ':' || role, ',' ORDER BY turn) AS window
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id""")
def stream_conversation_windows(spark, sf):
    return S.conversation_windows(spark, sf)
