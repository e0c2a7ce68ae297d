"""Relational queries of the platform: audit log, jobs, grants, users.

events stands in for the audit log (user_id, event_type as action, props as JSON details),
for job events and for grants; customer for owned repositories.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.operators import relational as R
from lithograph.plans.tables import Catalog, table

catalog = Catalog()


def events(spark, sf):
    return table(spark, sf, "events")


@catalog.add("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def audit_filter_page(spark, sf):
    found = R.optional_filters(events(spark, sf), event_type="error", user_id=None)
    return R.page(found, [F.desc("ts"), F.desc("event_id")], 20, 50).select("event_id", "user_id", "event_type", "value")


@catalog.add("SELECT count(*) AS total FROM events WHERE event_type = 'error'")
def audit_total(spark, sf):
    return R.optional_filters(events(spark, sf), event_type="error").agg(F.count("*").alias("total"))


@catalog.add("SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click'")
def audit_optional_filters(spark, sf):
    return R.optional_filters(events(spark, sf), user_id=7, event_type="click", event_id=None).select("event_id", "value")


@catalog.add("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type")
def audit_json_details(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total_k"))


@catalog.add("""SELECT user_id, event_type, event_id, value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_latest_grant(spark, sf):
    """Grants are upserted by (user, type): later ones replace earlier ones."""
    all_ = events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    old, new = all_.where("event_id % 2 = 0"), all_.where("event_id % 2 <> 0")
    return R.upsert_latest(old, new, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@catalog.add("""SELECT DISTINCT e.user_id, e.event_type FROM events e WHERE NOT EXISTS (
SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = e.user_id AND r.value > 100)""")
def revoke_anti(spark, sf):
    """Grants of users without a revoking event."""
    rows = events(spark, sf)
    revoked = rows.where("event_type = 'error' AND value > 100").select("user_id")
    return rows.select("user_id", "event_type").distinct().join(revoked, "user_id", "left_anti")


@catalog.add("""SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7 OR c_custkey IN (SELECT event_id FROM events WHERE user_id = 7)""")
def visible_or_semi(spark, sf):
    """Owned (nation 7) or granted (an event of user 7)."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    grants = events(spark, sf).select(F.col("event_id").alias("c_custkey"), "user_id")
    return R.visible(rows, grants, 7, owner="c_nationkey", key="c_custkey")


ROLES = ("viewer", "analyst", "admin")
_ROLE_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'viewer' WHEN 'MACHINERY' THEN 'analyst' WHEN 'AUTOMOBILE' THEN 'admin' ELSE 'guest' END"


@catalog.add(f"SELECT c_custkey, {_ROLE_SQL} AS role FROM customer WHERE {_ROLE_SQL} IN ('analyst', 'admin')")
def role_gte(spark, sf):
    """Users whose role is analyst at least; an unknown role has no rank."""
    role = F.expr(_ROLE_SQL)
    rank = R.severity_rank("role", ROLES)
    return table(spark, sf, "customer").select("c_custkey", role.alias("role")).where((rank >= 2) & (rank <= len(ROLES)))


@catalog.add("""SELECT n_nationkey, coalesce(u.name, n_name) AS n_name, n_regionkey FROM nation
LEFT JOIN (SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN upper(min(c_name)) END AS name FROM customer GROUP BY c_nationkey) u ON u.c_nationkey = n_nationkey""")
def partial_update(spark, sf):
    old = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.upper(F.min("c_name")))
    new = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey").groupBy("n_nationkey").agg(name.alias("n_name"))
    return R.partial_update(old, new, "n_nationkey")


@catalog.add("""SELECT user_id, arg_max(event_type, lpad(CAST(epoch_us(ts) AS VARCHAR), 20, '0') || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS status, count(*) AS steps FROM events GROUP BY user_id""")
def job_lifecycle_latest(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("steps"))


_TYPES = ("view", "click", "purchase", "signup", "error")


@catalog.add("SELECT user_id % 10 AS job_type, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in _TYPES) + " FROM events GROUP BY ALL")
def job_type_status_pivot(spark, sf):
    return events(spark, sf).groupBy((F.col("user_id") % 10).alias("job_type")).agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in _TYPES))


@catalog.add("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def create_user_conflicts(spark, sf):
    """New keys that no existing row holds (unique-key check as an anti join)."""
    rows = events(spark, sf)
    taken = rows.where("event_type = 'purchase' AND value > 60").select("user_id")
    return rows.where("event_type = 'signup'").select("user_id").distinct().join(taken, "user_id", "left_anti")


@catalog.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti")


@catalog.add("SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer ORDER BY c_custkey DESC LIMIT 20 OFFSET 40")
def list_users_page(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return R.page(rows, [F.desc("c_custkey")], 40, 20).crossJoin(rows.agg(F.count("*").alias("total")))
