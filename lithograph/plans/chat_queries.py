"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.operators import conversation as C
from lithograph.plans.tables import Catalog, table

catalog = Catalog()

_RANKED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations"


@catalog.add(f"SELECT conv_id, turn, role FROM ({_RANKED}) WHERE k <= 6")
def chat_window_last6(spark, sf):
    return C.last_turns(table(spark, sf, "conversations"), 6).select("conv_id", "turn", "role")


@catalog.add(f"""SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || CASE WHEN role = 'assistant' AND length(text) > 300 THEN text[1:300] || '...' ELSE text END, chr(10) ORDER BY turn) AS context
FROM ({_RANKED}) WHERE k <= 6 GROUP BY conv_id""")
def chat_context_format(spark, sf):
    return C.context_text(table(spark, sf, "conversations"), 6)


@catalog.add("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def chat_last_nonempty(spark, sf):
    return C.last_answer(table(spark, sf, "conversations"))


@catalog.add("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS k FROM conversations)
WHERE role = 'system' OR k <= 4""")
def chat_history_trim(spark, sf):
    return C.trim_history(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


@catalog.add("""SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS merged FROM (
SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k'), lpad(CAST(event_id AS VARCHAR), 20, '0')) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def map_merge_last_wins(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    merged = C.merge_last_wins(rows, "user_id", "event_type", "k", ["event_id"])
    pairs = F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("user_id", F.array_join(pairs, ",").alias("merged"))


# Scores of a reader's role, experience and wanted depth, and level thresholds.
ROLE_SCORES = {"New Joiner": 0, "Product Owner": 0, "Developer": 1, "QA": 1, "DevOps": 1, "Senior Developer": 2, "Engineering Manager": 2, "Tech Lead": 3, "Architect": 4}
JAVA_SCORES = {"Beginner": 0, "Intermediate": 1, "Advanced": 2, "Expert": 3}
DEPTH_SCORES = {"Executive Summary": 0, "Functional Overview": 1, "Technical Overview": 2, "Deep Technical Analysis": 3, "Expert Level Analysis": 4}
LEVELS = ((3, "beginner"), (6, "intermediate"), (9, "advanced"), (11, "expert"))


def profile_levels(profiles):
    """score and knowledge_level of (role, java, depth); an unknown entry scores 1."""
    lookup = lambda c, t: F.coalesce(F.create_map(*(F.lit(x) for kv in t.items() for x in kv))[F.col(c)], F.lit(1))
    score = lookup("role", ROLE_SCORES) + lookup("java", JAVA_SCORES) + lookup("depth", DEPTH_SCORES)
    level = None
    for most, name in LEVELS:
        level = F.when(F.col("score") <= most, name) if level is None else level.when(F.col("score") <= most, name)
    return profiles.withColumn("score", score).withColumn("knowledge_level", level.otherwise(LEVELS[-1][1]))


def _values(t):
    return "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in t.items()) + ") t(k, v)"


_PROFILE = f"""WITH p AS (SELECT user_id, [{', '.join(f"'{k}'" for k in [*ROLE_SCORES, 'Guest'])}][CAST(user_id % 10 AS INT) + 1] AS role,
[{', '.join(f"'{k}'" for k in JAVA_SCORES)}][CAST(user_id % 4 AS INT) + 1] AS java, [{', '.join(f"'{k}'" for k in DEPTH_SCORES)}][CAST(user_id % 5 AS INT) + 1] AS depth FROM (SELECT DISTINCT user_id FROM events)),
s AS (SELECT user_id, CAST(coalesce((SELECT v FROM {_values(ROLE_SCORES)} WHERE k = role), 1) + coalesce((SELECT v FROM {_values(JAVA_SCORES)} WHERE k = java), 1) + coalesce((SELECT v FROM {_values(DEPTH_SCORES)} WHERE k = depth), 1) AS INT) AS score FROM p)
SELECT user_id, score, CASE WHEN score <= 3 THEN 'beginner' WHEN score <= 6 THEN 'intermediate' WHEN score <= 9 THEN 'advanced' ELSE 'expert' END AS knowledge_level FROM s"""


@catalog.add(_PROFILE)
def profile_level(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % n + 1).cast("int"))
    people = users.select("user_id", pick([*ROLE_SCORES, "Guest"], 10).alias("role"), pick(list(JAVA_SCORES), 4).alias("java"), pick(list(DEPTH_SCORES), 5).alias("depth"))
    return profile_levels(people).select("user_id", "score", "knowledge_level")
