"""Conversation windows and message state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn)."""
    recent = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_k", F.row_number().over(recent)).where(F.col("_k") <= n).drop("_k")


def trim_history(messages: DataFrame, window: int) -> DataFrame:
    """All system messages, and the last 2 * window others."""
    system = F.col("role") == "system"
    recent = W.partitionBy("conv_id", system).orderBy(F.desc("turn"))
    return messages.withColumn("_k", F.row_number().over(recent)).where(system | (F.col("_k") <= 2 * window)).drop("_k")


def context_text(messages: DataFrame, n: int, width: int = 300) -> DataFrame:
    """(conv_id, context): the last n messages in order, long answers cut with an ellipsis."""
    short = F.when((F.col("role") == "assistant") & (F.length("text") > width), F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    lines = last_turns(messages, n).select("conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), short).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("context"))


def last_answer(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of the last assistant message that is not blank."""
    spoken = messages.where("role = 'assistant' AND trim(text) <> ''")
    return spoken.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")


def merge_last_wins(entries: DataFrame, group: str, key: str, value: str, order: list[str]) -> DataFrame:
    """(group, merged): union of maps in which a later value of a key replaces an earlier one."""
    latest = entries.groupBy(group, key).agg(F.max_by(value, F.struct(*order)).alias("v"))
    return latest.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "v")))).alias("merged"))
