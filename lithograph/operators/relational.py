"""Relational operators: keep-best de-duplication, upserts, visibility, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``, which must be total.

    A grouped minimum over structs, so it combines on the map side and a hot key is no hot task.
    """
    by = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg((F.max_by if last else F.min_by)(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """Only the predicates that are given; they reach the scan."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``old`` with ``new`` merged in by key: the last in ``order`` (ascending is older) stays."""
    return keep_best(old.unionByName(new), keys, order, last=True)


def partial_update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` that are not null replace the old ones."""
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    merged = old.join(renamed, key, "left")
    return merged.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in old.columns))


def visible(rows: DataFrame, grants: DataFrame, user, owner: str = "owner_id", key: str = "id") -> DataFrame:
    """Rows that ``user`` owns or has a grant for: no row twice, no disjunctive join."""
    granted = grants.where(F.col("user_id") == user).select(key).distinct().withColumn("_granted", F.lit(True))
    return rows.join(granted, key, "left").where((F.col(owner) == user) | F.col("_granted")).drop("_granted")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return keep_best(df, [key], order, last=True)


def severity_rank(column: str, levels: tuple[str, ...]) -> Column:
    """Place of a value in a declared order; unknown values come last."""
    found = F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    return F.when(found > 0, found).otherwise(F.lit(len(levels) + 1))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def may(pairs: DataFrame, grants: DataFrame, permissions: tuple | None = None, owner: str = "owner_id", key: str = "id") -> DataFrame:
    """Of (user_id, role, key, owner) the pairs that are allowed: administrators, owners, and users with a grant (one of ``permissions``)."""
    enough = grants if permissions is None else grants.where(F.col("permission").isin(*permissions))
    held = enough.select("user_id", key).distinct().withColumn("_held", F.lit(True))
    out = pairs.join(held, ["user_id", key], "left")
    return out.where((F.col("role") == "admin") | F.col(owner).eqNullSafe(F.col("user_id")) | F.coalesce("_held", F.lit(False))).drop("_held")


def conflicts(rows: DataFrame, changes: DataFrame, key: str, unique: str) -> DataFrame:
    """Changes whose new value of a unique column another row has already."""
    taken = rows.select(F.col(unique).alias("_value"), F.col(key).alias("_other"))
    hit = changes.where(F.col(unique).isNotNull()).join(taken, (F.col(unique) == F.col("_value")) & (F.col(key) != F.col("_other")), "left_semi")
    return hit.select(changes.columns)


def set_where(rows: DataFrame, condition: Column, **values) -> DataFrame:
    """Columns set where the condition holds; all other rows as they were."""
    return rows.select(*(F.when(F.coalesce(condition, F.lit(False)), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def lookup(rows: DataFrame, **equals) -> DataFrame:
    """Rows of one key; the predicate reaches the scan."""
    return optional_filters(rows, **equals)
