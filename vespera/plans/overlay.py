"""Base rows, deltas over them, and the algebra of updates: all keyed by id, as DataFrames.

Rows of updates and deltas are (id, vec, op): op U holds a vector, op D deletes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible(base: DataFrame, delta: DataFrame | None) -> DataFrame:
    """Base rows that no delta row hides, and the delta's vectors."""
    if delta is None:
        return base
    columns = base.columns
    shown = base.join(delta.select("id"), "id", "left_anti").select(*columns)
    return shown.unionByName(delta.where("op = 'U'").select(*columns))


def latest(ops: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The last operation of each key."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return ops.withColumn("_place", place).where("_place = 1").drop("_place")


def merge_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """One delta with the effect of the old one and then the new one; ids deleted before and added again live."""
    columns = new.columns
    return old.join(new.select("id"), "id", "left_anti").select(*columns).unionByName(new)


def merge_into_base(base: DataFrame, updates: DataFrame) -> DataFrame:
    """The base with all updates taken in; no deletes are left."""
    return visible(base, updates)


def file_of(id_col, range_size: int):
    return F.expr(f"{id_col} div {range_size}")


def decisions(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """counts (base_n, updates, deletes by file_id) -> target: base if the update is large against it, else delta."""
    size = F.col("updates") + F.col("deletes")
    target = F.when(F.col("base_n").isNull(), "base").when(F.col("base_n") < size * ratio, "base").otherwise("delta")
    return counts.withColumn("target", target)
