"""Deterministic vectors: sequential, detailed and manual patterns, as DataFrames (id, vec, op)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.functions.vectext import half
from vespera.types import EngineError, Element, check_dim

SEQUENTIAL, DETAILED = 0, 1


def _component(id_, element: Element, as_text: bool):
    """id + 0.1 in single precision, by way of two decimals in the text form; wrapped for i16."""
    if element is Element.i16:
        return F.expr("cast(pmod(id + 32768, 65536) - 32768 as smallint)")
    value = (id_.cast("double") + F.lit(0.1)).cast("float")
    return F.round(value.cast("double"), 2).cast("float") if as_text else value


def sequential(spark: SparkSession, count: int, start: int, dim: int, element: Element, every_n_deleted: int = 0, as_text: bool = True) -> DataFrame:
    rows = spark.range(start, start + count)
    vec = F.array_repeat(_component(F.col("id"), element, as_text), dim)
    if element is Element.f16:
        vec = half(vec)
    at = F.col("id") - start
    gone = (at > 0) & (at % every_n_deleted == 0) if every_n_deleted else F.lit(False)
    return rows.select("id", F.when(~gone, vec).alias("vec"), F.when(gone, "D").otherwise("U").alias("op"))


def ladder(element: Element, max_val: float) -> np.ndarray:
    """Values that a component takes one after another, from 0 until max_val is reached."""
    if element is Element.i16:
        return np.arange(int(max_val) + 1)
    kind = np.float16 if element is Element.f16 else np.float32
    top, step, out = kind(max_val), kind(0.01), [kind(0)]
    while out[-1] < top:
        after = kind(out[-1] + step)
        if after == out[-1]:
            break  # the step is lost in rounding: the component stays
        out.append(after)
    return np.array(out)


def detailed(spark: SparkSession, count: int, start: int, dim: int, element: Element, max_val: float = 1000, every_n_deleted: int = 0, as_text: bool = True) -> DataFrame:
    """Every written row raises one component by 0.01 (i16: 1); at max_val the next one follows, after the last all are zero again."""
    steps = ladder(element, max_val)
    reached = bool(steps[-1] >= (steps.dtype.type(max_val)))
    per = len(steps) - 1
    cycle = dim * per + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int16() if element is Element.i16 else pa.float32()
        for batch in batches:
            ids = batch.column("id").to_numpy()
            at = ids - start
            gone = (at > 0) & (at % every_n_deleted == 0) if every_n_deleted else np.zeros(len(at), bool)
            written = at - (np.maximum(at - 1, 0) // every_n_deleted if every_n_deleted else 0)
            state = written % cycle if reached else np.minimum(written, per)
            column, level = np.divmod(np.maximum(state - 1, 0), per)
            grid = np.where(np.arange(dim)[None, :] < column[:, None], steps[-1], 0).astype(np.float64)
            some = state > 0
            grid[np.flatnonzero(some), column[some]] = steps[level[some] + 1]
            if as_text and element is not Element.i16:
                grid = np.round(grid, 2)
            if element is Element.f16:
                grid = grid.astype(np.float16)
            values = grid.astype(np.int16 if element is Element.i16 else np.float32)
            vectors = pa.array([None if g else v for g, v in zip(gone, values, strict=True)], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(np.where(gone, "D", "U"))], ["id", "vec", "op"])

    return spark.range(start, start + count).mapInArrow(run, f"id long, vec array<{element.sql}>, op string")


def generate(spark: SparkSession, count: int, start: int, pattern: int, dim: int, element: Element | str, max_val: float = 1000, every_n_deleted: int = 0, binary: bool = False) -> DataFrame:
    element = Element.of(element)
    check_dim(dim)
    if count <= 0:
        raise EngineError("count must be > 0")
    if binary and every_n_deleted:
        raise EngineError("the binary form has no deletes")
    if pattern == SEQUENTIAL:
        return sequential(spark, count, start, dim, element, every_n_deleted, as_text=not binary)
    if pattern == DETAILED:
        return detailed(spark, count, start, dim, element, max_val, every_n_deleted, as_text=not binary)
    raise EngineError(f"unknown pattern: {pattern!r}")


def manual(spark: SparkSession, rows: list[tuple[int, bool]], dim: int, element: Element | str) -> DataFrame:
    """(id, live) pairs: a live id has the sequential vector, another is a delete."""
    element = Element.of(element)
    listed = spark.createDataFrame(rows, "id long, live boolean")
    vec = F.array_repeat(_component(F.col("id"), element, True), dim)
    if element is Element.f16:
        vec = half(vec)
    return listed.select("id", F.when(F.col("live"), vec).alias("vec"), F.when(F.col("live"), "U").otherwise("D").alias("op"))
