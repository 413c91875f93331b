"""What the operators of this subpackage share: tables, the shared folder, Arrow text."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder in a session whose executors are the driver itself, as in tests;
    on a cluster an error, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vespera-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/vespera-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table's columns that may be broadcast; in memory they take a few times as much.
BROADCAST = 64 << 20


def small(table: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A written table, to be broadcast if its rows have at most so many bytes by their types; else Catalyst chooses."""
    width = sum(f.dataType.simpleString() in ("string", "binary") and 48 or 8 for f in table.schema.fields)
    return F.broadcast(table) if table.count() * width <= most else table


def among(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", most: int = BROADCAST) -> DataFrame:
    """The rows with an id of a written table, or without (left_anti). Few ids are broadcast, more are joined."""
    return rows.join(small(ids, most), on, how)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct `row`, and further columns: whatever the names in docs, none clashes. `row.*` unpacks it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


#: In a Python worker: what clears a module's tables and caches, which outlive its tasks.
CACHES: dict[str, Callable[[], None]] = {}


def drop_others(module: str) -> None:
    """Clears what other modules keep in this worker: workers live on from one operator to the next."""
    others = [name for name in CACHES if name != module]
    for name in others:
        CACHES.pop(name)()
    if others:
        gc.collect()
        give_back()


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of 1,000 rows where the session leaves Spark's default of 10,000.

    Texts may be long, and a batch is in memory twice. The setting is read when the plan is made, so it
    stays in the session.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_ROWS, None) in (None, "10000"):
        spark.conf.set(BATCH_ROWS, "1000")
    module = run.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(module)
        return run(batches)

    return df.mapInArrow(alone, schema)


def give_back() -> None:
    """Returns memory that is free to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the texts in them (null: empty), without a copy where there are no nulls."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold about `most` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def forget_late(cache: dict) -> None:
    """Halves a cache: what came first stays, which is what occurs most."""
    kept = list(islice(cache.items(), len(cache) // 2))
    cache.clear()
    cache.update(kept)


def strings(texts: pa.Array) -> list[str]:
    return ["" if t is None else t for t in texts.to_pylist()]
