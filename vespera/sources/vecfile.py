"""Vector files: the text form, the packed binary form, and both as sinks.

Text: a line `type,dim`, then `id : [ v, v, ... ]`; `id : []` deletes. Binary: a line `type,dim,bin`,
then records of a little-endian 64-bit id and the packed components. Files may be of any size: of a
header only the first bytes are read, text is split by Spark, and binary files by ranges of records
wherever Python can read them too (local and shared folders, object stores); elsewhere each is read
whole by one task, and must be under 2 GB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.functions import vectext
from vespera.sources.files import Files
from vespera.types import MAX_ID, EngineError, Element, check_dim


@dataclass(frozen=True)
class Header:
    element: Element
    dim: int
    binary: bool

    def line(self) -> str:
        return f"{self.element.value},{self.dim}" + (",bin" if self.binary else "")


def parse_header(line: str) -> Header:
    parts = [p.strip() for p in line.strip().split(",")]
    if len(parts) not in (2, 3):
        raise EngineError(f"invalid header: {line!r}")
    if len(parts) == 3 and parts[2] != "bin":
        raise EngineError(f"unknown mode: {parts[2]!r}")
    if not parts[1].isdigit():
        raise EngineError(f"invalid dim: {parts[1]!r}")
    return Header(Element.of(parts[0]), check_dim(int(parts[1])), len(parts) == 3)


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of the first file."""
    try:
        files = Files(spark, path)
        line = files.first_line(files.listing(path)[0][0])
    except Exception as e:
        raise EngineError(f"failed to open file: {path}") from e
    return parse_header(line)


def read_text(spark: SparkSession, path: str, lenient: bool = False) -> tuple[Header, DataFrame]:
    """(header, rows id, vec, op): op U with a vector, D without. Lines that don't begin with a number are skipped."""
    header = read_header(spark, path)
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[+-]?\d"))
    body = F.regexp_extract("value", r"\[([^\]]*)\]", 1)
    number = F.regexp_extract("value", r"^\s*([+-]?\d+)", 1)
    fail = lambda m, kind: F.raise_error(F.lit(m)).cast(kind)
    id_ = number.try_cast("bigint")
    good_id = F.when(id_.isNull() | (id_ < 0), fail(f"id must be an integer from 0 to {MAX_ID}", "bigint")).otherwise(id_)
    good_body = F.when(~F.col("value").contains("["), fail("Invalid line: missing '['", "string")).when(~F.col("value").rlike(r"\[[^\]]*\]"), fail("Invalid line: missing ']'", "string")).otherwise(body)
    rows = lines.select(good_id.alias("id"), good_body.alias("body"))
    gone = F.trim("body") == "" if lenient else F.col("body") == ""
    live = rows.where(~gone).select("body").head(1)
    commas = not live or vectext.has_commas(live[0]["body"])
    vec = vectext.parsed(F.when(~gone, F.col("body")), header.element, header.dim, commas)
    return header, rows.select("id", vec.alias("vec"), F.when(gone, "D").otherwise("U").alias("op"))


def _batches(rows: np.ndarray, header: Header) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        if int(part["id"].max()) > MAX_ID:
            raise EngineError(f"id must be an integer from 0 to {MAX_ID}")
        values = part["vec"].astype(np.int16 if header.element is Element.i16 else np.float32)
        if not np.isfinite(values).all():
            raise EngineError("non-finite component in binary file")
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, header.dim, dtype=np.int32)), pa.array(values.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part["id"].astype(np.int64)), vectors, pa.array(["U"] * len(part))], ["id", "vec", "op"])


def _same_header(data: bytes, header: Header) -> int:
    """Bytes before the first record."""
    line = data.partition(b"\n")[0]
    if parse_header(line.decode("latin-1")) != header:
        raise EngineError("files of one load must have the same header")
    return len(line) + 1


def read_binary(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> tuple[Header, DataFrame]:
    """(header, rows id, vec, op) of packed files, each read in ranges of about range_bytes."""
    header = read_header(spark, path)
    record = np.dtype([("id", "<u8"), ("vec", header.element.numpy, (header.dim,))])
    each = max(1, range_bytes // record.itemsize)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for r in batch.to_pylist():
                system, name = FileSystem.from_uri(r["uri"])
                with system.open_input_file(name) as f:
                    begin = _same_header(f.read_at(64, 0), header)
                    if (f.size() - begin) % record.itemsize:
                        raise EngineError("truncated binary record")
                    last = min(r["first"] + each, (f.size() - begin) // record.itemsize)
                    for at in range(r["first"], last, 65_536):
                        n = min(65_536, last - at)
                        yield from _batches(np.frombuffer(f.read_at(n * record.itemsize, begin + at * record.itemsize), record), header)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                begin = _same_header(data[:64].to_pybytes(), header)
                if (len(data) - begin) % record.itemsize:
                    raise EngineError("truncated binary record")
                yield from _batches(np.frombuffer(data, record, (len(data) - begin) // record.itemsize, begin), header)

    kind = f"id long, vec array<{header.element.sql}>, op string"
    files = Files(spark, path).listing(path)
    if not all(_reachable(uri) for uri, _ in files):
        return header, spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, kind)
    parts = [(uri, first) for uri, size in files for first in range(0, max(1, size // record.itemsize), each)]
    return header, spark.createDataFrame(parts, "uri string, first long").repartition(min(len(parts), 10_000)).mapInArrow(ranges, kind)


def _reachable(uri: str) -> bool:
    """Whether Python's file systems open this."""
    from pyarrow.fs import FileSystem

    try:
        system, name = FileSystem.from_uri(uri)
        system.open_input_file(name).close()
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def read_vectors(spark: SparkSession, path: str, lenient: bool = False) -> tuple[Header, DataFrame]:
    return read_binary(spark, path) if read_header(spark, path).binary else read_text(spark, path, lenient)


def duplicates(rows: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    return rows.groupBy("id").count().where("count > 1").select("id")


def check_unique(rows: DataFrame) -> DataFrame:
    if duplicates(rows).head(1):
        raise EngineError("Duplicate ids")
    return rows


def has_ids(rows: DataFrame, start: int, end: int) -> bool:
    """Whether an id lies in [start, end)."""
    return start < end and bool(id_range(rows, start, end).head(1))


def id_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with ids in [start, end); (0, 0) stands for all."""
    if start > end:
        raise EngineError("range start is greater than its end")
    return rows if start == end == 0 else rows.where((F.col("id") >= start) & (F.col("id") < end))


def text_lines(rows: DataFrame, element: Element) -> DataFrame:
    """id, line of rows (id, vec[, op]) in the text form."""
    vec = vectext.formatted(F.col("vec"), element)
    return rows.select("id", F.concat(F.col("id").cast("string"), F.lit(" : "), F.coalesce(vec, F.lit("[]"))).alias("line"))


def write_text(rows: DataFrame, path: str, element: Element, dim: int) -> None:
    """A folder of text files, each with its header, ordered by id within each."""
    lines = text_lines(rows, element)
    head = Header(element, dim, False).line()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
                first = False
            yield pa.RecordBatch.from_arrays([batch.column("line")], ["value"])

    lines.sortWithinPartitions("id").select("line").mapInArrow(run, "value string").write.text(path)


def write_binary(rows: DataFrame, path: str, element: Element, dim: int) -> None:
    """A folder of packed files, one for each task with rows, ordered by id within each; rows (id, vec) must be live.

    A task writes under a hidden name of its own and renames at its end, so readers never see a part of a file, and a task
    that runs again puts the same file in the same place. The folder must be one that Python's file systems reach.
    """
    files = Files(rows.sparkSession, path)
    if files.exists(path):
        raise EngineError(f"path exists: {path}")
    files.make(path)
    root, head = files.uri(path), Header(element, dim, True).line().encode() + b"\n"
    record = np.dtype([("id", "<u8"), ("vec", element.numpy, (dim,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        system, folder = FileSystem.from_uri(root)
        task = TaskContext.get()
        hidden, n, out = f"{folder}/_part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            vectors = batch.column("vec")
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != dim).any():
                raise EngineError("the binary form has no deletes, and vectors of one dimension")
            packed = np.empty(batch.num_rows, record)
            packed["id"] = batch.column("id").to_numpy()
            packed["vec"] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if batch.num_rows:
                out = out or system.open_output_stream(hidden)
                out.write(packed.tobytes() if n else head + packed.tobytes())
            n += batch.num_rows
        if out:
            out.close()
            system.move(hidden, f"{folder}/part-{task.partitionId():05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    live = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(f"array<{element.sql}>").alias("vec")).sortWithinPartitions("id")
    if not live.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]:
        files.write(f"{path}/part-00000.bin", head.decode())  # without rows a header alone


def pack_records(ids: list[int], vectors: list, element: Element) -> bytes:
    """Binary records of a small batch, on the driver."""
    out = [struct.pack("<Q", i) + np.array(v, np.float64).astype(element.numpy).tobytes() for i, v in zip(ids, vectors, strict=True)]
    return b"".join(out)
