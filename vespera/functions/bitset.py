"""Dense bitsets of ids, least significant bit first, and their use as allow-lists."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.types import EngineError

MAX_BYTES = (1 << 31) - 1


def bitset_agg(df: DataFrame, id_col: str = "id", by: list[str] | None = None, name: str = "bitset", max_bytes: int = 64 << 20) -> DataFrame:
    """One bitset for each group (or for all rows): nulls are ignored, no id gives an empty bitset.

    Ids are first joined to bytes by a partial aggregation; a group's result is a single value by
    nature, of largest id / 8 bytes, and over max_bytes it is an error.
    """
    by = by or []
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise EngineError(f"bitset_agg: {id_col} must be an integer")
    id_ = F.col(id_col).cast("long")
    checked = F.when(id_ < 0, F.raise_error(F.lit("bitset_agg: id must be non-negative")).cast("long")).when(id_ >= 8 * max_bytes, F.raise_error(F.lit("bitset_agg: id is too large")).cast("long")).otherwise(id_)
    bits = df.select(*by, checked.alias("_id")).select(*by, F.expr("_id div 8").alias("_at"), F.call_function("shiftleft", F.lit(1), F.expr("cast(_id % 8 as int)")).alias("_bit"))
    bytes_ = bits.groupBy(*by, "_at").agg(F.bit_or("_bit").alias("_byte"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_byte"))))
    grouped = bytes_.groupBy(*by).agg(listed.alias("_bytes"))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.get(F.col("_bytes"), (i - 1).cast("int"))["_at"])
    digits = F.transform("_bytes", lambda x, i: F.concat(F.repeat(F.lit("00"), (x["_at"] - before(i) - 1).cast("int")), F.lpad(F.hex(x["_byte"]), 2, "0")))
    return grouped.select(*by, F.unhex(F.array_join(digits, "")).alias(name))


def bit_at(bitset: Column, id_: Column) -> Column:
    """Whether an id is in a bitset; ids beyond its end aren't."""
    byte = F.ascii(F.decode(F.substring(bitset, (F.floor(id_ / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    inside = (id_ >= 0) & (F.floor(id_ / 8) < F.octet_length(bitset))
    return F.when(inside, F.call_function("getbit", byte, (id_ % 8).cast("int")) == 1).otherwise(False)


#: The same in SQL, of the columns or parameters bits and v.id.
BIT_SQL = "CASE WHEN v.id >= 0 AND v.id div 8 < octet_length(bits) THEN getbit(ascii(decode(substring(bits, cast(v.id div 8 + 1 as int), 1), 'ISO-8859-1')), cast(v.id % 8 as int)) = 1 ELSE false END"


def ids_of(bitset: bytes) -> np.ndarray:
    """The ids of a bitset, on the driver."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitset, np.uint8), bitorder="little"))


def bitset_ids(df: DataFrame, bitset_col: str, name: str = "id") -> DataFrame:
    """A row for each id in each bitset, with the row's other columns."""
    digits = F.hex(bitset_col)
    byte = F.sequence(F.lit(0), F.octet_length(bitset_col) - 1)
    rows = df.where(F.octet_length(bitset_col) > 0).select("*", F.explode(byte).alias("_at"), digits.alias("_hex"))
    value = F.conv(F.substring(F.col("_hex"), 2 * F.col("_at") + 1, F.lit(2)), 16, 10).cast("int")
    bits = rows.withColumn("_byte", value).where("_byte <> 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit"))
    return bits.where(F.call_function("getbit", F.col("_byte"), F.col("_bit")) == 1).withColumn(name, (8 * F.col("_at") + F.col("_bit")).cast("long")).drop("_at", "_hex", "_byte", "_bit", bitset_col)


def make_bitset(ids: Iterable[int]) -> bytes:
    """The bitset of a small list of ids, on the driver."""
    out = bytearray()
    for i in ids:
        if isinstance(i, bool) or not isinstance(i, int):
            raise EngineError("bitset: id must be an integer")
        if i < 0:
            raise EngineError("bitset: id must be non-negative")
        if i // 8 >= MAX_BYTES:
            raise EngineError("bitset: id is too large")
        if len(out) <= i // 8:
            out.extend(bytes(i // 8 + 1 - len(out)))
        out[i // 8] |= 1 << i % 8
    return bytes(out)


def register_sql(spark: SparkSession, max_bytes: int = 64 << 20) -> None:
    """bitset_agg(id) for SQL. A group is gathered in one task; bitset_agg() above pre-aggregates and is for large groups."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def gathered(ids):
        own = ids.dropna().to_numpy()
        if not len(own):
            return b""
        own = own.astype(np.int64)
        if own.min() < 0:
            raise EngineError("bitset: id must be non-negative")
        if own.max() >= 8 * max_bytes:
            raise EngineError("bitset: id is too large")
        out = np.zeros(int(own.max()) // 8 + 1, np.uint8)
        np.bitwise_or.at(out, own >> 3, (1 << (own & 7)).astype(np.uint8))
        return out.tobytes()

    bitset = pandas_udf(gathered, "binary", PandasUDFType.GROUPED_AGG)
    spark.udf.register("bitset_agg", bitset)
