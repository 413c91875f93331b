"""The SQL surface: a read-only view and a table function knn_<name> for each dataset, and the functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vespera.functions import bitset, metrics
from vespera.types import DEFAULT_K, EngineError, Element, Metric, check_name

DISTANCE = {
    Metric.l1: "aggregate(zip_with(v.vec, q, (x, y) -> {diff}), 0D, (s, t) -> s + cast(t as double))",
    Metric.l2: "aggregate(zip_with(v.vec, q, (x, y) -> cast(x as double) - cast(y as double)), 0D, (s, t) -> s + t * t)",
}


def register(spark: SparkSession) -> None:
    """l1_distance, l2_distance, cosine_distance, dot_product, squared_norm, inverse_norm, bitset_agg."""
    metrics.register_sql(spark)
    bitset.register_sql(spark)


def expose(spark: SparkSession, name: str, rows: DataFrame, metric: Metric | str, element: Element | str = "f32") -> None:
    """Makes rows (id, vec) the view <name>, and its nearest neighbours the table function knn_<name>(q, k).

    The function takes its query and k from outer rows as well (LATERAL); with a literal k the plan
    is a TakeOrderedAndProject. WHERE beside it filters the k nearest, as after any table.
    knn_<name>_in(q, ids, k) takes the k nearest among an array of ids, knn_<name>_bits(q, bits, k) among
    those of a bitset (null: all). Cosine distances use the column inv_norm where rows have it. For many
    queries at once, `knn_batch` is the better plan: LATERAL compares all pairs by expressions.
    """
    check_name(name)
    if not name.replace("_", "a").isalnum():
        raise EngineError(f"not a name for SQL: {name!r}")
    metric, element = Metric.of(metric), Element.of(element)
    rows.createOrReplaceTempView(name)
    stored = "inv_norm" in rows.columns
    if metric is Metric.cos:
        product = "aggregate(zip_with(v.vec, q, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, t) -> s + t)"
        na, nb = (f"aggregate({x}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))" for x in ("v.vec", "q"))
        inside = f"{product} * v.inv_norm * (1 / sqrt({nb}))" if stored else f"{product} / sqrt({na} * {nb})"
        na = "v.inv_norm" if stored else na
        d = f"CASE WHEN {na} = 0 AND {nb} = 0 THEN 0D WHEN {na} = 0 OR {nb} = 0 THEN 1D ELSE 1 - greatest(-1D, least(1D, {inside})) END"
    else:
        d = DISTANCE[metric].format(diff="abs(x - y)" if element is Element.f32 else "abs(cast(x as double) - cast(y as double))")
    body = "SELECT id, distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS place FROM (SELECT v.id, {d} AS distance FROM {name} v{where})) WHERE place <= k"
    kind = f"ARRAY<{element.sql}>"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION knn_{name}(q {kind}, k INT DEFAULT {DEFAULT_K}) RETURNS TABLE(id BIGINT, distance DOUBLE) RETURN {body.format(d=d, name=name, where='')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION knn_{name}_bits(q {kind}, bits BINARY, k INT DEFAULT {DEFAULT_K}) RETURNS TABLE(id BIGINT, distance DOUBLE) RETURN {body.format(d=d, name=name, where=f' WHERE bits IS NULL OR {bitset.BIT_SQL}')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION knn_{name}_in(q {kind}, ids ARRAY<BIGINT>, k INT DEFAULT {DEFAULT_K}) RETURNS TABLE(id BIGINT, distance DOUBLE) RETURN {body.format(d=d, name=name, where=' WHERE ids IS NULL OR array_contains(ids, v.id)')}")


#: The target of a statement that changes rows.
CHANGE = re.compile(r"\s*(?:insert\s+(?:into|overwrite)|update|delete\s+from|merge\s+into|truncate)\s+(?:table\s+)?`?([\w.-]+)`?", re.IGNORECASE)


class Following:
    """SQL over stored datasets: each statement sees the newest published version of each, and none changes one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stores = spark, {}

    def attach(self, name: str, store) -> None:
        self.stores[name] = [store, None]

    def sql(self, text: str) -> DataFrame:
        target = CHANGE.match(text)
        if target and target[1].lower() in (name.lower() for name in self.stores):
            raise EngineError(f"read-only in SQL: {target[1]}")
        for name, held in self.stores.items():
            store, known = held
            m = store.manifest()
            if m.number != known:
                meta = store.meta
                expose(self.spark, name, store.rows(m), meta.metric, meta.element)
                held[1] = m.number
        return self.spark.sql(text)
