"""Exact nearest neighbours: one query, many queries, limits, allow-lists.

Rows rank by (distance, id). For one query the plan is a projection of the distance over the scan
and a TakeOrderedAndProject: each task keeps its k best and the driver merges them, without a
shuffle; a k over MOST_K is first turned into a bound on (distance, id) by counts, and what is within
it is sorted by ranges, so no task holds k rows. Many queries are scored in blocks of rows in numpy: a matrix product, or for l1 a sum in
single precision, bounds the distances from below, the few rows within the bound are scored exactly, each task keeps its k best of each
query, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespera.functions import metrics
from vespera.functions.bitset import bit_at, ids_of
from vespera.types import DEFAULT_K, EngineError, Element, Metric

#: Ids of a list and bytes of a bitset that may go into the plan; larger ones are joined.
MOST_IDS, MOST_BYTES, QUERIES = 10_000, 4 << 20, 256
#: The largest k that tasks and one merge hold; beyond it the last place is found by counts. And the bins of a count.
MOST_K, BINS = 1_000_000, 1024
#: Rows and pairs that are scored at a time; components of queries from which l1 is worth a shuffle of the rows, and bytes of rows up to which.
TILE, PAIRS, HEAVY, MOST_DEALT = 1024, 1 << 16, 1 << 15, 1 << 30


def effective_k(k: int | None, limit: int | None, offset: int = 0) -> int:
    """How many rows are needed: k, or the window of LIMIT and OFFSET, or the smaller; the default k without either."""
    if k is not None and (isinstance(k, bool) or not isinstance(k, int) or k <= 0):
        raise EngineError("k must be > 0")
    if limit is None or limit < 0:
        return DEFAULT_K if k is None else k
    window = limit + max(offset, 0)
    return window if k is None else min(k, window)


def _table(df: DataFrame, ids: np.ndarray) -> DataFrame:
    return df.sparkSession.createDataFrame(pa.table({"_allowed": pa.array(ids, pa.int64())}))


def allow(df: DataFrame, allowed, id_col: str) -> DataFrame:
    """Rows whose id is allowed: by a DataFrame of ids (first column), a bitset, or a list of ids; None allows all."""
    if allowed is None:
        return df
    if isinstance(allowed, DataFrame):
        ids = allowed.select(F.col(allowed.columns[0]).cast("long").alias("_allowed"))
        return df.join(ids, df[id_col] == ids["_allowed"], "left_semi")
    if isinstance(allowed, bytes | bytearray):
        if len(allowed) > MOST_BYTES:
            return allow(df, _table(df, ids_of(bytes(allowed))), id_col)
        return df.where(bit_at(F.lit(bytes(allowed)), F.col(id_col))) if allowed else df.where(F.lit(False))
    if isinstance(allowed, list | tuple | set | range):
        if len(allowed) > MOST_IDS:
            return allow(df, _table(df, np.fromiter(allowed, np.int64, len(allowed))), id_col)
        return df.where(F.col(id_col).isin([int(i) for i in allowed]))
    raise EngineError("allowed_ids must be a bitset, ids or None")


def check_query(query: Sequence[float] | None) -> list[float]:
    if query is None or len(query) == 0:
        raise EngineError("a query is needed: WHERE query = ... or match_expr = ...")
    return list(query)


def _at_place(rows: DataFrame, column: str, n: int) -> tuple[float, int]:
    """The n-th smallest value of a column (n at most the number of rows), and how many rows are below it.

    Each pass counts rows in BINS equal parts of the values that are left, and the part with the place is left.
    """
    below, part = 0, rows
    low, high = part.agg(F.min(column), F.max(column)).first()
    while low != high:
        share = (F.col(column) - F.lit(low)).cast("double") / F.lit(float(high - low))
        bins = part.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):
            low, high, held = r["low"], r["high"], r["n"]
            if below + held >= n:
                break
            below += held
        part = rows.where(F.col(column).between(low, high))
        if low != high and held <= MOST_K:
            low = high = part.orderBy(column).limit(n - below).agg(F.max(column)).first()[0]
            below += part.where(F.col(column) < low).count()
    return low, below


def _nearest(scored: DataFrame, n: int) -> DataFrame:
    """The n first rows by (distance, id), in this order; of a repeated id at the bound all rows stay where n is over MOST_K."""
    if n <= MOST_K:
        return scored.orderBy("distance", "id").limit(max(n, 0))
    if scored.count() > n:
        d, below = _at_place(scored, "distance", n)
        last, _ = _at_place(scored.where(F.col("distance") == d), "id", n - below)
        scored = scored.where((F.col("distance") < d) | ((F.col("distance") == d) & (F.col("id") <= last)))
    return scored.orderBy("distance", "id")


def knn(
    df: DataFrame, query: Sequence[float], k: int | None = None, metric: Metric | str = "l2", element: Element | str = "f32", *, allowed=None, limit: int | None = None,
    offset: int = 0, id_col: str = "id", vec_col: str = "vec", inv_norm_col: str | None = None, strategy: str = "auto", rank: bool = False, keep: Sequence[str] = (), shown: str | None = None,
) -> DataFrame:
    """The k nearest rows as (id, distance), ascending; rank adds 1..n, keep further columns of df.

    shown adds the columns query (this text) and k, as the search was asked for.

    allowed is applied before the k best are taken; a filter on the result comes after. With
    inv_norm_col, cosine distances are taken from stored inverse norms. Rows without a vector are never found.
    Ranks, and an offset, gather the k rows in one task.
    """
    q, metric = check_query(query), Metric.of(metric)
    n = effective_k(k, limit, offset)
    if inv_norm_col and metric is Metric.cos:
        d = metrics.stored_cos_to(vec_col, F.col(inv_norm_col), q, element)
    else:
        d = metrics.distance_to(vec_col, q, metric, element, strategy)
    rows = allow(df, allowed, id_col).where(F.col(vec_col).isNotNull())
    best = _nearest(rows.select(F.col(id_col).alias("id"), d.alias("distance"), *keep), n)
    if rank:
        best = best.withColumn("rank", F.row_number().over(W.orderBy("distance", "id")))
    if offset > 0:
        best = best.orderBy("distance", "id").offset(offset)
    if limit is not None and limit >= 0:
        best = best.orderBy("distance", "id").limit(limit)
    return best if shown is None else best.withColumns({"query": F.lit(shown), "k": F.lit(n if k is None else k)})


def knn_batch(
    df: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: Metric | str = "l2", element: Element | str = "f32", *, allowed=None, id_col: str = "id", vec_col: str = "vec",
    query_id: str = "query_id", query_vec: str = "query", max_queries: int = 4096,
) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of every query.

    Queries go to the executors in sets of max_queries at most; each set is one pass over the rows.
    """
    metric, element = Metric.of(metric), Element.of(element)
    effective_k(k, None)
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query")).where("query is not null")
    kind = wanted.schema["query_id"].dataType.simpleString()
    rows = allow(df, allowed, id_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("vec is not null")
    whole = wanted.limit(max_queries + 1).toArrow()
    sets = [whole]
    if whole.num_rows > max_queries:
        n = -(-wanted.count() // max_queries)
        sets = [wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == s).toArrow() for s in range(n)]
    if metric is Metric.l1:
        rows = _dealt(rows, sets[0])
    found = None
    for own in sets:
        part = rows.mapInArrow(_scorer(df.sparkSession, own, k, metric, element), f"query_id {kind}, id long, distance double")
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


def _dealt(rows: DataFrame, own: pa.Table) -> DataFrame:
    """For many queries: the rows dealt to all cores, as a file of one row group is read by one task; large tables have many."""
    if (pc.sum(pc.list_value_length(own.column("query"))).as_py() or 0) < HEAVY:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= MOST_DEALT else rows


class _Best:
    """The k nearest rows of each query so far, as one table sorted by query, distance and id."""

    def __init__(self, queries: np.ndarray, k: int, metric: Metric, element: Element):
        self.q, self.k, self.metric, self.element = queries, k, metric, element
        self.norms = (queries * queries).sum(axis=1)
        self.query, self.d, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.worst = np.full(len(queries), np.inf)  # of queries that have k rows

    def bounds(self, rows: np.ndarray, norms: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray, float]:
        """Distances of some queries to all rows (queries x rows); how far they may be off for each query, and in parts of themselves."""
        q, own = self.q[at], self.norms[at]
        if self.metric is Metric.l1:
            return self.sums(rows, q), np.full(len(q), 1e-30), (rows.shape[1] + 8) * 2.0**-22
        product = q @ rows.T
        if self.metric is Metric.l2:
            product *= -2
            product += norms
            product += own[:, None]
            return product, 4e-12 * (norms.max() + own), 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            product /= np.sqrt(np.outer(own, norms))
        product = 1 - product
        product[:, norms == 0] = 1
        product[own == 0] = np.where(norms == 0, 0.0, 1.0)
        return product, np.full(len(q), 1e-11), 0.0

    def sums(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """l1 distances in single precision, in tiles of rows that stay in a core's cache; exact ones where those overflow."""
        near, ones = np.empty((len(q), len(rows)), np.float32), np.ones(rows.shape[1], np.float32)
        single, held = q.astype(np.float32), np.empty((min(TILE, len(rows)), rows.shape[1]), np.float32)
        with np.errstate(over="ignore"):
            for start in range(0, len(rows), TILE):
                tile = rows[start : start + TILE].astype(np.float32, copy=False)
                gap = held[: len(tile)]
                for j, x in enumerate(single):
                    np.subtract(tile, x, out=gap)
                    np.abs(gap, out=gap)
                    np.dot(gap, ones, out=near[j, start : start + len(tile)])
        if np.isfinite(near).all():
            return near
        return np.stack([metrics.numpy_distances(rows, x, self.metric, self.element) for x in q])

    def exact(self, rows: np.ndarray, q: np.ndarray, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The distances of these pairs of a query and a row."""
        parts = [slice(s, s + PAIRS) for s in range(0, len(j), PAIRS)]
        if self.metric is Metric.l1:
            return np.concatenate([np.zeros(0), *(metrics.pair_l1(rows[i[p]], q[j[p]], self.element) for p in parts)])
        return np.concatenate([np.zeros(0), *(metrics.pair_distances(rows[i[p]], q[j[p]], self.metric) for p in parts)])

    def take(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.metric is not Metric.l1:
            rows = rows.astype(np.float64)
        norms = (rows * rows).sum(axis=1) if self.metric is not Metric.l1 else rows[:, 0]
        found = []
        for a in range(0, len(self.q), QUERIES):
            at = slice(a, a + QUERIES)
            near, off, share = self.bounds(rows, norms, at)
            limit = self.worst[at]
            if len(ids) > self.k and not (limit < np.inf).all():
                limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] * (1 + share) + off)
            with np.errstate(over="ignore"):
                j, i = np.nonzero(near <= (limit * (1 + share) + off).astype(near.dtype)[:, None])
            part = j + a, self.exact(rows, self.q[at], j, i), ids[i]
            found.append(part if len(j) <= 4 * self.k * len(near) else self.first(*part)[:3])  # many at the same distance
        self.query, self.d, self.ids, last = self.first(*(np.concatenate(x) for x in zip((self.query, self.d, self.ids), *found, strict=True)))
        self.worst[self.query[last]] = self.d[last]

    def first(self, query: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k first rows of each query, and which of them are the k-th."""
        order = np.lexsort((ids, d, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        order = order[keep]
        return query[keep], d[order], ids[order], place[keep] == self.k - 1


def _scorer(spark, own: pa.Table, k: int, metric: Metric, element: Element):
    names = own.column("query_id").combine_chunks()
    vectors = [metrics.query_values(q, element) for q in own.column("query").to_pylist()]
    if len({len(q) for q in vectors}) > 1:
        raise EngineError("vectors and queries must have the same dimension")
    held = spark.sparkContext.broadcast((names, np.array(vectors, np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = held.value
        best = _Best(queries, k, metric, element) if len(queries) else None
        for batch in batches:
            if not batch.num_rows or not best:
                continue
            lists = batch.column("vec")
            if (np.diff(lists.offsets.to_numpy()) != queries.shape[1]).any():
                raise EngineError("vectors and queries must have the same dimension")
            best.take(batch.column("id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        if best and len(best.query):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(best.ids), pa.array(best.d)], ["query_id", "id", "distance"])

    return run
