"""Distances between vectors as Column expressions.

Sums run in double precision. For l1 on f32 the difference is taken in single precision; f16 is
widened first, and i16 is widened to integers, which can't overflow. A cosine distance of two zero
vectors is 0, of one zero vector 1.

Against a literal query there are two forms with equal semantics: a sum unrolled over the
components, which stays inside whole-stage code generation, for up to UNROLLED components; and
an Arrow UDF in numpy beyond. Between two columns higher-order functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vespera.types import EngineError, Element, Metric

UNROLLED = 128


def _pairwise(a: Column, b: Column, term, start: str = "0D") -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.expr(start), lambda s, t: s + t.cast("double"))


def _wide(x: Column, element: Element) -> Column:
    return x.cast("bigint") if element is Element.i16 else x.cast("double")


def l1(a: Column, b: Column, element: Element = Element.f32) -> Column:
    if element is Element.f32:
        return _pairwise(a, b, lambda x, y: F.abs(x - y))
    return _pairwise(a, b, lambda x, y: F.abs(_wide(x, element) - _wide(y, element)))


def l2(a: Column, b: Column, element: Element = Element.f32) -> Column:
    return _pairwise(a, b, lambda x, y: (_wide(x, element) - _wide(y, element)) * (_wide(x, element) - _wide(y, element)))


def dot(a: Column, b: Column, element: Element = Element.f32) -> Column:
    return _pairwise(a, b, lambda x, y: _wide(x, element) * _wide(y, element))


def squared_norm(a: Column, element: Element = Element.f32) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (_wide(x, element) * _wide(x, element)).cast("double"))


def inverse_norm(a: Column, element: Element = Element.f32) -> Column:
    """Single precision; 0 for a zero vector."""
    n = squared_norm(a, element)
    return F.when(n == 0, F.lit(0.0)).otherwise(1 / F.sqrt(n)).cast("float")


def cos_from_norms(product: Column, na: Column, nb: Column) -> Column:
    inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / F.sqrt(na * nb)))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - inside)


def cos_from_inverse_norms(product: Column, ia: Column, ib: Column) -> Column:
    inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product * ia.cast("double") * ib.cast("double")))
    return F.when((ia == 0) & (ib == 0), 0.0).when((ia == 0) | (ib == 0), 1.0).otherwise(1 - inside)


def cos(a: Column, b: Column, element: Element = Element.f32) -> Column:
    return cos_from_norms(dot(a, b, element), squared_norm(a, element), squared_norm(b, element))


BETWEEN = {Metric.l1: l1, Metric.l2: l2, Metric.cos: cos}


def distance(a: Column, b: Column, metric: Metric | str, element: Element | str = Element.f32) -> Column:
    """Distance of two vector columns."""
    return BETWEEN[Metric.of(metric)](a, b, Element.of(element))


def query_values(query: Sequence[float], element: Element) -> list:
    """The components as the engine holds them."""
    if element is Element.i16:
        if any(int(x) != x or not -32768 <= x <= 32767 for x in query):
            raise EngineError("query components must be i16 integers")
        return [int(x) for x in query]
    kind = np.float16 if element is Element.f16 else np.float32
    with np.errstate(over="ignore"):
        values = np.array(query, np.float64).astype(kind).astype(np.float64)
    if not np.isfinite(values).all():
        raise EngineError("non-finite query component")
    return values.tolist()


def _sum(terms: list[str]) -> Column:
    """Left to right, as the higher-order form. One parsed text: a call into the JVM for each term would take longer than a search."""
    return F.expr(" + ".join(terms))


def _terms(vec: str, q: list, element: Element) -> tuple[list[str], list[str]]:
    """The components of a column and of the query, in SQL; arrays shorter than the query give null."""
    at = [f"get(`{vec}`, {i})" for i in range(len(q))]
    return at, [f"cast({x} as smallint)" if element is Element.i16 else f"cast({x!r}D as float)" for x in q]


def _wide_sql(x: str, element: Element) -> str:
    return f"cast({x} as bigint)" if element is Element.i16 else f"cast({x} as double)"


def _product(vec: str, q: list, element: Element) -> Column:
    at, lit = _terms(vec, q, element)
    return _sum([f"cast({_wide_sql(x, element)} * {_wide_sql(y, element)} as double)" for x, y in zip(at, lit, strict=True)])


def _unrolled(vec: str, q: list, metric: Metric, element: Element) -> Column:
    at, lit = _terms(vec, q, element)
    wide = [(_wide_sql(x, element), _wide_sql(y, element)) for x, y in zip(at, lit, strict=True)]
    if metric is Metric.l1:
        plain = zip(at, lit, strict=True) if element is Element.f32 else wide
        return _sum([f"cast(abs({x} - {y}) as double)" for x, y in plain])
    if metric is Metric.l2:
        return _sum([f"cast(({x} - {y}) * ({x} - {y}) as double)" for x, y in wide])
    norm = _sum([f"cast({x} * {x} as double)" for x, _ in wide])
    return cos_from_norms(_product(vec, q, element), norm, F.lit(float(sum(x * x for x in q))))


def numpy_distances(rows: np.ndarray, q: np.ndarray, metric: Metric, element: Element) -> np.ndarray:
    """rows: n x dim."""
    if metric is Metric.l1:
        if element is Element.f32:
            return np.abs(rows.astype(np.float32) - q.astype(np.float32)).astype(np.float64).sum(axis=1)
        return np.abs(rows.astype(np.float64) - q).sum(axis=1)
    return pair_distances(rows.astype(np.float64), q[None, :], metric)


def pair_l1(a: np.ndarray, b: np.ndarray, element: Element) -> np.ndarray:
    """l1 distance of each row of a to that of b, summed from left to right as in the expressions."""
    kind = np.float32 if element is Element.f32 else np.float64
    return np.cumsum(np.abs(a.astype(kind) - b.astype(kind)), axis=1, dtype=np.float64)[:, -1]


def pair_distances(a: np.ndarray, b: np.ndarray, metric: Metric) -> np.ndarray:
    """l2 or cosine distance of each row of a to that of b; a row's value doesn't depend on the others."""
    if metric is Metric.l2:
        d = a - b
        return (d * d).sum(axis=1)
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.clip((a * b).sum(axis=1) / np.sqrt(na * nb), -1, 1)
    return np.where((na == 0) & (nb == 0), 0.0, np.where((na == 0) | (nb == 0), 1.0, 1 - inside))


def _in_numpy(vec: Column, q: list, metric: Metric, element: Element) -> Column:
    query = np.array(q, np.float64)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        offsets = lists.offsets.to_numpy()
        good = np.asarray(lists.is_valid()) & (np.diff(offsets) == len(query))
        flat = lists.values.to_numpy(zero_copy_only=False)
        out = np.full(len(lists), np.nan)
        if good.all():
            out = numpy_distances(flat[offsets[0] : offsets[-1]].reshape(-1, len(query)), query, metric, element)
        elif good.any():
            rows = np.stack([flat[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(good)])
            out[good] = numpy_distances(rows, query, metric, element)
        return pa.array(out, pa.float64(), mask=~good)

    return run(vec)


def distance_to(vec: str, query: Sequence[float], metric: Metric | str, element: Element | str = Element.f32, strategy: str = "auto") -> Column:
    """Distance of the vector column of this name to one query; strategy: unrolled, numpy, lambda or auto."""
    metric, element = Metric.of(metric), Element.of(element)
    q = query_values(query, element)
    if strategy == "auto":
        strategy = "unrolled" if len(q) <= UNROLLED else "numpy"
    if strategy == "unrolled":
        return _unrolled(vec, q, metric, element)
    if strategy == "numpy":
        return _in_numpy(F.col(vec), q, metric, element)
    if strategy != "lambda":
        raise EngineError(f"unknown strategy: {strategy!r}")
    return BETWEEN[metric](F.col(vec), F.array(*(F.lit(x).cast(element.sql) for x in q)), element)


def stored_cos_to(vec: str, inv_norm: Column, query: Sequence[float], element: Element | str = Element.f32) -> Column:
    """Cosine distance by stored single-precision inverse norms; the query's is in double precision."""
    element = Element.of(element)
    q = query_values(query, element)
    n = sum(x * x for x in q)
    product = _product(vec, q, element) if len(q) <= UNROLLED else dot(F.col(vec), F.array(*(F.lit(x).cast(element.sql) for x in q)), element)
    return cos_from_inverse_norms(product, inv_norm, F.lit(1 / math.sqrt(n) if n else 0.0))


def register_sql(spark) -> None:
    """l1_distance, l2_distance, cosine_distance, dot_product, squared_norm and inverse_norm as SQL functions."""
    fold = "aggregate(zip_with(a, b, (x, y) -> {term}), 0D, (s, t) -> s + t)"
    norm = "aggregate({v}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))"
    wide = "cast(x as double) {op} cast(y as double)"
    bodies = {
        "l1_distance": fold.format(term="cast(abs(x - y) as double)"),
        "l2_distance": fold.format(term="power(" + wide.format(op="-") + ", 2)"),
        "dot_product": fold.format(term=wide.format(op="*")),
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
    na, nb = norm.format(v="a"), norm.format(v="b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION squared_norm(a ARRAY<FLOAT>) RETURNS DOUBLE RETURN {na}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION inverse_norm(a ARRAY<FLOAT>) RETURNS FLOAT RETURN CASE WHEN {na} = 0 THEN cast(0 as float) ELSE cast(1 / sqrt({na}) as float) END")
    inside = f"greatest(-1D, least(1D, {bodies['dot_product']} / sqrt({na} * {nb})))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN {na} = 0 AND {nb} = 0 THEN 0D WHEN {na} = 0 OR {nb} = 0 THEN 1D ELSE 1 - {inside} END")
