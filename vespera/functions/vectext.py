"""Vectors as text: parsing on the driver and as expressions, formatting, half precision."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vespera.types import EngineError, Element

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
INTEGER = r"[+-]?\d+"
SPECIAL = r"[+-]?(?:inf|infinity|nan)"


def has_commas(text: str) -> bool:
    return "," in text


def parse_vector(text: str, element: Element | str, dim: int, commas: bool = True) -> list:
    """Components of `1, 2.5` or `1 2.5`, in brackets or not; runs of separators count as one."""
    element = Element.of(element)
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    tokens = [t for t in re.split(r"[, ]+" if commas else r" +", text) if t]
    if len(tokens) < dim:
        for t in tokens:
            _number(t, element)
        raise EngineError("truncated vector payload")
    values = [_number(t, element) for t in tokens[:dim]]
    if len(tokens) > dim:
        raise EngineError("extra tokens in vector payload")
    return values


def _number(token: str, element: Element):
    if element is Element.i16:
        if not re.fullmatch(INTEGER, token):
            raise EngineError("invalid i16 token")
        if not -32768 <= int(token) <= 32767:
            raise EngineError("i16 token out of range")
        return int(token)
    if re.fullmatch(SPECIAL, token, re.IGNORECASE):
        raise EngineError(f"non-finite {element.value} token")
    if not re.fullmatch(NUMBER, token):
        raise EngineError(f"invalid {element.value} token")
    with np.errstate(over="ignore"):
        single = np.float32(float(token))
        value = float(np.float16(single)) if element is Element.f16 else float(single)
    if not math.isfinite(value):
        raise EngineError(f"non-finite {element.value} token")
    return value


def fill_vector(scalar: float, element: Element | str, dim: int) -> list:
    """One scalar for all components; for i16 its fraction is cut off."""
    element = Element.of(element)
    if not math.isfinite(scalar):
        raise EngineError("scalar must be finite")
    if element is Element.i16:
        if not -32768 <= scalar <= 32767:
            raise EngineError("scalar out of i16 range")
        return [int(scalar)] * dim
    with np.errstate(over="ignore"):
        value = float(np.float32(scalar).astype(np.float16) if element is Element.f16 else np.float32(scalar))
    if not math.isfinite(value):
        raise EngineError("scalar isn't finite in this element type")
    return [value] * dim


def load_query(spark: SparkSession | None, text: str) -> str:
    """The query text; `@path` stands for a file's contents without its last line ends."""
    if not text.startswith("@"):
        return text
    path = text[1:]
    try:
        if spark is not None:
            rows = spark.read.text(path, wholetext=True).head(1)
            return (rows[0][0] if rows else "").rstrip("\r\n")
        with open(path) as f:
            return f.read().rstrip("\r\n")
    except Exception as e:
        raise EngineError(f"failed to open file: {path}") from e


def format_vector(values, element: Element | str = Element.f32) -> str:
    """`[ 1, 2.5 ]`: nine significant digits, integers as they are."""
    show = (lambda x: "%d" % x) if Element.of(element) is Element.i16 else (lambda x: "%.9g" % x)
    return "[ " + ", ".join(show(x) for x in values) + " ]"


def formatted(vec: Column, element: Element | str = Element.f32) -> Column:
    element = Element.of(element)
    if element is Element.i16:
        return F.concat(F.lit("[ "), F.array_join(F.transform(vec, lambda x: x.cast("string")), ", "), F.lit(" ]"))

    @F.arrow_udf("string")
    def run(vectors: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format_vector(v) for v in vectors.to_pylist()], pa.string())

    return run(vec)


def half(vec: Column) -> Column:
    """Components rounded through half precision; beyond its range they become infinite."""

    @F.arrow_udf("array<float>")
    def run(vectors: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            return pa.array([None if v is None else np.array(v, np.float16).astype(np.float32) for v in vectors.to_pylist()], pa.list_(pa.float32()))

    return run(vec)


def parsed(text: Column, element: Element | str, dim: int, commas: bool = True) -> Column:
    """Components of a text column; a text that isn't exactly `dim` numbers of the type is an error."""
    element = Element.of(element)
    pattern = "[, ]+" if commas else " +"
    tokens = F.array_remove(F.split(text, pattern), "")
    name = element.value
    form = INTEGER if element is Element.i16 else NUMBER
    number = lambda t: F.when(t.rlike(f"^{form}$"), t.try_cast("bigint" if element is Element.i16 else "float"))
    values = F.transform(tokens, number)
    fail = lambda m: F.raise_error(F.lit(m)).cast(f"array<{element.sql}>")
    odd = F.exists(tokens, lambda t: ~t.rlike(f"^{form}$"))
    special = F.exists(tokens, lambda t: F.lower(t).rlike(f"^{SPECIAL}$"))
    out = F.when(text.isNull(), F.lit(None).cast(f"array<{element.sql}>"))
    if element is Element.i16:
        out = out.when(odd, fail("invalid i16 token")).when(F.exists(values, lambda x: ~x.between(-32768, 32767)), fail("i16 token out of range"))
    else:
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        out = out.when(special, fail(f"non-finite {name} token")).when(odd, fail(f"invalid {name} token")).when(F.exists(values, lambda x: ~finite(x)), fail(f"non-finite {name} token"))
    out = out.when(F.size(tokens) < dim, fail("truncated vector payload")).when(F.size(tokens) > dim, fail("extra tokens in vector payload"))
    vec = F.transform(values, lambda x: x.cast(element.sql))
    if element is Element.f16:
        h = half(vec)
        vec = F.when(F.exists(h, lambda x: F.abs(x) == float("inf")), fail("non-finite f16 token")).otherwise(h)
    return out.otherwise(vec)
