"""Element types, metrics, limits and the one error class of the engine."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import types as T

MIN_DIM, MAX_DIM, MAX_ID, DEFAULT_K = 4, 4096, (1 << 63) - 1, 10


class EngineError(ValueError):
    """Any failure of the engine; the message says what was wrong."""


class Element(str, Enum):
    """Component types; f16 is kept as floats rounded through IEEE half precision."""

    f16 = "f16"
    f32 = "f32"
    i16 = "i16"

    @property
    def code(self) -> int:
        return {"f16": 0, "f32": 1, "i16": 2}[self.value]

    @property
    def size(self) -> int:
        return {"f16": 2, "f32": 4, "i16": 2}[self.value]

    @property
    def numpy(self) -> str:
        return {"f16": "<f2", "f32": "<f4", "i16": "<i2"}[self.value]

    @property
    def spark(self) -> T.DataType:
        return T.ShortType() if self is Element.i16 else T.FloatType()

    @property
    def sql(self) -> str:
        return "smallint" if self is Element.i16 else "float"

    @classmethod
    def of(cls, name: str) -> Element:
        try:
            return cls(name)
        except ValueError:
            raise EngineError(f"unknown element type: {name!r}; f32, f16 or i16 is needed") from None


class Metric(str, Enum):
    """l2 is squared, without a root."""

    l1 = "l1"
    l2 = "l2"
    cos = "cos"

    @classmethod
    def of(cls, name: str) -> Metric:
        try:
            return cls(name)
        except ValueError:
            raise EngineError(f"unknown metric: {name!r}; l1, l2 or cos is needed") from None


def check_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name or "") or name in (".", ".."):
        raise EngineError(f"invalid dataset name: {name!r}")
    return name


def check_id(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= MAX_ID:
        raise EngineError(f"id must be an integer from 0 to {MAX_ID}: {value!r}")
    return value


def check_dim(dim: int) -> int:
    if not isinstance(dim, int) or not MIN_DIM <= dim <= MAX_DIM:
        raise EngineError(f"dim must be from {MIN_DIM} to {MAX_DIM}: {dim!r}")
    return dim


@dataclass(frozen=True)
class Metadata:
    """What is fixed for a dataset."""

    name: str
    dim: int = 4
    type: str = "f32"
    dist_func: str = "l1"
    range_size: int = 10_000
    data_merge_ratio: int = 2
    accumulator_size: int = 64 * 1024
    dirs: tuple[str, ...] = field(default=())

    def __post_init__(self):
        check_name(self.name)
        check_dim(self.dim)
        Element.of(self.type)
        Metric.of(self.dist_func)
        if self.range_size <= 0:
            raise EngineError("range_size must be > 0")
        object.__setattr__(self, "dirs", tuple(self.dirs))

    @property
    def element(self) -> Element:
        return Element.of(self.type)

    @property
    def metric(self) -> Metric:
        return Metric.of(self.dist_func)

    def dict(self) -> dict:
        return asdict(self) | {"dirs": list(self.dirs)}

    def file_id(self, id_: int) -> int:
        return id_ // self.range_size

    def dir_slot(self, file_id: int) -> int:
        return file_id % len(self.dirs) if self.dirs else 0

    @property
    def vector_bytes(self) -> int:
        """Of a pending vector: id, components padded to 32 bytes, and the inverse norm of cosine datasets."""
        return 8 + -(-self.dim * self.element.size // 32) * 32 + 4 * (self.metric is Metric.cos)
