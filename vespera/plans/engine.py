"""The engine: datasets under one root, one of them open at a time."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.functions import vectext
from vespera.operators import knn as search
from vespera.plans import sql as surface
from vespera.plans.lock import OwnerLock
from vespera.plans.pending import Pending
from vespera.plans.store import Store
from vespera.sources import generate as gen
from vespera.sources import ini, vecfile
from vespera.types import DEFAULT_K, EngineError, Element, Metadata, Metric, check_id, check_name

log = logging.getLogger("vespera")


class Dataset:
    """An open dataset: stored rows, and pending operations, which no query sees before they are flushed."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.store = Store(spark, root, name)
        self.meta: Metadata = self.store.meta
        self.lock = OwnerLock(self.store.files, f"{self.store.dir}/owner.lock")
        self.pending = Pending(self.store.files, f"{self.store.dir}/pending", self.meta)

    # -- changes

    def upsert(self, id_: int, vector: str | list) -> None:
        values = vectext.parse_vector(vector, self.meta.element, self.meta.dim, vectext.has_commas(vector)) if isinstance(vector, str) else self._values(vector)
        self.apply([(check_id(id_), values)])

    def upsert_scalar(self, id_: int, scalar: float) -> None:
        self.apply([(check_id(id_), vectext.fill_vector(scalar, self.meta.element, self.meta.dim))])

    def delete(self, id_: int) -> None:
        self.apply([(check_id(id_), None)])

    def _values(self, vector: list) -> list:
        return vectext.parse_vector(", ".join(map(repr, vector)), self.meta.element, self.meta.dim)

    def apply(self, ops: list[tuple[int, list | None]]) -> None:
        """Adds operations to the pending ones; flushes first whenever one doesn't fit in the budget."""
        self.lock.demand()
        batch: list[tuple[int, list | None]] = []
        taken = 0
        for id_, vec in ops:
            size = 8 if vec is None else self.meta.vector_bytes
            if not self.pending.fits(id_, vec) or self.pending.bytes + taken + size > self.meta.accumulator_size:
                if batch:
                    self.pending.add(batch)
                    batch, taken = [], 0
                if not self.pending.fits(id_, vec):
                    self.flush()
                if not self.pending.fits(id_, vec):
                    raise EngineError("accumulator_size is too small for one operation")
            batch.append((id_, vec))
            taken += size
        if batch:
            self.pending.add(batch)

    def flush(self) -> None:
        """Stores the pending operations; they count as newer than anything stored meanwhile."""
        rows = self.pending.rows()
        if not rows:
            return
        self.lock.demand()
        self.store.apply(self.spark.createDataFrame(rows, f"id long, vec array<{self.meta.element.sql}>, op string"), bulk=False)
        self.pending.reset()

    def load(self, rows: DataFrame, element: Element | str | None = None, dim: int | None = None) -> None:
        """Bulk load of (id, vec[, op]); the rows must match the dataset's type and dimension and have each id once."""
        if element is not None and Element.of(element) is not self.meta.element:
            raise EngineError(f"input type {Element.of(element).value} differs from the dataset's {self.meta.type}")
        if dim is not None and dim != self.meta.dim:
            raise EngineError(f"input dim {dim} differs from the dataset's {self.meta.dim}")
        self.lock.demand()
        if "op" not in rows.columns:
            rows = rows.select("id", "vec", F.lit("U").alias("op"))
        vecfile.check_unique(rows)
        self.store.apply(self._checked(rows), bulk=True)

    def _checked(self, rows: DataFrame) -> DataFrame:
        fail = lambda m, kind: F.raise_error(F.lit(m)).cast(kind)
        kind = f"array<{self.meta.element.sql}>"
        vec = F.col("vec").cast(kind)
        id_ = F.when(F.col("id").isNull() | (F.col("id") < 0), fail("id must be an integer from 0", "bigint")).otherwise(F.col("id").cast("bigint"))
        odd = (F.col("op") == "U") & (F.col("vec").isNull() | (F.size("vec") != self.meta.dim))
        out = F.when(odd, fail("vectors must have the dataset's dimension", kind)).when(F.col("op") == "D", F.lit(None).cast(kind))
        if self.meta.element is not Element.i16:
            bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            out = out.when(bad, fail("non-finite component", kind))
        vec = vectext.half(vec) if self.meta.element is Element.f16 else vec
        return rows.select(id_.alias("id"), out.otherwise(vec).alias("vec"), "op")

    def compact(self) -> None:
        self.lock.demand()
        self.store.compact()

    def close(self) -> None:
        """Flushes what this writer added; operations only replayed stay in the log."""
        if self.lock.mine and self.pending.fresh:
            self.flush()
        self.lock.release()

    # -- reading

    def rows(self) -> DataFrame:
        return self.store.rows()

    def get(self, id_: int) -> list | None:
        return self._again(lambda: self.store.get(check_id(id_)))

    @staticmethod
    def _again(run, times: int = 3):
        """run(), once more with the newest version where files went meanwhile (`vacuum` by a writer)."""
        for left in reversed(range(times)):
            try:
                return run()
            except Exception as e:
                if not left or not any(x in str(e) for x in ("FILE_NOT_EXIST", "PATH_NOT_FOUND", "FileNotFound")):
                    raise

    def knn(self, query: str | list, k: int | None = None, show: bool = False, **more) -> DataFrame:
        """(id, distance) of the k nearest; show adds the query's text (of `@path` the file's contents) and k."""
        if show and not isinstance(query, str):
            query = vectext.format_vector(query, self.meta.element)
        if isinstance(query, str):
            text = vectext.load_query(self.spark, query)
            if not text.strip():
                raise EngineError("query must not be empty")
            query = vectext.parse_vector(text, self.meta.element, self.meta.dim, vectext.has_commas(text))
            more |= {"shown": text} if show else {}
        began = time.perf_counter()
        out = self.store.knn(query, k, **more)
        log.info("knn %s metric=%s type=%s dim=%d k=%s planned in %.1f ms", self.name, self.meta.dist_func, self.meta.type, self.meta.dim, k, 1000 * (time.perf_counter() - began))
        return out

    def find_ids(self, query, k: int = DEFAULT_K, **more) -> list[int]:
        return self._again(lambda: [r["id"] for r in self.knn(query, k, **more).collect()])


class Engine:
    """Named datasets below one folder. A context manager that closes what is open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.dataset: Dataset | None = None
        self._found: list[int] = []
        self._got = ""
        self._surface: surface.Following | None = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.disconnect()

    def disconnect(self) -> None:
        if self.dataset:
            self.dataset.close()
            self.dataset = None

    @property
    def open_dataset(self) -> Dataset:
        if not self.dataset:
            raise EngineError("no dataset is open")
        return self.dataset

    def create(self, name: str, dim: int = 4, type: str = "f32", range_size: int = 1000, dist_func: str = "l1", **more) -> Dataset:
        """Creates and opens a dataset; everything is checked before anything is written."""
        if range_size <= 10:
            raise EngineError("range_size must be > 10")
        if self.dataset:
            raise EngineError("a dataset is open already")
        Store(self.spark, self.root, check_name(name)).create(Metadata(name=name, dim=dim, type=type, range_size=range_size, dist_func=dist_func, **more))
        return self.open(name)

    def create_from_ini(self, path: str) -> Dataset:
        text = self.spark.read.text(path, wholetext=True).head(1)
        meta = ini.metadata_from_ini(path, text[0][0] if text else "")
        Store(self.spark, self.root, meta.name).create(meta)
        return self.open(meta.name)

    def open(self, name: str) -> Dataset:
        if self.dataset:
            raise EngineError("a dataset is open already")
        self.dataset = Dataset(self.spark, self.root, check_name(name))
        return self.dataset

    def close(self, name: str) -> None:
        if self.open_dataset.name != name:
            raise EngineError(f"another dataset is open: {self.dataset.name}")
        self.disconnect()

    def drop(self, name: str) -> None:
        if self.dataset and self.dataset.name == name:
            self.dataset.lock.release()
            self.dataset = None
        store = Store(self.spark, self.root, check_name(name))
        if not store.exists():
            raise EngineError(f"no such dataset: {name}")
        lock = OwnerLock(store.files, f"{store.dir}/owner.lock")
        lock.demand()
        store.drop()
        lock.release()

    def upsert(self, id_: int, vector) -> None:
        self.open_dataset.upsert(id_, vector)

    def ups2(self, id_: int, scalar: float) -> None:
        self.open_dataset.upsert_scalar(id_, scalar)

    def delete(self, id_: int) -> None:
        self.open_dataset.delete(id_)

    def merge_accumulator(self) -> None:
        self.open_dataset.flush()

    def merge_delta(self) -> None:
        self.open_dataset.compact()

    def load_file(self, path: str) -> None:
        header, rows = vecfile.read_vectors(self.spark, path)
        self.open_dataset.load(rows, header.element, header.dim)

    def load_dataframe(self, rows: DataFrame, id_col: str = "id", vec_col: str = "vec") -> None:
        self.open_dataset.load(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *(["op"] if "op" in rows.columns else [])))

    def generate(self, count: int, start_id: int = 0, pattern: int = gen.SEQUENTIAL, max_val: float = 1000, every_n_deleted: int = 0, binary: bool = False) -> None:
        meta = self.open_dataset.meta
        self.open_dataset.load(gen.generate(self.spark, count, start_id, pattern, meta.dim, meta.element, max_val, every_n_deleted, binary))

    def generate_bin(self, count: int, start_id: int = 0, pattern: int = gen.SEQUENTIAL, max_val: float = 1000) -> None:
        self.generate(count, start_id, pattern, max_val, binary=True)

    def knn(self, query, k: int = DEFAULT_K, **more) -> list[int]:
        search.effective_k(k, None)
        self._found = self.open_dataset.find_ids(query, k, **more)
        return self._found

    def sql(self, text: str) -> DataFrame:
        """SQL over the open dataset, as it is published now: a view of its name, and its table functions."""
        d = self.open_dataset
        if self._surface is None or self._surface.stores.get(d.name, [None])[0] is not d.store:
            self._surface = surface.Following(self.spark)
            surface.register(self.spark)
            self._surface.attach(d.name, d.store)
        return self._surface.sql(text)

    def kres(self, index: int = -1) -> int:
        """The number of ids that the last knn found (-1), or one of them; 0 beyond them."""
        if index == -1:
            return len(self._found)
        return self._found[index] if 0 <= index < len(self._found) else 0

    def get(self, id_: int) -> str:
        found = self.open_dataset.get(id_)
        self._got = ""
        if found is None:
            raise EngineError("Vector not found")
        self._got = vectext.format_vector(found, self.open_dataset.meta.element)
        return self._got

    def gres(self) -> str:
        return self._got

    def ids_of(self, vector: str | list) -> DataFrame:
        """Ids whose stored vector equals the given one."""
        d = self.open_dataset
        values = vectext.parse_vector(vector, d.meta.element, d.meta.dim, vectext.has_commas(vector)) if isinstance(vector, str) else vector
        return d.rows().where(F.col("vec") == F.array(*(F.lit(x).cast(d.meta.element.sql) for x in values))).select("id").orderBy("id")

    def lines(self) -> DataFrame:
        """Lines `id : [ ... ]` of all stored rows, in order of ranges, base before delta."""
        d = self.open_dataset
        return vecfile.text_lines(d.store.printable(), d.meta.element).select("line")

    def print_rows(self) -> None:
        for r in self.lines().toLocalIterator():
            print(r["line"])

    def stats(self) -> dict:
        d = self.open_dataset
        rows = d.store.stats().collect()
        return {
            "dataset": d.meta.dict(),
            "accumulator": {"vectors": len(d.pending.added), "deleted": len(d.pending.deleted)},
            "files": [r.asDict() for r in rows],
            "version": d.store.manifest().number,
        }

    @property
    def metric(self) -> Metric:
        return self.open_dataset.meta.metric
