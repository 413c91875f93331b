"""A dataset as Parquet: base and delta files by id range, published by immutable manifests.

    <root>/<name>/meta.json              what is fixed
    <root>/<name>/manifest/<n>.json      for each range: version and counts of its base and delta
    <root>/<name>/data/version=<v>/kind=base|delta/file_id=<range>/*.parquet
    <root>/<name>/pending/*.json         operations not yet stored

A change writes new files, then a new manifest: readers see all of it or nothing, and files they
read are never overwritten. Ranges that a change doesn't touch keep their files. A version's name is
its manifest's number and a random part, so a writer that loses the race for a number has
destroyed nothing. Where all ranges of a version still stand, its folder is read as a whole: after a
bulk load the driver names one path, not one for each range. With `dirs`, range f lies in
<dirs[f % number of dirs]>/<name>/data instead.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vespera.functions import metrics
from vespera.operators import knn as search
from vespera.plans import overlay
from vespera.sources.files import Files
from vespera.types import EngineError, Metadata, Metric


@dataclass(frozen=True)
class Manifest:
    """base, delta: file_id -> [version, vectors, deletes]; a base without vectors has no file. written: ranges of `version/kind` as written."""

    number: int
    base: dict[int, list]
    delta: dict[int, list]
    written: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "base": self.base, "delta": self.delta, "written": self.written})

    @classmethod
    def of(cls, text: str) -> Manifest:
        raw = json.loads(text)
        base, delta = ({int(k): v for k, v in raw[kind].items()} for kind in ("base", "delta"))
        if any(f not in base for f in delta):
            raise EngineError("delta without base")
        return cls(raw["number"], base, delta, raw.get("written", {}))


class Store:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.dir = spark, f"{root.rstrip('/')}/{name}"
        self.files = Files(spark, self.dir)

    # -- creation and reading of what is fixed

    def exists(self) -> bool:
        return self.files.exists(f"{self.dir}/meta.json")

    def create(self, meta: Metadata) -> None:
        if self.exists():
            raise EngineError(f"dataset exists: {meta.name}")
        self.files.make(f"{self.dir}/manifest")
        if not self.files.write(f"{self.dir}/meta.json", json.dumps(meta.dict())):
            raise EngineError(f"dataset exists: {meta.name}")

    def drop(self) -> None:
        if not self.exists():
            raise EngineError(f"no such dataset: {self.dir}")
        for folder in self._folders():
            self.files_of(folder).remove(folder)
        self.files.remove(self.dir)

    def files_of(self, folder: str) -> Files:
        return Files(self.spark, folder)

    def _folders(self) -> list[str]:
        """Where data lies: one folder, or one in each of `dirs`."""
        meta = self.meta
        return [f"{d.rstrip('/')}/{meta.name}/data" for d in meta.dirs] or [f"{self.dir}/data"]

    @property
    def meta(self) -> Metadata:
        if not self.exists():
            raise EngineError(f"no such dataset: {self.dir}")
        return Metadata(**json.loads(self.files.read(f"{self.dir}/meta.json")))

    def manifest(self) -> Manifest:
        """The newest one; its number tells readers whether anything changed."""
        numbers = [int(n[:-5]) for n in self.files.names(f"{self.dir}/manifest") if n.endswith(".json")]
        return Manifest.of(self.files.read(f"{self.dir}/manifest/{max(numbers)}.json")) if numbers else Manifest(0, {}, {})

    # -- reading

    def _schema(self, meta: Metadata, delta: bool) -> str:
        norm = ", inv_norm float" if meta.metric is Metric.cos else ""
        return f"id long, vec array<{meta.element.sql}>{norm}" + (", op string" if delta else "")

    def _read(self, meta: Metadata, kind: str, ranges: dict[int, list], written: dict[str, int]) -> DataFrame:
        schema, folders = self._schema(meta, kind == "delta"), self._folders()
        by_version: dict[str, list[int]] = {}
        for f, (v, n, d) in sorted(ranges.items()):
            if n or (kind == "delta" and d):
                by_version.setdefault(v, []).append(f)
        whole = [v for v, fs in by_version.items() if not meta.dirs and len(fs) > 1 and written.get(f"{v}/{kind}") == len(fs)][:32]
        parts = [self.spark.read.schema(schema).parquet(f"{folders[0]}/version={v}/kind={kind}").drop("file_id") for v in whole]
        paths = [f"{folders[meta.dir_slot(f)]}/version={v}/kind={kind}/file_id={f}" for v, fs in by_version.items() if v not in whole for f in fs]
        if paths:
            parts.append(self.spark.read.schema(schema).parquet(*paths))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def base_rows(self, m: Manifest, only=None) -> DataFrame:
        return self._read(self.meta, "base", {f: x for f, x in m.base.items() if only is None or f in only}, m.written)

    def delta_rows(self, m: Manifest, only=None) -> DataFrame:
        return self._read(self.meta, "delta", {f: x for f, x in m.delta.items() if only is None or f in only}, m.written)

    def rows(self, m: Manifest | None = None, only=None) -> DataFrame:
        """The visible rows (id, vec[, inv_norm]); ranges without a delta are read as they are."""
        m = m or self.manifest()
        touched = {f for f in m.delta if only is None or f in only}
        clean = self._read(self.meta, "base", {f: x for f, x in m.base.items() if f not in touched and (only is None or f in only)}, m.written)
        if not touched:
            return clean
        return clean.unionByName(overlay.visible(self.base_rows(m, touched), self.delta_rows(m, touched)))

    def get(self, id_: int) -> list | None:
        """The vector of an id, from the files of its range alone."""
        found = self.rows(only={self.meta.file_id(id_)}).where(F.col("id") == id_).select("vec").head(1)
        return list(found[0]["vec"]) if found else None

    def knn(self, query, k=None, **more) -> DataFrame:
        meta = self.meta
        if len(search.check_query(query)) != meta.dim:
            raise EngineError("truncated vector payload" if len(query) < meta.dim else "extra tokens in vector payload")
        stored = "inv_norm" if meta.metric is Metric.cos else None
        return search.knn(self.rows(), query, k, meta.metric, meta.element, inv_norm_col=stored, **more)

    # -- changes

    def _complete(self, rows: DataFrame) -> DataFrame:
        meta = self.meta
        vec = F.col("vec").cast(f"array<{meta.element.sql}>")
        out = rows.select("id", vec.alias("vec"), "op")
        return out.withColumn("inv_norm", F.when(F.col("vec").isNotNull(), metrics.inverse_norm(F.col("vec"), meta.element))) if meta.metric is Metric.cos else out

    def apply(self, updates: DataFrame, bulk: bool) -> Manifest:
        """Takes in updates (id, vec, op), one row an id. Each range decides by its own counts between base and delta.

        Deletes for a range without base are an error in a bulk load, else nothing.
        """
        meta, m = self.meta, self.manifest()
        rows = self._complete(updates).withColumn("file_id", overlay.file_of("id", meta.range_size))
        if bulk and not m.base and not meta.dirs:
            return self._first(m, rows)
        counts = rows.groupBy("file_id").agg(F.count_if(F.col("op") == "U").alias("u"), F.count_if(F.col("op") == "D").alias("d")).collect()
        if not counts:
            return m
        affected = {r["file_id"]: (r["u"], r["d"]) for r in counts}
        fresh = {f for f in affected if f not in m.base}
        if bulk and any(affected[f][1] for f in fresh):
            raise EngineError("invalid deleted items: their range holds no vectors")
        over = {f for f in affected if f in m.delta}
        change, size = rows, {f: u + d for f, (u, d) in affected.items()}
        if over:
            old = self.delta_rows(m, over).withColumn("file_id", overlay.file_of("id", meta.range_size))
            mine = rows.where(F.col("file_id").isin(list(over)))
            change = rows.where(~F.col("file_id").isin(list(over))).unionByName(overlay.merge_deltas(old, mine))
            size |= {r["file_id"]: r["n"] for r in change.where(F.col("file_id").isin(list(over))).groupBy("file_id").agg(F.count("*").alias("n")).collect()}
        to_base = fresh | {f for f in affected if f in m.base and m.base[f][1] < size[f] * meta.data_merge_ratio}
        return self._write(m, change, to_base, set(affected) - to_base)

    def _first(self, m: Manifest, rows: DataFrame) -> Manifest:
        """A bulk load without any base: all ranges are new, so rows are written at once and deletes counted on the way."""
        seen = Observation()
        vectors = rows.observe(seen, F.count_if(F.col("op") == "D").alias("deletes")).where("op = 'U'")
        version, found = self._files(m, vectors.withColumn("kind", F.lit("base")))
        deletes = seen.get["deletes"] if found else rows.where("op = 'D'").limit(1).count()  # a plan without rows may lose its metrics
        if deletes or not found:
            for folder in self._folders():
                self.files_of(folder).remove(f"{folder}/version={version}")
        if deletes:
            raise EngineError("invalid deleted items: their range holds no vectors")
        return self._publish(m, {f: x for (_, f), x in found.items()}, {}, version, found) if found else m

    def compact(self) -> Manifest:
        """Folds every delta into its base."""
        m = self.manifest()
        if not m.delta:
            return m
        change = self.delta_rows(m).withColumn("file_id", overlay.file_of("id", self.meta.range_size))
        return self._write(m, change, set(m.delta), set())

    def _write(self, m: Manifest, change: DataFrame, to_base: set[int], to_delta: set[int]) -> Manifest:
        in_base = F.col("file_id").isin(list(to_base))
        parts = []
        if to_base:
            mine = change.where(in_base).drop("file_id")
            old = {f for f in to_base if f in m.base}
            merged = overlay.merge_into_base(self.base_rows(m, old), mine) if old else mine.where("op = 'U'").drop("op")
            parts.append(merged.withColumn("op", F.lit("U")).withColumn("kind", F.lit("base")))
        if to_delta:
            parts.append(change.where(~in_base).drop("file_id").withColumn("kind", F.lit("delta")))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        version, found = self._files(m, out.withColumn("file_id", overlay.file_of("id", self.meta.range_size)))
        base = m.base | {f: found.get(("base", f), [version, 0, 0]) for f in to_base}
        delta = {f: x for f, x in m.delta.items() if f not in to_base} | {f: found[("delta", f)] for f in to_delta if ("delta", f) in found}
        return self._publish(m, base, delta, version, found)

    def _files(self, m: Manifest, out: DataFrame) -> tuple[str, dict[tuple[str, int], list]]:
        """Writes rows with kind and file_id as a new version; its name, and what the files hold for each kind and range."""
        version, folders = f"{m.number + 1}-{uuid.uuid4().hex[:8]}", self._folders()
        found: dict[tuple[str, int], list] = {}
        for slot, folder in enumerate(folders):
            own = out.where(F.pmod("file_id", F.lit(len(folders))) == slot) if len(folders) > 1 else out
            path = f"{folder}/version={version}"
            own.repartition("kind", "file_id").sortWithinPartitions("kind", "file_id", "id").write.partitionBy("kind", "file_id").parquet(path)
            there = self.spark.read.schema("id long, op string, kind string, file_id long").parquet(path)
            for r in there.groupBy("kind", "file_id").agg(F.count_if(F.col("op") == "U").alias("u"), F.count_if(F.col("op") == "D").alias("d")).collect():
                found[r["kind"], r["file_id"]] = [version, r["u"], r["d"]]
        return version, found

    def _publish(self, m: Manifest, base: dict[int, list], delta: dict[int, list], version: str, found: dict[tuple[str, int], list]) -> Manifest:
        number = m.number + 1
        live = {x[0] for x in [*base.values(), *delta.values()]}
        written = {k: n for k, n in m.written.items() if k.split("/")[0] in live} | {f"{version}/{kind}": sum(k == kind for k, _ in found) for kind in ("base", "delta")}
        new = Manifest(number, base, delta, written)
        if not self.files.write(f"{self.dir}/manifest/{number}.json", new.text()):
            raise EngineError("another writer published a change first")
        return new

    def vacuum(self) -> None:
        """Removes files and manifests that the newest manifest doesn't name; no reader may still use older ones."""
        m = self.manifest()
        live = {x[0] for x in [*m.base.values(), *m.delta.values()]}
        for folder in self._folders():
            files = self.files_of(folder)
            for name in files.names(folder):
                if name.startswith("version=") and name[8:] not in live:
                    files.remove(f"{folder}/{name}")
        for name in self.files.names(f"{self.dir}/manifest"):
            if name.endswith(".json") and int(name[:-5]) < m.number:
                self.files.remove(f"{self.dir}/manifest/{name}")

    # -- diagnostics

    def stats(self) -> DataFrame:
        """kind, file_id, vectors, deleted of each file, as stored."""
        m = self.manifest()
        rows = [(k, f, n, d) for k, part in (("base", m.base), ("delta", m.delta)) for f, (_, n, d) in sorted(part.items())]
        return self.spark.createDataFrame(rows, "kind string, file_id long, vectors long, deleted long")

    def printable(self) -> DataFrame:
        """id, vec of visible rows by range, base before delta, then id."""
        m, size = self.manifest(), self.meta.range_size
        hidden = self.delta_rows(m).select("id")
        base = self.base_rows(m).join(hidden, "id", "left_anti").select("id", "vec", F.lit(0).alias("part"))
        delta = self.delta_rows(m).where("op = 'U'").select("id", "vec", F.lit(1).alias("part"))
        return base.unionByName(delta).orderBy(overlay.file_of("id", size), "part", "id").select("id", "vec")

    def check(self) -> DataFrame:
        """Faults: ids twice in one file, or outside their range."""
        m, size = self.manifest(), self.meta.range_size
        both = self.base_rows(m).select("id", F.lit("base").alias("kind")).unionByName(self.delta_rows(m).select("id", F.lit("delta").alias("kind")))
        twice = both.groupBy("kind", "id").count().where("count > 1").select("kind", "id", F.lit("twice").alias("fault"))
        return twice.unionByName(both.where((F.col("id") < 0) | ~overlay.file_of("id", size).isin(list(m.base))).select("kind", "id", F.lit("range").alias("fault")))
