"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds the hashes of its distinct 5-word shingles. Its sketch has one coordinate
per bin: in each round every element falls into a hashed bin with a hashed value, the smallest
value of the first round that reaches a bin stays, and after `bins` rounds each further round fills
one certain bin, so every coordinate is filled and estimates concentrate. Documents that agree in
all rows of some band are candidates: with 48 bands of 5 rows, a pair at the similarity of 0.75
escapes with a probability of 2.3e-6.

Equal sets are first joined into one representative. In a bucket all members are compared with its
smallest one, and where many stay outside the largest component, with up to three others (each bucket
has its own). Where a bucket is in several components then, the members outside the largest are compared
with it and among each other in blocks of bounded size, except within a component. So no link between components is
lost, no group comes into one task whole, and equal or alike groups of any size cost one
comparison a member. Links hold on full sets: 100 * intersection >= 75 * union.

Ids are numbers and are compared as 64-bit integers; a string id that isn't one is an error under ANSI
SQL, else a null id. Further columns may have any names and stay as they are.

A null or empty text has an empty set and is linked with nothing. A null id is linked with nothing
either: its component is null and it is kept. Each row stays in the result. Rows with the same id and
different texts are judged each by its own text; where the id is the smallest holder of several texts,
these share their links. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import BROADCAST, among, blocks, map_arrow, small, written
from vespera.llm.components import components
from vespera.llm.wordhash import grams, inside, mixed, words_of

BINS, ROWS, BLOCK = 240, 5, 256
STARS, LARGE = 3, 64  # turns of further comparisons with one member, in buckets with more members than this outside their largest component


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, lower=True)
    gram, at = grams(words.hashes, n, 3), inside(words.first, n)
    counts = words.counts
    own = np.concatenate([[0], np.cumsum(np.maximum(0, counts - n + 1))])
    picked = gram[at]
    out = []
    for i, k in enumerate(counts):
        if k >= n:
            x = np.sort(picked[own[i] : own[i + 1]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif k:
            out.append(grams(words.hashes[words.first[i] : words.first[i + 1]], int(k), 100 + int(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of `bins` coordinates for each set; all coordinates of an empty set are the largest number."""
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), bins), unset)
    active = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    elements = np.concatenate([sets[i] for i in active]) if len(active) else np.zeros(0, np.uint64)
    owner = np.repeat(active, [len(sets[i]) for i in active])
    for r in range(2 * bins):
        if not len(active):
            break
        h = mixed(elements, r + 1)
        at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
        value = (mixed(h, 9) >> np.uint64(16)) | np.uint64(r << 48)
        np.minimum.at(out.reshape(-1), owner * bins + at, value)
        if r < 8 or r % 16 == 0:
            open_ = (out[active] == unset).any(axis=1)
            if not open_.all():
                stay = np.zeros(len(sets), bool)
                stay[active[open_]] = True
                keep = stay[owner]
                active, elements, owner = active[open_], elements[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        key = mixed(key ^ parts[:, :, j], j)
    return mixed(key + np.arange(parts.shape[1], dtype=np.uint64)[None, :], 5)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        sets = shingle_sets(part.column("text"))
        keys = band_keys(sketches(sets)).view(np.int64)
        size = np.array([len(s) for s in sets], np.int64)
        digest = [np.array([s.sum(), mixed(s, 21).sum()], np.uint64).tobytes() if len(s) else None for s in sets]
        width = keys.shape[1]
        filled = np.concatenate([[0], np.cumsum(np.where(size > 0, width, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(filled), pa.array(keys[size > 0].reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(size), pa.array(digest, pa.binary()), bands], ["doc", "n_shingles", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        sets = shingle_sets(part.column("text"))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))], ["doc", "shingles"])


def _enough(inter, union, percent: int):
    return 100 * inter >= percent * union


def links_within(docs: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int = 75) -> list[tuple[int, int]]:
    """Links that connect what is connected among these documents; nothing is compared within a component."""
    n = len(docs)
    root = np.unique(labels, return_inverse=True)[1]
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    marked, found = np.zeros(len(values), np.int64), []
    for i in range(n - 1):
        others = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(others):
            if (root == root[0]).all():
                break
            continue
        mine = ids[bounds[i] : bounds[i + 1]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[ids], bounds[:-1])[others]
        marked[mine] = 0
        for j in others[_enough(shared, sizes[i] + sizes[others] - shared, percent)]:
            if root[j] != root[i]:
                found.append((int(docs[i]), int(docs[j])))
                root[root == root[j]] = root[i]
    return found


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = written(map_arrow(rows, _signatures, "doc long, n_shingles long, digest binary, bands array<long>"), "signatures")
    sets = written(signed.where("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "sets")

    buckets = sets.select("rep", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head <> last").select("bucket", "head")
    shared = written(buckets.join(heads, "bucket"), "buckets")  # only the buckets with several members
    members = written(shared.select(F.col("rep").alias("doc")).distinct(), "members")
    shingles = written(map_arrow(among(rows, members, "doc"), _sets, "doc long, shingles array<long>"), "shingles")  # repeated rows repeat; that adds no link
    links = _verified(shared.where("rep <> head").select("rep", "head").distinct(), shingles, percent)
    label = components(links)
    for turn in range(STARS):
        pairs = _star(shared, label, turn)
        if pairs is None:
            break
        links = written(links.unionByName(_verified(pairs, shingles, percent)), "links")
        label = components(links)
    more = _remaining(shared, shingles, label, percent)
    if more is not None:
        label = components(links.unionByName(more))
    named = sets.join(label, sets["rep"] == label["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(named, "digest", "left").select(F.col("doc").alias(id_col), "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (rep, head) that are links on their full sets, as (a, b). Few pairs go to the sets, which are shuffled once."""
    pairs = written(pairs, "pairs")
    heads = written(pairs.select("head").distinct(), "heads")
    x = shingles.select(F.col("doc").alias("rep"), F.col("shingles").alias("x")).join(small(pairs), "rep")
    y = among(shingles.select(F.col("doc").alias("head"), F.col("shingles").alias("y")), heads, "head")
    both = F.size(F.array_intersect("x", "y"))
    found = x.join(y, "head").where(_enough(both, F.size("x") + F.size("y") - both, percent))
    return written(found.select(F.col("rep").alias("a"), F.col("head").alias("b")), "verified")


def _labelled(shared: DataFrame, label: DataFrame) -> DataFrame:
    return shared.join(label, shared["rep"] == label["node"], "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))


def _star(shared: DataFrame, label: DataFrame, turn: int) -> DataFrame | None:
    """For buckets with many members outside their largest component: pairs of a hashed member with all outside its own."""
    now, split = _split(shared, label, turn)
    heads = written(split.where(F.col("n") - F.col("major.n") > LARGE).select("bucket", F.col("pick.rep").alias("head"), F.col("pick.component").alias("own")), "heads")
    if not heads.limit(1).count():
        return None
    return now.join(heads, "bucket").where("component <> own").select("rep", "head").distinct()


def _split(shared: DataFrame, label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members with their components; and of each bucket in several components its size, largest component, a member and a print."""
    now = written(_labelled(shared, label), "labelled")
    pick = F.min(F.struct(F.xxhash64("bucket", "rep", F.lit(turn)).alias("h"), "rep", "component")).alias("pick")
    sizes = now.groupBy("bucket", "component").agg(F.count("*").alias("n"), pick, F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("print"))
    whole = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("major"), F.min("pick").alias("pick"), F.count("*").alias("parts"), F.sum("print").alias("print"))
    return now, whole.where("parts > 1")


def _remaining(shared: DataFrame, shingles: DataFrame, label: DataFrame, percent: int) -> DataFrame | None:
    """Links across components of a bucket that comparisons with single members didn't see.

    Members outside the largest component (R) are compared with those in it (M) and with each other,
    in groups of one block of R and one of M, or two of R; a group has at most two blocks.
    """
    now, split = _split(shared, label, 0)
    once = split.where("n > 2").groupBy("n", "print").agg(F.min(F.struct("bucket", "major")).alias("b"))  # the same members may share several buckets
    once = once.select("b.bucket", F.col("b.major.component").alias("major"), F.ceil(F.col("b.major.n") / BLOCK).cast("int").alias("m"), F.ceil((F.col("n") - F.col("b.major.n")) / BLOCK).cast("int").alias("r"))
    parts = written(now.join(once, "bucket").select("bucket", "rep", "component", (F.col("component") == F.col("major")).alias("in_m"), "m", "r"), "split")
    if not parts.limit(1).count():
        return None
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.when(F.col("in_m"), F.col("m")).otherwise(F.col("r"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_m = F.transform(upto("r"), lambda i: key("RM", i, F.col("own")))
    of_r = F.concat(F.transform(upto("m"), lambda j: key("RM", F.col("own"), j)), F.transform(upto("r"), lambda j: key("RR", F.least(F.col("own"), j), F.greatest(F.col("own"), j))))
    dealt = parts.withColumn("own", own).select("bucket", "rep", "component", F.explode(F.when(F.col("in_m"), of_m).otherwise(of_r)).alias("g")).select("bucket", "g.*", "rep", "component")
    dealt = written(dealt, "dealt")
    full = shingles.join(small(dealt), shingles["doc"] == dealt["rep"]).select("bucket", "kind", "i", "j", "rep", "component", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        docs, labels = table.column("rep").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        values, bounds = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        found = links_within(docs, labels, [values[s:e] for s, e in zip(bounds, bounds[1:], strict=False)], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return written(full.groupBy("bucket", "kind", "i", "j").applyInArrow(compare, "a long, b long"), "further")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = BROADCAST) -> DataFrame:
    """The rows of docs without near duplicates of a smaller document; few ids are broadcast, more are joined."""
    gone = written(near_duplicates(docs, id_col=id_col, text_col=text_col).where("not kept").select(id_col).distinct(), "gone")
    return among(docs, gone, id_col, "left_anti", most_broadcast)
