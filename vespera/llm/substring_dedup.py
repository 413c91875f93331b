"""Removal of word sequences that repeat across documents, by a compressed FM-index per shard.

A window is `n` (50) consecutive words. Windows with equal words have the same minimiser, the
smallest hash among their 8-word grams; so only windows whose minimiser occurs in several documents
can repeat, and windows of one minimiser meet in one shard. A run of windows with one minimiser is
a segment. Equal segments are joined first; a minimiser with one distinct segment needs no index.
In a shard, windows are sorted out once more by minimisers of 32 words. Then segments of smaller documents are indexed (wavelet matrix over the words' hashes) and
segments of larger ones, which aren't in the index, are streamed through backward search. That
gives their matching statistics; where at least `n` words match, the suffix interval is reported,
and a smaller document in it takes the window away. A minimiser with more words than a shard may
hold is resolved by hashes of its single windows, summed in the cluster.

Texts with equal words are joined before all this: from 50 words on all but the smallest document
lose everything. A word is removed if a window over it also starts in a document with a smaller id;
windows are judged on the input. Words are held as 64-bit hashes; a false hit has odds of 2^-60.

Ids are numbers and are compared as 64-bit integers; a string id that isn't one is an error under ANSI
SQL, else a null id. A null id is never removed from and removes nothing. Null and empty texts have
no words. Rows with the same id don't remove from each other, as no id is smaller. Repeated rows are
judged alike. Further columns may have any names and stay as they are. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import BROADCAST, among, blocks, map_arrow, packed, strings, written
from vespera.llm.fm_index import FMIndex
from vespera.llm.wordhash import BASE, UNBASE, Words, grams, inside, mixed, powers, words_of

WINDOW, GRAM, LONG_GRAM, SHARD_WORDS, HOT_WORDS, PIECE = 50, 8, 32, 300_000, 400_000, 256


def minimisers(words: Words, n: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows, and the minimiser of each."""
    at = inside(words.first, n)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    low, width, span = grams(words.hashes, k, 31), 1, n - k + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return at, low[at]


def _runs(at: np.ndarray, value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where a new run of windows begins: another text or another minimiser."""
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])])) if len(at) else at


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def joined(text: str) -> bytes:
    """The words with one space between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        texts = part.column("text")
        words = words_of(texts)
        at, value = minimisers(words)
        of = words.text_of()[at]
        new = _runs(at, value, of)
        counts = np.bincount(of[new], minlength=len(texts))
        digest = [hashlib.sha256(joined(t)).digest() for t in strings(texts)]
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(words.counts), pa.array(digest, pa.binary()), _lists(value[new].view(np.int64), counts)], ["doc", "n_words", "digest", "mins"])


def segments_of(words: Words, k: int = GRAM, flagged: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of windows (with flagged minimisers): text, minimiser, first window (word index), windows, identity."""
    at, value = minimisers(words, k=k)
    of = words.text_of()[at]
    new = _runs(at, value, of)
    if not len(new):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    count = np.diff(np.append(new, len(at)))
    if flagged is not None:
        keep = np.zeros(len(new), bool)
        bounds = np.searchsorted(of[new], np.arange(len(flagged) + 1))
        for i, own in enumerate(flagged):
            keep[bounds[i] : bounds[i + 1]] = np.isin(value[new[bounds[i] : bounds[i + 1]]], own)
        new, count = new[keep], count[keep]
    first, length = at[new], count + WINDOW - 1
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * powers(BASE, len(words.hashes)), out=sums[1:])
    ident = mixed((sums[first + length] - sums[first]) * powers(UNBASE, len(words.hashes))[first] + length.astype(np.uint64), 41)
    return of[new], value[new], first, count, ident


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        words = words_of(part.column("text"))
        flagged = [np.array(x, np.int64).view(np.uint64) for x in part.column("mins").to_pylist()]
        of, value, first, count, ident = segments_of(words, flagged=flagged)
        yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(of)), part.column("digest").take(pa.array(of)), pa.array(value.view(np.int64)), pa.array(ident.view(np.int64)), pa.array(first - words.first[of]), pa.array(count)], ["doc", "digest", "m", "seg", "start", "windows"])


def _providers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the segments that a text provides."""
    for part in blocks(batches, "text"):
        words = words_of(part.column("text"))
        wanted = part.column("wanted").to_pylist()
        rows = [(w["m"], w["seg"], w["low"], w["hot"], words.first[i] + w["start"], w["windows"] + WINDOW - 1) for i, ws in enumerate(wanted) for w in ws]
        if not rows:
            continue
        m, seg, low, hot, first, length = zip(*rows, strict=True)
        length = np.array(length, np.int64)
        take = np.repeat(np.array(first) - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(seg), pa.array(low), pa.array(hot), _lists(words.hashes[take].view(np.int64), length)], ["m", "seg", "low", "hot", "words"])


RUNS = "array<struct<a:int,b:int>>"


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of slices, one after another."""
    begin = np.cumsum(length) - length
    return np.repeat(first - begin, length) + np.arange(int(length.sum()))


def _matched(words: np.ndarray, first: np.ndarray, windows: np.ndarray, group: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Which windows of segments (places in words, minimisers, documents) a smaller document has, by the index.

    The segments of a minimiser are numbered by their documents. For each binary digit of the numbers, those
    with a 0 there are indexed, and those with a 1 are streamed; two segments differ first in one digit,
    and there the smaller one is in the index. So the index has none of the texts that it answers for.
    """
    base = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    if not len(first):
        return out
    order = np.lexsort((low, group))
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    counts = np.diff(np.append(heads, len(order)))
    number, several = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    number[order], several[order] = np.arange(len(order)) - np.repeat(heads, counts), np.repeat(counts, counts)
    for digit in range(int(number.max()).bit_length()):
        own, one = several > 1 << digit, (number >> digit & 1).astype(bool)
        held, streamed = np.flatnonzero(own & ~one), np.flatnonzero(own & one)
        index = FMIndex(words[_spans(first[held], windows[held] + n - 1)], windows[held] + n - 1, low[held], n)
        parts = -(-windows[streamed] // PIECE)
        owner, piece = np.repeat(streamed, parts), _spans(np.zeros(len(parts), np.int64), parts)
        size = np.minimum(PIECE, windows[owner] - piece * PIECE)
        depth, interval = index.statistics(words, first[owner] + piece * PIECE, size + n - 1)
        at = _spans(np.cumsum(size + n - 1) - (size + n - 1), size)  # only these begin a whole window of the piece
        hit = (depth[at] >= n) & (index.least[interval[at]] < np.repeat(low[owner], size))
        out[_spans(base[owner] + piece * PIECE, size)[hit]] = True
    return out


def repeated_windows(words: np.ndarray, lengths: np.ndarray, low: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Of a shard's segments (words' hashes, one after another; lengths; first documents): which windows a smaller document has.

    Before anything is indexed, segments are cut again by longer minimisers, and windows whose longer
    minimiser stands in one segment only are left out, as they can't repeat; equal pieces are joined.
    """
    first = np.cumsum(lengths) - lengths
    base = np.cumsum(lengths - n + 1) - (lengths - n + 1)
    out = np.zeros(int((lengths - n + 1).sum()), bool)
    none = np.zeros(0, np.int64)
    of, value, at, windows, ident = segments_of(Words(words.view(np.uint64), none, none, np.append(first, len(words)), none), LONG_GRAM)
    group, size = np.unique(value, return_inverse=True, return_counts=True)[1:]
    often = np.flatnonzero(size[group] > 1)
    of, group, at, windows, ident = of[often], group[often], at[often], windows[often], ident[often]
    doc = low[of]
    order = np.lexsort((doc, ident, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (ident[order][1:] != ident[order][:-1])
    sole = order[new]  # the smallest document's of each text
    rep = np.empty(len(order), np.int64)
    rep[order] = np.cumsum(new) - 1
    found = _matched(words, at[sole], windows[sole], group[sole], doc[sole], n)
    begin = np.cumsum(windows[sole]) - windows[sole]
    hit = found[_spans(begin[rep], windows)] | np.repeat(doc[sole][rep] < doc, windows)
    out[_spans(base[of] + at - first[of], windows)] = hit
    return out


def _resolve(table: pa.Table) -> pa.Table:
    """One shard: its distinct segments -> runs of windows that a smaller document has, where there are some."""
    lists = table.column("words").combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    words, windows = lists.values.to_numpy()[bounds[0] : bounds[-1]], np.diff(bounds) - WINDOW + 1
    hit = repeated_windows(words, np.diff(bounds), table.column("low").to_numpy())
    base = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(windows)), windows)
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
    end[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    found, count = np.unique(owner[a], return_counts=True)
    runs = pa.StructArray.from_arrays([pa.array((a - base[owner[a]]).astype(np.int32)), pa.array((b - base[owner[a]]).astype(np.int32))], ["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), runs)
    return pa.table([table.column("m").take(pa.array(found)), table.column("seg").take(pa.array(found)), lists], ["m", "seg", "runs"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of the segments of a hot minimiser."""
    for batch in batches:
        for i in range(batch.num_rows):
            h = grams(batch.column("words")[i].values.to_numpy().view(np.uint64), WINDOW, 51).view(np.int64)
            own = [pa.array(np.full(len(h), batch.column(x)[i].as_py())) for x in ("m", "seg", "low")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], ["m", "seg", "low", "a", "h"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        kept, removed = [], []
        for text, ranges in zip(strings(part.column("text")), part.column("ranges").to_pylist(), strict=True):
            own = text.encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(own) + 1, np.int64)
            for r in ranges:
                edge[r["a"]] += 1
                edge[r["b"]] -= 1
            stays = np.cumsum(edge)[:-1] == 0
            kept.append(b" ".join([w for w, s in zip(own, stays.tolist(), strict=True) if s]).decode("utf-8", "surrogatepass"))
            removed.append(len(own) - int(stays.sum()))
        yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("digest"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc", "digest", "n_removed", "kept"])


def _ranges(occurrences: DataFrame, answers: DataFrame) -> DataFrame:
    """doc, digest, ranges: word ranges to remove, of documents that have some."""
    joined_ = occurrences.join(answers, ["m", "seg"])
    whole = F.when(F.col("low") < F.col("doc"), F.array(F.struct(F.lit(0).alias("a"), F.col("windows").cast("int").alias("b"))))  # the segment's first document has all its windows
    each = joined_.select("doc", "digest", F.transform(F.coalesce(whole, "runs", F.array().cast(RUNS)), lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (WINDOW - 1)).alias("b"))).alias("ranges")).where(F.size("ranges") > 0)
    return each.groupBy("doc", "digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profile: doc, n_words, digest, copy; edited: doc, digest, n_removed, kept).

    profile has every row; copy says that all words go. edited has the documents that lose words
    otherwise, and their remaining words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = written(map_arrow(rows, _profile, "doc long, n_words long, digest binary, mins array<long>"), "profile")
    long_ = found.where((F.col("n_words") >= WINDOW) & F.col("doc").isNotNull())
    first = written(long_.groupBy("digest").agg(F.min("doc").alias("rep")), "firsts").select(F.col("rep").alias("doc"), F.col("digest"))
    sole = found.where(F.col("n_words") >= WINDOW).join(first.dropDuplicates(["doc", "digest"]), ["doc", "digest"], "left_semi").dropDuplicates(["doc", "digest"])

    mins = sole.select("doc", F.explode(F.array_distinct("mins")).alias("m"))
    common = written(mins.groupBy("m").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("m"), "minimisers")
    flagged = mins.join(common, "m", "left_semi").groupBy("doc").agg(F.collect_set("m").alias("mins"))
    chosen = written(sole.select("doc", "digest").join(flagged, "doc"), "chosen")
    hashed = among(rows, written(chosen.select("doc").distinct(), "ids"), "doc").join(chosen, "doc")
    cand = written(map_arrow(hashed, _same_text, "doc long, digest binary, mins array<long>, text string"), "candidates")

    occurrences = written(map_arrow(cand, _segments, "doc long, digest binary, m long, seg long, start long, windows long"), "segments")
    distinct = occurrences.groupBy("m", "seg").agg(F.min(F.struct("doc", "start", "digest")).alias("first"), F.first("windows").alias("windows"))
    distinct = written(distinct.select("m", "seg", F.col("first.doc").alias("low"), "first.start", "first.digest", "windows"), "distinct")
    sizes = distinct.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.col("windows") + (WINDOW - 1)).alias("words")).where("n > 1")
    sizes = written(sizes.select("m", "words", (F.col("words") > HOT_WORDS).alias("hot")), "sizes")
    several = distinct.join(sizes, "m").groupBy(F.col("low").alias("doc"), "digest").agg(F.collect_list(F.struct("m", "seg", "low", "start", "windows", "hot")).alias("wanted"))
    held = written(map_arrow(cand.select("doc", "digest", "text").join(several, ["doc", "digest"]), _providers, "m long, seg long, low long, hot boolean, words array<long>"), "words")

    total = sizes.where("not hot").agg(F.sum("words")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    shard = F.pmod(F.xxhash64("m", F.lit(7)), F.lit(shards)).cast("int")
    cool = held.where("not hot").repartition(shards, shard).groupBy(shard.alias("shard")).applyInArrow(_resolve, f"m long, seg long, runs {RUNS}")
    single = map_arrow(held.where("hot"), _windows, "m long, seg long, low long, a int, h long")
    shared = single.groupBy("h").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").select("h", "least")
    shared = written(shared, "windows")  # a plain side, so that the windows of a hot one can be split
    hot = single.join(shared, "h").where("least < low").groupBy("m", "seg").agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"))).alias("runs"))
    runs = written(cool.unionByName(hot), "runs")
    answers = written(distinct.select("m", "seg", "low").join(runs, ["m", "seg"], "left"), "answers")  # a plain side, so that a hot segment's occurrences can be split
    ranges = _ranges(occurrences, answers)
    edited = written(map_arrow(cand.select("doc", "digest", "text").join(ranges, ["doc", "digest"]), _remove, "doc long, digest binary, n_removed long, kept string"), "edited")
    marks = first.withColumn("sole", F.lit(True))
    profile = found.select("doc", "n_words", "digest").join(marks, ["doc", "digest"], "left")
    return profile.withColumn("copy", (F.col("n_words") >= WINDOW) & F.col("doc").isNotNull() & F.col("sole").isNull()).drop("sole"), edited


def _same_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows joined by their id alone, those whose text is the one meant; each text once."""
    for batch in blocks(batches, "text"):
        same = [hashlib.sha256(joined(t)).digest() == d for t, d in zip(strings(batch.column("text")), batch.column("digest").to_pylist(), strict=True)]
        yield batch.select(["doc", "digest", "mins", "text"]).filter(pa.array(same, pa.bool_()))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row."""
    profile, edited = repeated(docs, id_col, text_col)
    edits = edited.select("doc", "digest", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha")).dropDuplicates(["doc", "digest"])
    out = profile.join(edits, ["doc", "digest"], "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    sha = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest"))))
    return out.select(F.col("doc").alias(id_col), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = BROADCAST) -> DataFrame:
    """The rows of docs without repeated words; rows that lose all words go, rows that lose none keep their text."""
    profile, edited = repeated(docs, id_col, text_col)
    copies = profile.where("copy").select("doc", "digest", F.lit("").alias("kept"))
    changed = edited.select("doc", "digest", "kept").unionByName(copies).groupBy("doc", "digest").agg(F.first("kept").alias("kept"))
    by_id = written(changed.groupBy("doc").agg(F.collect_list(F.struct("digest", "kept")).alias("changes")), "changes")
    ids = written(by_id.select("doc"), "changed")
    words = F.array_remove(F.split(F.col(text_col), "[\\x09-\\x0D\\x20]+"), "")
    own = F.unhex(F.sha2(F.array_join(words, " ").cast("binary"), 256))  # rows with one id may have several texts
    rows = packed(docs, doc=F.col(id_col).cast("long"))
    mine = packed(docs, doc=F.col(id_col).cast("long"), text=F.col(text_col), own=own)
    hit = among(mine, ids, "doc", most=most_broadcast).join(by_id, "doc")
    same = F.filter("changes", lambda x: x["digest"] == F.col("own"))
    kept = F.when(F.size(same) > 0, F.element_at(F.transform(same, lambda x: x["kept"]), 1))
    edited_rows = hit.withColumn("kept", kept).where("kept is null or kept <> ''").select(F.col("row").withField(f"`{text_col}`", F.coalesce("kept", "text")).alias("row"))
    return edited_rows.unionByName(among(rows, ids, "doc", "left_anti", most_broadcast).select("row")).select("row.*")
