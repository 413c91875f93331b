"""Language ID: multinomial naive Bayes over hashed character n-grams.

Feature counts of labelled training texts are summed in the cluster; the matrix of log
probabilities (languages x 2^bits, a fixed size) is broadcast, and texts are scored in blocks in
numpy: only the features that occur are looked up, and sums run over each text's own slice.

The classifier is fitted on a sample of about `train_docs` labelled texts with a letter, drawn by a hash
of the id (a documented bound). Every label has an equal part of it; what labels with fewer rows leave
goes to the others, and the row with the smallest hash of each label is always drawn, so no label is
without features. Every text is scored whole. A text that is null or has no letter (a character of
Unicode category L; digits in circles or letters' numerals are none) is `und` with score 0. Ties go
to the label that sorts first. Rows are independent, so repeated rows need no rule; without labelled
rows, as in an empty table, all texts are `und`. Further columns stay; one with the name of a result
column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vespera.llm.common import blocks, map_arrow, strings

ALPHANUMERIC = re.compile(r"[^\W\d_]+")
#: Texts that may have a letter; letters newer than the JVM's count too.
LEARNABLE = r"[\p{L}\p{Cn}]"
ORDERS = (2, 3)


def has_letter(text: str) -> bool:
    """isalpha() is Unicode category L; the pattern finds a few numerals beside."""
    return any(c.isalpha() for m in ALPHANUMERIC.finditer(text) for c in m[0])


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams of lower-cased texts, runs of other characters as one space; and where each text's begin."""
    plain = [" " + " ".join(ALPHANUMERIC.findall(t.lower())) + " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in plain])
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    out = np.zeros((len(ORDERS), len(codes)), np.int64)
    gram = mixed
    for k in range(1, max(ORDERS)):
        gram = gram.copy()
        gram[k:] = (gram[k:] ^ (mixed[: len(codes) - k] >> np.uint64(5 * k))) * np.uint64(0xC2B2AE3D27D4EB4F)
        if k + 1 in ORDERS:
            out[ORDERS.index(k + 1)] = (gram >> shift).astype(np.int64) + (ORDERS.index(k + 1) << bits)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for row, k in zip(out, ORDERS, strict=True):  # grams across a border count as nothing
        for j in range(k - 1):
            row[starts + j] = len(ORDERS) << bits
    return out, starts


class Model:
    def __init__(self, labels: list[str], counts: np.ndarray, docs: np.ndarray, bits: int, smoothing: float = 0.5):
        """counts: labels x features."""
        self.labels, self.bits = labels, bits
        sums = counts.sum(axis=1, keepdims=True)
        log = np.log((counts + smoothing) / (sums + smoothing * counts.shape[1]))
        self.log = np.ascontiguousarray(np.hstack([log, np.zeros((len(labels), 1))]).astype(np.float32))
        self.prior = np.log(docs / docs.sum())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        und = np.array([not has_letter(t) for t in texts], bool)
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts))
        grams, starts = features(texts, self.bits)
        total = np.empty((len(self.labels), len(texts)))
        for i, row in enumerate(self.log):
            total[i] = self.prior[i] + sum(np.add.reduceat(row[g].astype(np.float64), starts) for g in grams)
        best = total.argmax(axis=0)
        score = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
        score[und] = 0
        return ["und" if u else self.labels[b] for u, b in zip(und, best, strict=True)], score


def _part(sizes: list[int], total: int) -> float:
    """The rows a label may have, so that all have `total` together: small labels leave theirs to the others."""
    for i, n in enumerate(sorted(sizes)):
        part = total / (len(sizes) - i)
        if n >= part:
            return part
        total -= n
    return float(max(sizes, default=0))


def fit(docs: DataFrame, training: Column, bits: int = 16, train_docs: int = 20_000, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """training: which rows may be learned from. At most languages x 2^(bits + 1) counts come to the driver."""
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LEARNABLE))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(5)), F.lit(1 << 40)).alias("key"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("least")).collect()
    per_label = {r["lang"]: r["n"] for r in found}
    labels = sorted(per_label)
    most = _part(list(per_label.values()), train_docs)
    below = [(r["lang"], max(r["least"] + 1, round(min(1.0, most / r["n"]) * (1 << 40)))) for r in found]
    drawn = rows.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where("key < below").select("lang", "text")
    width = len(ORDERS) << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in blocks(batches, "text"):
            grams, starts = features(strings(part.column("text")), bits)
            ends = np.append(starts[1:], grams.shape[1])
            for lang, a, b in zip(part.column("lang").to_pylist(), starts, ends, strict=True):
                own = sums.setdefault(lang, np.zeros(width + 1, np.int64))
                np.add.at(own, grams[:, a:b].ravel(), 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own[:width])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "feature", "n"])

    summed = map_arrow(drawn, count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(labels), width))
    at = {x: i for i, x in enumerate(labels)}
    if summed.num_rows:
        counts[[at[x] for x in summed.column("lang").to_pylist()], summed.column("feature").to_numpy()] = summed.column("n").to_numpy()
    return Model(labels, counts, np.array([per_label[x] for x in labels], float), bits)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "_lang", score_name: str = "_score") -> DataFrame:
    """The rows of docs and the columns lang_name, score_name; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*({lang_name, score_name} - {text_col}))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in blocks(batches, text_col):
            lang, score = own.predict(strings(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, lang_name, score_name])

    return map_arrow(docs, run, T.StructType([*schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter: those that a model with labels doesn't call `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col):
            yield part.filter(pa.array([has_letter(t) for t in strings(part.column(text_col))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)

