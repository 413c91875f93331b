"""A gated recurrent language model with class-factored softmax, trained and applied in the cluster.

Words fall into classes: each of the most frequent words is a class of its own, the others are cut
by their last two bytes into classes of about equal mass, which gives unseen words a class as well.
A recurrent network with an update gate predicts the class of the next word from all words before;
within a class a word has its smoothed share of the class's training tokens. So
log P(text) = sum over tokens of log P(class | history) + log P(word | class).

Counts come from all training texts, and so does training: it goes through all of them once (through a
small corpus several times), in rounds of truncated backpropagation. Texts are dealt by a hash of
their ids to shards of about `SHARD_TOKENS` tokens; in each round each shard trains on its texts of
that round, in the order of the hash, from the same start, and the mean weighted by tokens is the
start of the next round. Sums of parameters are sums of integers. So the model depends on the table,
not on how it is partitioned; what is left are roundings of matrix products. Scoring carries the
state across windows, so a text of any length has its complete log-likelihood.

Words are looked up by 64-bit hashes in a sorted vocabulary that is broadcast up to `most_words`;
beyond that, texts' words are joined with it in the cluster.

A null or empty text is its end token alone. Each row counts: copies and repeated rows count again.
A null id is one more id. Columns beside id and text are not read. Without training texts all classes
are equally likely. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import blocks, map_arrow, written
from vespera.llm.wordhash import words_of

FREQUENT, CLASSES, HIDDEN, STREAMS, WINDOW = 64, 128, 32, 256, 16
#: Shares of the texts that the rounds train on, and the steps' sizes. The first, short ones bring all shards on one way.
ROUNDS, RATES = (1, 1, 2, 4), (0.01, 0.01, 0.006, 0.003)
#: Tokens a shard has about, most shards (each sends its parameters), and tokens that training sees at least, in 8 passes at most.
SHARD_TOKENS, MOST_SHARDS, LEAST_TOKENS = 4_000_000, 4096, 2_000_000
END = np.uint64(0x5851F42D4C957F2D)
END_SUFFIX = 0


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end), their last two bytes, and each text's first token."""
    words = words_of(texts, lower=True)
    n = len(words.counts)
    first = words.first + np.arange(n + 1)
    place = np.arange(len(words.hashes)) + words.text_of()
    hashes, suffix = np.full(int(first[-1]), END), np.full(int(first[-1]), END_SUFFIX, np.int64)
    hashes[place] = words.hashes
    data = words.data
    if len(data):
        low = np.arange(256)
        low[65:91] += 32
        last, before = low[data[words.ends - 1]], np.where(words.ends - words.starts > 1, low[data[np.maximum(words.ends - 2, 0)]], 0)
        suffix[place] = last << 8 | before
    return hashes, suffix, first


def count_words(docs: DataFrame, flush: int = 3_000_000) -> DataFrame:
    """docs (text) -> h, suffix, n of every distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, s[at], np.bincount(inverse, weights=c).astype(np.int64)

        def batch(x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "suffix", "n"])

        for part in blocks(batches, "text"):
            h, s, _ = tokens_of(part.column("text"))
            u, at, c = np.unique(h, return_index=True, return_counts=True)
            held.append((u, s[at], c))
            if sum(len(x[0]) for x in held) > flush:
                held = [merged()]
                if len(held[0][0]) > flush // 2:
                    yield batch(held.pop())
        if held:
            yield batch(merged())

    return map_arrow(docs, run, "h long, suffix int, n long").groupBy("h").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Classes of words, and the class's tokens and distinct words in training."""

    frequent: np.ndarray  # sorted hashes
    class_of: np.ndarray  # class of each suffix
    tokens: np.ndarray
    types: np.ndarray
    n: int
    v: int

    def classes(self, hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = self.class_of[suffix]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            own = self.frequent[at] == hashes
            out = np.where(own, at, out)
        return out.astype(np.uint8)

    def word_log(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        share = (count + 0.5) / (self.tokens[cls] + 0.5 * (self.types[cls] + 1))
        return np.where(cls < len(self.frequent), 0.0, np.log10(share))

    def base_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))


def lexicon(vocab: DataFrame) -> Lexicon:
    """At most 64 words and 2^16 sums come to the driver."""
    total = vocab.agg(F.sum("n"), F.count("*")).first()
    top = [r["h"] for r in vocab.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()]
    frequent = np.sort(np.array(top, np.int64).view(np.uint64))
    rest = vocab.where(~F.col("h").isin(top)) if top else vocab
    sums = {r["suffix"]: (r["n"], r["v"]) for r in rest.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    mass, types = np.zeros(1 << 16), np.zeros(1 << 16)
    for s, (n, v) in sums.items():
        mass[s], types[s] = n, v
    share = (np.cumsum(mass) - mass / 2) / max(1.0, mass.sum())
    class_of = len(frequent) + np.minimum((share * (CLASSES - FREQUENT)).astype(np.int64), CLASSES - FREQUENT - 1)
    return Lexicon(frequent, class_of, np.bincount(class_of, mass, CLASSES), np.bincount(class_of, types, CLASSES), int(total[0] or 0), int(total[1]))


class Network:
    """h' = h + z (c - h) with z = sigmoid, c = tanh of (input row + h U); classes by softmax of h' W + b."""

    SHAPES = {"x": (CLASSES + 1, 2 * HIDDEN), "u": (HIDDEN, 2 * HIDDEN), "w": (HIDDEN, CLASSES), "b": (CLASSES,)}

    def __init__(self, flat: np.ndarray | None = None, prior: np.ndarray | None = None):
        self.p = {}
        rng = np.random.default_rng(7)
        at = 0
        for k, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.p[k] = (rng.normal(0, 0.1, shape) if flat is None else flat[at : at + size].reshape(shape)).astype(np.float32)
            at += size
        if flat is None and prior is not None:
            self.p["b"] = np.log(prior).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = h @ self.p["u"]
        a += self.p["x"][x]
        z = a[:, :HIDDEN]
        np.multiply(z, np.float32(0.5), out=z)
        np.tanh(a, out=a)
        z *= np.float32(0.5)
        z += np.float32(0.5)
        return z, a[:, HIDDEN:], h + z * (a[:, HIDDEN:] - h)

    def log_classes(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of the probability of y, and all probabilities."""
        s = h @ self.p["w"]
        s += self.p["b"]
        s -= s.max(axis=1, keepdims=True)
        own = s[np.arange(len(y)), y].copy()
        np.exp(s, out=s)
        sums = s.sum(axis=1, keepdims=True)
        s /= sums
        return own - np.log(sums[:, 0]), s


class Trainer:
    """Adam over windows of truncated backpropagation; the state runs on from window to window."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.t, self.tokens = net, rate, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def run(self, classes: np.ndarray, first: np.ndarray) -> None:
        """classes: all tokens of some texts, one after another; first: where texts begin."""
        begin = np.zeros(len(classes), bool)
        begin[first] = True
        source = np.concatenate([[CLASSES], classes[:-1]]).astype(np.int64)
        source[begin] = CLASSES
        streams = min(STREAMS, max(1, len(classes) // WINDOW))
        length = len(classes) // streams // WINDOW * WINDOW or len(classes) // streams
        cut = lambda a: a[: streams * length].reshape(streams, length).T
        x, y, new = cut(source), cut(classes.astype(np.int64)), cut(begin)
        h = np.zeros((streams, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            h = self.window(x[t : t + WINDOW], y[t : t + WINDOW], new[t : t + WINDOW], h)
        rest = np.arange(streams * length, len(classes))
        if len(rest):
            self.window(source[rest][:, None], classes[rest].astype(np.int64)[:, None], begin[rest][:, None], np.zeros((1, HIDDEN), np.float32))
        self.tokens += len(classes)

    def window(self, x: np.ndarray, y: np.ndarray, new: np.ndarray, h: np.ndarray) -> np.ndarray:
        net, steps, n = self.net, len(x), x.shape[1]
        zs, cs, before, after = [], [], [], np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            if new[t].any():
                h = h * ~new[t][:, None]
            before.append(h)
            z, c, h = net.step(x[t], h)
            zs.append(z)
            cs.append(c)
            after[t] = h
        flat = after.reshape(-1, HIDDEN)
        _, d = net.log_classes(flat, y.reshape(-1))
        d[np.arange(len(d)), y.reshape(-1)] -= 1
        d /= len(d)
        g = {"w": flat.T @ d, "b": d.sum(axis=0), "u": np.zeros_like(net.p["u"])}
        dh_out = (d @ net.p["w"].T).reshape(after.shape)
        da_all = np.empty((steps, n, 2 * HIDDEN), np.float32)
        dh = np.zeros((n, HIDDEN), np.float32)
        for t in reversed(range(steps)):
            dh = dh + dh_out[t]
            z, c, da = zs[t], cs[t], da_all[t]
            np.multiply(dh * (c - before[t]), z * (1 - z), out=da[:, :HIDDEN])
            np.multiply(dh * z, 1 - c * c, out=da[:, HIDDEN:])
            g["u"] += before[t].T @ da
            dh = dh * (1 - z) + da @ net.p["u"].T
            if new[t].any():
                dh = dh * ~new[t][:, None]
        hot = np.zeros((CLASSES + 1, steps * n), np.float32)
        hot[x.reshape(-1), np.arange(steps * n)] = 1
        g["x"] = hot @ da_all.reshape(-1, 2 * HIDDEN)
        self.update(g)
        return h

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, p in self.net.p.items():
            d = g[k] * scale
            self.m[k] += np.float32(0.1) * (d - self.m[k])
            self.v[k] += np.float32(0.001) * (d * d - self.v[k])
            p -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


def coded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """docs (key, text) -> key, classes: the classes of each text's tokens, one byte each."""
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            hashes, suffix, first = tokens_of(part.column("text"))
            data = pa.py_buffer(held.value.classes(hashes, suffix))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(first.astype(np.int32)), data])], ["key", "classes"])

    return map_arrow(docs.select("key", "text"), run, "key long, classes binary")


def train(docs: DataFrame, lex: Lexicon, shard_tokens: int = SHARD_TOKENS, gather: int = 600_000) -> Network:
    """docs (key, classes): coded texts, dealt by their keys. Only sums of parameters come to the driver."""
    prior = lex.tokens.copy()
    prior[: len(lex.frequent)] = lex.n / 500  # the network learns these soon
    net = Network(prior=(prior + 1) / (prior + 1).sum())
    if not lex.n:
        return Network(np.zeros(len(net.flat())))
    shards = min(MOST_SHARDS, -(-lex.n // shard_tokens))
    passes = min(8, max(1, LEAST_TOKENS // lex.n))
    rows = docs.select(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.pmod("key", F.lit(sum(ROUNDS))).alias("part"), "key", F.crc32("classes").alias("crc"), "classes")
    low = 0
    for share, rate in zip(ROUNDS, RATES, strict=True):
        start = net.flat()

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            own, shard, held, n = None, None, [], 0

            def learn() -> None:
                sizes = np.array(list(map(len, held)), np.int64)
                classes = np.frombuffer(b"".join(held), np.uint8)
                for _ in range(passes):
                    own.run(classes, np.cumsum(sizes) - sizes)

            def sums() -> pa.RecordBatch:
                weight = max(1, round(own.tokens * (1 << 20) / (lex.n * passes)))
                p = np.round(own.net.flat().astype(np.float64) * (1 << 24)).astype(np.int64) * weight
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p), pa.array(np.full(len(p), weight))], ["i", "p", "w"])

            for batch in batches:
                for to, classes in zip(batch.column("shard").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                    if to != shard or n > gather:
                        if n:
                            learn()
                        held, n = [], 0
                        if to != shard:
                            if own:
                                yield sums()
                            own, shard = Trainer(Network(start), rate), to
                    held.append(classes)
                    n += len(classes)
            if own:
                learn()
                yield sums()

        mine = rows.where((F.col("part") >= low) & (F.col("part") < low + share)).repartition(shards, "shard").sortWithinPartitions("shard", "key", "crc", "classes")
        got = map_arrow(mine.select("shard", "classes"), run, "i int, p long, w long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("w").alias("w")).toArrow()
        if got.num_rows:
            flat = np.zeros(got.num_rows)
            flat[got.column("i").to_numpy()] = got.column("p").to_numpy() / got.column("w").to_numpy() / (1 << 24)
            net = Network(flat)
        low += share
    return net


def class_scores(net: Network, classes: np.ndarray, first: np.ndarray, streams: int = STREAMS, window: int = WINDOW) -> np.ndarray:
    """Log10 probability of each text's classes; texts are dealt to streams of about equal length."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    streams = max(1, min(streams, len(lengths), -(-int(lengths.sum()) // int(lengths.max()))))
    heap = [(0, s) for s in range(streams)]
    dealt: list[list[int]] = [[] for _ in range(streams)]
    for d in order.tolist():
        total, s = heap[0]
        dealt[s].append(d)
        heapq.heapreplace(heap, (total + int(lengths[d]), s))
    totals = np.array([lengths[ds].sum() for ds in dealt])
    rank = np.argsort(-totals, kind="stable")
    dealt, totals = [dealt[s] for s in rank], totals[rank]
    tall = int(totals[0])
    y, x = np.zeros((streams, tall), np.uint8), np.zeros((streams, tall), np.uint8)
    starts = []
    for s, ds in enumerate(dealt):
        at = 0
        for d in ds:
            k = int(lengths[d])
            own = classes[first[d] : first[d] + k]
            y[s, at : at + k], x[s, at + 1 : at + k], x[s, at] = own, own[:-1], CLASSES
            starts.append(s * tall + at)
            at += k
        starts.append(s * tall + at)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    logs = np.zeros((tall, streams), np.float32)
    h = np.zeros((streams, HIDDEN), np.float32)
    for t in range(0, tall, window):
        n = int(np.searchsorted(-totals, -t, "left"))  # streams that go on beyond t
        h = h[:n]
        k = min(window, tall - t)
        states = np.empty((k, n, HIDDEN), np.float32)
        for j in range(k):
            own = x[t + j, :n]
            new = own == CLASSES
            if new.any():
                h = h * ~new[:, None]
            h = states[j] = net.step(own, h)[2]
        logs[t : t + k, :n] = net.log_classes(states.reshape(-1, HIDDEN), y[t : t + k, :n].reshape(-1))[0].reshape(k, n)
    flat = np.append(np.ascontiguousarray(logs.T).ravel().astype(np.float64), 0.0)
    sums = np.add.reduceat(flat, np.minimum(starts, len(flat) - 1))
    out = np.zeros(len(lengths))
    i = 0
    for ds in dealt:
        out[ds] = sums[i : i + len(ds)]
        i += len(ds) + 1
    return out / np.log(10)


class Vocabulary:
    """Counts by sorted hash; in 32 bits where all fit."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h.view(np.uint64))
        kind = np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64
        self.h, self.n = h.view(np.uint64)[order], n[order].astype(kind)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(hashes), np.int64)
        u, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
        return np.where(self.h[at] == u, self.n[at], 0).astype(np.int64)[inverse]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1])


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", most_words: int = 4_000_000, gather: int = 2_500_000) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row; training: which rows are learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    learn = rows.where("learn").select("text", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 30)).alias("key"))
    vocab = written(count_words(learn.select("text")), "vocabulary")
    lex = lexicon(vocab)
    net = train(written(coded(learn, lex), "classes"), lex)
    context = docs.sparkSession.sparkContext
    model = context.broadcast((lex, net))
    kind = rows.schema["id"].dataType.simpleString()
    if lex.v > most_words:
        return _score_joined(rows, vocab, model, lex, kind).withColumnRenamed("id", id_col)
    table = vocab.select("h", "n").toArrow()
    words = context.broadcast(Vocabulary(table.column("h").to_numpy(), table.column("n").to_numpy()))
    del table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (lex, net), vocabulary = model.value, words.value
        held: list[tuple] = []

        def scored() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            lengths, known, base, within = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            classes = np.concatenate([h[5] for h in held])
            total = class_scores(net, classes, np.concatenate([[0], np.cumsum(lengths)])) + within
            held.clear()
            return pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(known), pa.array(base), pa.array(total)], ["id", "n_tokens", "n_known", "base_score", "score"])

        for part in blocks(batches, "text"):
            hashes, suffix, first = tokens_of(part.column("text"))
            cls, count = lex.classes(hashes, suffix), vocabulary.counts(hashes)
            held.append((part.column("id"), np.diff(first), _sums((count > 0).astype(np.int64), first), _sums(lex.base_log(count), first), _sums(lex.word_log(cls, count), first), cls))
            if sum(len(h[5]) for h in held) > gather:
                yield scored()
        if held:
            yield scored()

    out = map_arrow(rows.select("id", "text"), run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(lex.n).cast("long").alias("train_tokens"), "base_score", "score")


def _score_joined(rows: DataFrame, vocab: DataFrame, model, lex: Lexicon, kind: str) -> DataFrame:
    """The same for vocabularies over the bound: counts of each text's words are joined by hash."""

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = model.value
        for part in blocks(batches, "text", 2 << 20):
            hashes, suffix, first = tokens_of(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(np.diff(first)), pa.array(class_scores(net, lex.classes(hashes, suffix), first))], ["row", "id", "n_tokens", "classes"])

    def per_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value[0]
        for part in blocks(batches, "text", 1 << 20):
            hashes, suffix, first = tokens_of(part.column("text"))
            order = np.lexsort((hashes, owner := np.repeat(np.arange(part.num_rows), np.diff(first))))
            h, o = hashes[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
            pick = order[new]
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(o[new])), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h)))), pa.array(lex.classes(hashes[pick], suffix[pick]).astype(np.int32))], ["row", "h", "tf", "class"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    texts = map_arrow(numbered, per_text, f"row long, id {kind}, n_tokens long, classes double")
    words = map_arrow(numbered.select("row", "text"), per_word, "row long, h long, tf long, class int")
    tokens, types = (F.array(*(F.lit(float(x)) for x in v)) for v in (lex.tokens, lex.types))
    c = F.coalesce("n", F.lit(0))
    at = F.col("class") + 1
    share = F.when(F.col("class") < len(lex.frequent), 0.0).otherwise(F.log10((c + 0.5) / (F.element_at(tokens, at) + 0.5 * (F.element_at(types, at) + 1))))
    base = F.log10((c + 0.5) / (lex.n + 0.5 * (lex.v + 1)))
    sums = words.join(vocab.select("h", "n"), "h", "left").groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("tf") * base).alias("base_score"), F.sum(F.col("tf") * share).alias("words"))
    return texts.join(sums, "row").select("id", "n_tokens", "n_known", F.lit(lex.n).cast("long").alias("train_tokens"), "base_score", (F.col("classes") + F.col("words")).alias("score"))
