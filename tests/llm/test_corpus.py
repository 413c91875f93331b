"""Operators over whole tables: brute force on small ones, and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from vespera.llm import common, fm_index, gated_lm, near_dedup, queries, substring_dedup, wordhash
from vespera.llm import components as components_module
from vespera.llm.components import components

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, doc string").repartition(3)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(n))


def tricky(seed=5):
    """Copies, near copies in chains, shared passages, repeated lines, nulls, empty texts, repeated rows."""
    rng = random.Random(seed)
    base, passage, line = sentence(rng, 200), sentence(rng, 70), sentence(rng, 9)
    rows = [(None, base), (None, None), (500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "One TWO"), (505, "three"), (507, base), (506, base.upper()), (506, base.upper())]
    words = base.split()
    for i in range(40):
        w = list(words)
        for _ in range(i // 2):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(30):
        rows.append((200 + i, f"{sentence(rng, rng.randint(0, 80))} {passage} {sentence(rng, 60)}"))
    for i in range(8):
        rows.append((300 + i, f"{line} " * (10 + i)))
    drift = list(words)
    for i in range(30):
        for _ in range(4):
            drift[rng.randrange(len(drift))] = f"drift{rng.randrange(10**6)}"
        rows.append((400 + i, "  ".join(drift)))
    rows += [(600, passage), (601, " ".join(passage.split()[:49])), (602, " ".join(passage.split()[:50])), (603, f"{passage}\n{passage}"), (50, f"x {passage} y"), (700, "word " * 30_000), (701, "word " * 60)]
    return rows


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b  a", None, "", "Ab\u00a0c \x1c d\x0b\x0ce", " x", "y ", "b a"]
    w = wordhash.words_of(pa.array(texts))
    spelled = [x for t in texts for x in brute.words(t)]
    assert w.counts.tolist() == [len(brute.words(t)) for t in texts] and len(set(w.hashes.tolist())) == len(set(spelled))
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == spelled
    low = wordhash.words_of(pa.array(["ÉAB éab"]), lower=True).hashes
    assert low[0] != low[1] and wordhash.words_of(pa.array(["AB ab"]), lower=True).hashes.tolist() == [wordhash.words_of(pa.array(["ab"])).hashes[0]] * 2
    assert wordhash.words_of(pa.array(["q", "b a", "z"]).slice(1, 1)).hashes.tolist() == w.hashes[-2:].tolist()


def test_substring_dedup(spark):
    rows = tricky()
    got = sorted(map(tuple, substring_dedup.report(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(brute.substring_dedup(rows), key=repr)


def test_substring_dedup_of_hot_minimisers(spark, monkeypatch):
    rows = tricky(6)
    want = sorted(brute.substring_dedup(rows), key=repr)
    for hot, shard in ((200, 300_000), (10**9, 500)):
        monkeypatch.setattr(substring_dedup, "HOT_WORDS", hot)
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
        assert sorted(map(tuple, substring_dedup.report(frame(spark, rows)).collect()), key=repr) == want


def test_substring_cut(spark):
    rows = tricky()
    cut = {}
    for r in substring_dedup.cut(frame(spark, rows)).collect():
        cut.setdefault(r["doc_id"], []).append(r["text"])
    for i, n, removed, digest in brute.substring_dedup(rows):
        if removed == 0 and i is not None:
            assert all(t in [x for j, x in rows if j == i] for t in cut[i])
        elif removed and removed < n:
            assert brute.sha(cut[i][0]) == digest
        elif removed:
            assert i not in cut
    assert len(cut[None]) == 2


def test_clashing_names(spark):
    rows = tricky()
    names = ["_kept", "_doc", "_changes", "row", "doc", "kept", "digest", "own", "_hits", "changes"]
    docs = frame(spark, rows).drop("doc").select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names))
    for out in (substring_dedup.cut(docs), near_dedup.keep_one(docs)):
        got = out.collect()
        assert out.columns == docs.columns and got and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in got for c in names)


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("false")
    assert substring_dedup.report(none).count() == near_dedup.near_duplicates(none).count() == gated_lm.score(none, F.lit(True)).count() == 0
    assert substring_dedup.cut(none).count() == near_dedup.keep_one(none).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    lengths = np.array([70, 120, 55, 300])
    symbols = rng.integers(0, 3, lengths.sum()) * 7
    index = fm_index.FMIndex(symbols, lengths, np.arange(4), 50)
    parts = np.split(symbols, np.cumsum(lengths)[:-1])
    for pattern in ([0], [7, 0], [14, 14, 7], [0, 7, 7, 14, 0]):
        low, high = np.array([0]), np.array([index.size])
        for s in reversed(pattern):
            c = np.array([s // 7 + 1])
            low, high = index.extend(c, low), index.extend(c, high)
        want = sum(p[i : i + len(pattern)].tolist() == pattern for p in parts for i in range(len(p)))
        assert int(high[0] - low[0]) == want


@pytest.mark.parametrize("kinds", [2, 4, 40])
def test_matching_statistics_of_texts_outside_the_index(kinds):
    rng = np.random.default_rng(kinds)
    depth = 6
    lengths, streamed = np.array([30, 1, 57, 12, 90]), np.array([40, 3, 0, 75])
    symbols, other = rng.integers(0, kinds, lengths.sum()), rng.integers(0, kinds + 1, streamed.sum())
    values = np.array([5, 9, 3, 7, 4])
    other[10:35] = symbols[31:56]  # a passage of the third segment
    index = fm_index.FMIndex(symbols, lengths, values, depth)
    parts, ends = np.split(symbols, np.cumsum(lengths)[:-1]), np.cumsum(streamed)
    found, interval = index.statistics(other, ends - streamed, streamed)
    holders = {}
    for p, v in zip(parts, values):
        for i in range(len(p)):
            for n in range(1, depth + 1):
                if i + n <= len(p):
                    holders.setdefault(tuple(p[i : i + n]), set()).add(v)
    for a, b in zip(ends - streamed, ends):
        for i in range(a, b):
            want = max((n for n in range(1, min(depth, b - i) + 1) if tuple(other[i : i + n]) in holders), default=0)
            assert found[i] == want
            if want == depth:
                assert index.least[interval[i]] == min(holders[tuple(other[i : i + depth])])
    assert (found == 0).any() and (found == depth).any() and ((found > 0) & (found < depth)).any()


def test_the_threshold_decides_in_the_index():
    """A passage of 49 words in a smaller document takes nothing, of 50 one window; the streamed text is not in the index."""
    for n in (49, 50, 61):
        texts = [np.arange(1000, 1090), np.concatenate([np.arange(5, 30), np.arange(1010, 1010 + n), np.arange(60, 90)])]
        lengths = np.array([len(t) for t in texts])
        words, first, low = np.concatenate(texts), np.array([0, 90]), np.array([3, 8])
        hit = substring_dedup._matched(words, first, lengths - 49, np.zeros(2, np.int64), low, 50)
        assert substring_dedup.repeated_windows(words, lengths, low).tolist() == hit.tolist()
        assert np.flatnonzero(hit).tolist() == [41 + 25 + i for i in range(n - 49)]


def test_near_duplicates(spark, monkeypatch):
    for block in (32,):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "STARS", 0)
        rows = tricky()
        got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
        assert got == sorted(brute.near_duplicates(rows), key=repr)


def test_one_id_with_several_texts(spark):
    rng = random.Random(9)
    one, two = sentence(rng, 50), sentence(rng, 50)
    rows = [(5, one), (5, two), (6, one), (7, two), (8, sentence(rng, 50))]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_turns_of_comparison_with_one_member(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 2)
    for rows in (tricky(11),):
        got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
        assert got == sorted(brute.near_duplicates(rows), key=repr)


def test_keep_one(spark):
    rows = tricky()[:30]
    want = sorted((i for i, _, _, kept in brute.near_duplicates(rows) if kept or i is None), key=repr)
    for most in (common.BROADCAST, -1):
        assert sorted((r["doc_id"] for r in near_dedup.keep_one(frame(spark, rows), most_broadcast=most).collect()), key=repr) == want


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for n, shared in ((5, 4), (60, 45), (2000, 1200)):
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[2000 : 2000 + n - shared]]))
        x, y = near_dedup.sketches([a, b])
        true = shared / (2 * n - shared)
        assert abs((x == y).mean() - true) < 0.2 and not (x == np.uint64(2**64 - 1)).any()
    assert (near_dedup.sketches([np.zeros(0, np.uint64)]) == np.uint64(2**64 - 1)).all()


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_one_round(spark, monkeypatch):
    rng = random.Random(9)
    links = [(i + 1, i) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(-260, -200), rng.randrange(-260, -200)) for _ in range(40)] + [(300, i) for i in range(260, 300)] + [(300, 2**62), (7, 7)] * 2
    table, tables = spark.createDataFrame(links, "a long, b long").repartition(5), []
    whole = sorted(map(tuple, components(table, few=0).collect()))  # by rounds of joins alone
    assert {n for n, _ in whole} == {x for a, b in links if a != b for x in (a, b)} and (2**62, 260) in whole and (60, 0) in whole
    assert sorted(map(tuple, components(table, few=30).collect())) == whole
    monkeypatch.setattr(components_module, "written", lambda df, what: tables.append(what) or common.written(df, what))
    assert sorted(map(tuple, components(table).collect())) == whole
    assert tables == ["links", "parents"]


@pytest.mark.parametrize("most", [4_000_000, 3])
def test_language_model(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "unheardof wOrDs"), (None, "the end")], "doc_id long, text string")).unionByName(docs.where("doc_id = 3"))
    learn = common.remainder(F.col("doc_id"), 5) != 1
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter()
    for i, t in rows:
        if brute.remainder(i, 5) != 1:
            counts.update([*brute.words(t, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    got = gated_lm.score(docs, learn, most_words=most).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        own = [*brute.words(t, lower=True), None]
        r = by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0
    held = [r for r in got if brute.remainder(r["doc_id"], 5) == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("key"))
    learn = common.remainder(F.col("doc_id"), 5) != 1
    monkeypatch.setattr(gated_lm.train, "__defaults__", (150_000, 60_000))  # several shards
    one = None
    for parts in (2, 16, 64):
        got = {r["doc_id"]: r for r in gated_lm.score(docs.repartition(parts), learn).collect()}
        held = [r for i, r in got.items() if brute.remainder(i, 5) == 1]
        tokens = sum(r["n_tokens"] for r in held)
        assert sum(r["score"] - r["base_score"] for r in held) > 0.1 * tokens
        one = one or got
        assert all(math.isclose(got[i]["score"], r["score"], rel_tol=1e-4) for i, r in one.items())


def test_whole_scores_by_brute_force(spark):
    rows = [(i, t) for i, t in tricky(3) if i is not None and len(t or "") < 5000][::4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    learn = F.col("doc_id") % 3 != 0
    got = {r["doc_id"]: r["score"] for r in gated_lm.score(docs, learn).collect()}
    counts = Counter(w for i, t in rows if i % 3 for w in [*brute.words(t, lower=True), None])
    own = docs.where(learn).select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30)).alias("key"))
    lex = gated_lm.lexicon(gated_lm.count_words(own))
    net = gated_lm.train(common.written(gated_lm.coded(own, lex), "classes"), lex)
    import pyarrow as pa

    for i, t in rows:
        hashes, suffix, _ = gated_lm.tokens_of(pa.array([t], pa.string()))
        classes = lex.classes(hashes, suffix)
        h, before, total = np.zeros((1, gated_lm.HIDDEN), np.float32), gated_lm.CLASSES, 0.0
        for w, c in zip([*brute.words(t, lower=True), None], classes.tolist()):
            h = net.step(np.array([before]), h)[2]
            s = (h @ net.p["w"] + net.p["b"])[0].astype(np.float64)
            total += s[c] / math.log(10) - math.log10(np.exp(s).sum())
            if c >= len(lex.frequent):
                total += math.log10((counts[w] + 0.5) / (lex.tokens[c] + 0.5 * (lex.types[c] + 1)))
            before = c
        assert math.isclose(got[i], total, rel_tol=1e-4, abs_tol=1e-4)


def test_vocabulary_holds_large_counts():
    for largest in (2**32 - 1, 2**32, 2**40 + 7):
        own = gated_lm.Vocabulary(np.array([5, -1, 3]), np.array([2, largest, 9]))
        assert own.counts(np.array([2**64 - 1, 3, 4, 5], np.uint64)).tolist() == [largest, 9, 0, 2]


def test_streams_do_not_change_scores():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 900, 3, 40, 41, 17, 300, 2])
    classes = rng.integers(0, gated_lm.CLASSES, lengths.sum()).astype(np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths)])
    net = gated_lm.Network(rng.normal(0, 0.5, len(gated_lm.Network().flat())))
    want = []
    for a, b in zip(first, first[1:]):
        h, total, x = np.zeros((1, gated_lm.HIDDEN), np.float32), 0.0, gated_lm.CLASSES
        for y in classes[a:b]:
            h = net.step(np.array([x]), h)[2]
            total += float(net.log_classes(h, np.array([y]))[0][0])
            x = y
        want.append(total / np.log(10))
    for streams, window in ((256, 16), (2, 7), (1, 1000)):
        assert np.allclose(gated_lm.class_scores(net, classes, first, streams, window), want, rtol=1e-4)


def test_backpropagation():
    rng = np.random.default_rng(5)
    classes = rng.integers(0, gated_lm.CLASSES, 60)
    x, y = classes[:-1].reshape(-1, 1)[:12], classes[1:].reshape(-1, 1)[:12]
    new = np.zeros((12, 1), bool)
    new[5] = True
    net = gated_lm.Network(rng.normal(0, 0.3, len(gated_lm.Network().flat())))
    seen = {}

    class Still(gated_lm.Trainer):
        def update(self, g):
            seen.update({k: v.copy() for k, v in g.items()})

    def loss():
        h, total = np.zeros((1, gated_lm.HIDDEN), np.float32), 0.0
        for t in range(12):
            h = net.step(x[t], h * ~new[t][:, None])[2]
            total -= float(net.log_classes(h, y[t])[0][0])
        return total / 12

    Still(net).window(x, y, new, np.zeros((1, gated_lm.HIDDEN), np.float32))
    for k, p in net.p.items():
        flat, g = p.reshape(-1), seen[k].reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            old = flat[i]
            flat[i] = old + 0.02
            up = loss()
            flat[i] = old - 0.02
            down = loss()
            flat[i] = old
            assert abs((up - down) / 0.04 - g[i]) < 0.05 * abs(g[i]) + 1e-3, k


def test_classes_and_words_make_a_distribution(spark):
    docs = spark.createDataFrame([(t,) for _, t in tricky()], "text string")
    vocab = gated_lm.count_words(docs, flush=50)
    lex = gated_lm.lexicon(vocab)
    rows = vocab.collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    cls = lex.classes(h, np.array([r["suffix"] for r in rows]))
    share = 10 ** lex.word_log(cls, np.array([r["n"] for r in rows]))
    sums = np.bincount(cls, share)
    assert lex.v == len(rows) and lex.n == sum(r["n"] for r in rows) and (sums <= 1 + 1e-9).all()


@pytest.mark.parametrize("labels", [["a", "b", "c"], [None]])
def test_pipeline_keeps_every_text_with_a_letter(spark, labels):
    texts = ["one two", "x", "12 34", None, "", "É", "!!", "three"]
    rows = [(i, texts[i % len(texts)], labels[i // len(texts) % len(labels)], "s", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.identify_language(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    staged = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = common.written(stage(spark, staged, SF), name)
        assert staged.columns == corpus_pipeline.COLUMNS
    import public_tokenizers
    import tiktoken

    from vespera.llm.byte_bpe import read_ranks

    alive = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    kept = {i for i, _, _, k in brute.near_duplicates(alive) if k}
    alive = [(i, t) for i, t in alive if i in kept]
    cut = {i: (n, removed, sha) for i, n, removed, sha in brute.substring_dedup(alive)}
    alive = [(i, t if not cut[i][1] else None) for i, t in alive if cut[i][1] < cut[i][0] or not cut[i][0]]
    texts = {r["doc_id"]: r["text"] for r in staged.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = [(i, t) for i, t in alive if t is not None]
    clean = {i for i, *_, hit in brute.decontaminate(whole, items) if not hit}
    assert {i for i, t in whole if i in texts} == clean and all(texts[i] == t for i, t in whole if i in clean)
    assert all(brute.sha(texts[i]) == cut[i][2] for i, t in alive if t is None and i in texts)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(queries.tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t))
