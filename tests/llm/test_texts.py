"""Operators on single texts: exact libraries, round trips, brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm import brute
from vespera.llm import byte_bpe, decontaminate, language_id, license_scan, media, queries, token_counts, url_filter

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "  a  b ", "\n\t", "a" * 3000, "ab " * 2000, " " * 700, "naïve ŝ 漢字 😀", "▁x ▁▁", "<s> </s> <0x41> <|endoftext|>", "\x00\x1c\x85", "the the the", "the the the"]


def frame(spark, texts):
    """Texts and a null, ids from 0, a further column named like an inner one."""
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, id string").repartition(3)


def corpus(spark, n=200):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


def hard(n=300):
    rng = random.Random(4)
    letters = "ab  te in the'sll\n\t é漢字😀<>0x41/ \x1c\x85٣²▁ "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + hard() + corpus(spark)
    got = by_id(token_counts.token_counts(frame(spark, texts), path, limit=20))
    for i, t in enumerate([*texts, ""]):
        n = len(library.encode(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 20), t[:50]


def test_long_words_are_counted_in_chunks():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = token_counts.Counter(path, most=50, chunk=64)
    own.transducer.most = 500  # states are forgotten and compiled again
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdetionéñ") for _ in range(n)) for n in (63, 64, 65, 1000, 5000)] + [w * 300 for w in ("tion", "ab", "é")]
    assert own.count_batch(texts).tolist() == [len(library.encode(t)) for t in texts]


def test_state_maps_compose():
    own = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model")).transducer
    text = "▁internationalisation"
    for cut in range(len(text)):
        state, n = own.run(text[:cut])
        end, more = own.run(text[cut:], state)
        assert (end, n + more) == own.run(text)


def test_chunk_maps_compose_in_a_scan():
    own = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"), chunk=7).transducer
    rng = random.Random(3)
    text = "▁" + "".join(rng.choice("abcdetionéñ") for _ in range(200))
    for size in (1, 7, 50, 500):
        parts = [text[a : a + size] for a in range(0, len(text), size)]
        maps = [token_counts.ChunkMap(own, p) for p in parts]
        for m in maps[1:]:
            m[own.through("e", token_counts.START)[0]]  # often not the entry state: the map is extended
        ends = token_counts.prefix_scan(maps)
        for i, m in enumerate(ends):
            state, n = own.run("".join(parts[: i + 1]))
            assert m[token_counts.START] == (own.keys[state], n)
    assert own.through("ab", own.keys[own.run("▁t")[0]])[1] + own.run("▁t")[1] == own.run("▁tab")[1]


def test_states_are_bounded_within_one_word():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = token_counts.Counter(path, chunk=64)
    own.transducer.most = 300
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdetionéñ") for _ in range(20_000))
    for t in (text, "  " + text, "x   " + text):
        assert own.count_batch([t]).tolist() == [len(library.encode(t))]
        assert len(own.transducer.keys) < 300 + 4097


def test_byte_bpe_is_the_library_s(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = ODD + hard() + corpus(spark)
    df = frame(spark, texts)
    got = by_id(byte_bpe.round_trip(df, path, public_tokenizers.PATTERN))
    encoded = byte_bpe.encode(df, path, public_tokenizers.PATTERN)
    ids, back = by_id(encoded), by_id(byte_bpe.decode(encoded, path))
    for i, t in enumerate([*texts, ""]):
        want = library.encode_ordinary(t)
        assert list(ids[i]["ids"]) == want and bytes(back[i]["bytes"]) == t.encode()
        joined = " ".join(map(str, want))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), brute.sha(joined), hashlib.sha256(t.encode()).hexdigest())


def test_byte_bpe_clears_its_cache():
    own = byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, most=5)
    text = "one two three four five six seven eight nine ten"
    assert own.encode(text) == own.encode(text) and len(own) <= 7


def test_language_id(spark):
    words = {"en": "the of and thing other", "de": "der und nicht schön über", "fr": "le des être où ça"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !!", "de"), (902, "the other thing", None), (903, "", "fr"), (904, "DER SCHÖNE und " * 4000, None), (905, "½ ² ① Ⅷ", "en")], "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 4 != 2
    model = language_id.fit(docs, learn, bits=12)
    got = {r["doc_id"]: (r["_lang"], r["_score"]) for r in language_id.identify(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[900] == got[901] == got[903] == got[905] == ("und", 0.0) and got[902][0] == "en" and got[904][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.fit(docs.where("false"), F.lit(True), bits=12)
    assert {r["_lang"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    few = language_id.fit(docs, learn, bits=12, train_docs=30)
    assert few.log.shape == model.log.shape


def test_language_id_samples_every_label(spark):
    rows = [(i, "the of and thing", "en") for i in range(3000)] + [(5000 + i, "der und nicht", "de") for i in range(40)] + [(6000, "ja ei kyllä", "fi"), (6001, "12 34", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for train_docs in (90, 2):
        model = language_id.fit(docs, F.lit(True), bits=12, train_docs=train_docs)
        assert model.labels == ["de", "en", "fi"] and all(row[:-1].max() > row[:-1].min() for row in model.log)
        assert model.predict(["kyllä", "nicht", "thing"])[0] == ["fi", "de", "en"] or train_docs == 2
    assert language_id._part([3000, 40, 1], 90) == 49 and language_id._part([3000, 40, 1], 11) == 5 and language_id._part([5, 1], 90) == 5
    whole = language_id.fit(docs, F.lit(True), bits=12)
    assert whole.log.shape == model.log.shape and whole.prior.tolist() == model.prior.tolist()


def test_language_id_by_brute_force(spark):
    """Bayes by plain sums over the same grams, counted one by one."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("aeiß" + lang) for _ in range(4)) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(["en", "de", "xy"] * 20)]
    docs = spark.createDataFrame([*rows, (500, "-", None)], "doc_id long, text string, lang string").withColumns({"_lang": F.lit("mine"), "_score": F.lit("mine"), "id": F.lit(1)})
    model = language_id.fit(docs, F.col("doc_id") < 40, bits=10)
    got = language_id.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "id", "_lang", "_score"]

    def grams(text):
        found, starts = language_id.features([text], 10)
        return [int(g) for row in found for g in row if g < 2 << 10]

    counts = {}
    for i, t, lang in rows:
        if i < 40:
            counts.setdefault(lang, Counter()).update(grams(t))
    prior = Counter(lang for i, _, lang in rows if i < 40)
    for r in got.where("doc_id < 500").collect():
        logs = {}
        for lang, own in counts.items():
            total = sum(own.values()) + 0.5 * (2 << 10)
            logs[lang] = math.log(prior[lang] / 40) + sum(math.log((own[g] + 0.5) / total) for g in grams(r["text"]))
        best = max(sorted(logs), key=logs.get)
        assert r["_lang"] == best and math.isclose(r["_score"], 1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel_tol=1e-3)
    assert language_id.identify(docs.where("false"), model).count() == 0


def test_empty_tables_of_single_texts(spark):
    none = frame(spark, ["a"]).where("false")
    piece, byte = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert token_counts.token_counts(none, piece).count() == media.store_payloads(none).count() == byte_bpe.round_trip(none, byte, public_tokenizers.PATTERN).count() == 0


def test_clashing_names_of_single_texts(spark):
    names = ["_hits", "_row", "hits", "row", "number", "w", "id", "n_tokens", "h", "keys", "best", "host"]
    docs = spark.createDataFrame([(0, "a b c"), (1, "x"), (2, None)], "doc_id long, text string").select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names))
    items = spark.createDataFrame([("i", "B c")], "item_id string, text string")
    for most in ({}, {"most_windows": 0}):
        bench = decontaminate.Benchmark(items, **most)
        kept, cut = decontaminate.remove_documents(docs, bench), decontaminate.remove_spans(docs, bench)
        assert kept.columns == cut.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == [(i, t, *(f"{c}{i}" for c in names)) for i, t in ((1, "x"), (2, None))]
        assert sorted(map(tuple, cut.collect())) == [(i, t, *(f"{c}{i}" for c in names)) for i, t in ((0, "a "), (1, "x"), (2, None))]
        assert decontaminate.report(docs, bench).count() == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://com/en/x").alias("url"), *names)
    assert [r["verdict"] for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()] == ["block"] * 3


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (brute.remainder(r["doc_id"], 4) == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


ITEMS = [("a", "One two three four five six seven eight nine ten eleven"), ("b", "short one"), ("c", ""), ("d", None), ("e", "ONE, two three four five six seven eight nine ten"), ("f", "é è ê ë à â ä ô ö û")]
TEXTS = [
    "zero one two three four five six seven eight nine ten eleven twelve", "a short One! and short one", "short, one short one", "", None, "É è ê ë à â ä ô ö û", "é è ê ë à â ä ô ö û é", "nothing of this kind here",
    "x " * 5000 + "one two three four five six seven eight nine ten " * 3, "one two three", "İ short one", "one two three four five six seven eight nine",
]


@pytest.mark.parametrize("most", [{}, {"most_windows": 1}, {"most_windows": 1, "most_broadcast": 1}])
def test_decontamination(spark, most):
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, w string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    bench = decontaminate.Benchmark(items, **most)
    want = brute.decontaminate([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == sorted(want)
    kept = [r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()]
    assert sorted(kept) == sorted(i for i, *_, hit in want if not hit)
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert spans[0] == "zero  twelve" and spans[2] == "" and spans[5] == TEXTS[5] and spans[7] == TEXTS[7] and spans[3] == "" and spans[4] is None
    assert spans[1] == "a ! and " or spans[1].startswith("a ")


@pytest.mark.parametrize("most", [{}, {"most_windows": 1}])
def test_decontamination_of_capital_sigma(spark, most):
    texts = ["ΟΔΟΣ.ΑΒ ΓΔ", "ΟΔΟΣ ΑΒ ΓΔ", "ΟΔΟΣ", "ΑΒ:ΣΑΣ'ΓΔ EF", "ΑΒ ΣΑΣ ΓΔ ef", "οδος αβ γδ", "Σ.Σ^Σ`A", "σ σ σ a"]
    items = [("a", "ΟΔΟΣ ΑΒ ΓΔ"), ("b", "ΑΒ ΣΑΣ.ΓΔ ef"), ("c", "Σ Σ Σ a"), ("d", "ΚΟΣΜΟΣ.ΓΗ ΖΩ")]
    texts += ["ΚΟΣΜΟΣ ΓΗ ΖΩ", "ΚΟΣΜΟΣ.ΓΗ ΖΩ"]
    docs = list(enumerate(texts))
    bench = decontaminate.Benchmark(spark.createDataFrame(items, "item_id string, text string"), **most)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.decontaminate(docs, items)
    assert [hit for *_, hit in want] == [True, True, False, True, True, False, True, False, True, True]
    assert sorted(map(tuple, decontaminate.report(frame, bench).collect())) == sorted(want)
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(frame, bench).collect()) == [2, 5, 7]


def test_decontamination_without_items_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = decontaminate.Benchmark(spark.createDataFrame([], "item_id string, text string"))
    assert decontaminate.report(docs, none).first()["contaminated"] is False
    assert decontaminate.report(docs.where("false"), none).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op7_benchmark_decontamination(spark, SF).collect())) == sorted(brute.decontaminate(docs, items))


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/7x?q", "http://com/en/1", "http://example.net/de/8", "https://x.example.net/de/9#f", "ftp://org?/es/", "http://org/es/", "http://notcom/en/", "http://x.com/en", "a://b://c.com/en/", "://com/en/x",
    "http://example.com/en/7", "http://ample.com/en/7",
]


def verdicts(url):
    rules = [(r.action, r.host, r.path) for r in queries.URL_RULES]
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(brute.UPPER)
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[1], max(fit)[2]) if fit else (None, "allow")))


@pytest.mark.parametrize("most_bits", [1 << 23, 0])
def test_url_filter(spark, most_bits):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[3]])], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, queries.URL_RULES, most_bits=most_bits).collect()}
    assert got == {i: verdicts(u) for i, u in enumerate([*URLS, URLS[3]])}
    assert url_filter.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0
    assert url_filter.filter_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 3300, 11).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = url_filter.Cascade.build(listed, universe, error=0.3)
    assert len(cascade.levels) > 2
    got = {r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 11)}
    with pytest.raises(url_filter.TooLarge):
        url_filter.Cascade.build(listed, universe, most_bits=64)


def test_license_scan(spark):
    text = "Copyright (c) 2020 Someone\n" + license_scan.MIT.replace("to deal in", "TO DEAL  in").replace('"', "'")
    rows = [text, license_scan.ISC + "\nmore", None, "!!!", "", license_scan.MIT, "released under the mit licence", license_scan.BSD_HEAD.replace("copyright notice", "copyright notice") + license_scan.BSD_TAIL, license_scan.MIT]
    got = by_id(license_scan.scan(frame(spark, rows)))
    assert [got[i]["license"] for i in range(len(rows))] == ["MIT", None, None, None, None, "MIT", "MIT-line", "BSD-2-Clause", "MIT"]
    assert got[2]["digest"] is None and got[3]["digest"] is None and got[4]["digest"] is None and got[1]["digest"]
    assert license_scan.scan(frame(spark, rows).where("false")).count() == 0


def wrapped(text, width):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def test_license_scan_of_wrapped_texts(spark):
    """Lines of the body that begin with "copyright" are no notices, wherever lines are broken."""
    plain = {"MIT": license_scan.MIT, "ISC": license_scan.ISC, "0BSD": license_scan.ZERO_BSD, "Unlicense": license_scan.UNLICENSE, "BSD-2-Clause": license_scan.BSD_HEAD + license_scan.BSD_TAIL, "BSD-3-Clause": license_scan.BSD_HEAD + license_scan.BSD_NAME + license_scan.BSD_TAIL}
    rows = [(name, wrapped(t, width)) for name, t in plain.items() for width in range(30, 110, 5)]
    notices = ["Copyright (c) 2020 Some One", "  Copyright 2001-2004, Some One", "© 1999 X", "(C) 2000 Y", "COPYRIGHT © Z\nAll rights reserved.", "Copyright [yyyy] [name of copyright owner]", "copyright: 2003 Q\r"]
    rows += [("MIT", f"{n}\n\n{wrapped(license_scan.MIT, 72)}") for n in notices] + [("BSD-3-Clause", f"BSD 3-Clause License\n\n{notices[0]}\n{plain['BSD-3-Clause']}"), (None, "Copyright holders say:\n" + license_scan.MIT)]
    got = by_id(license_scan.scan(frame(spark, [t for _, t in rows])))
    assert [got[i]["license"] for i in range(len(rows))] == [name for name, _ in rows]


def test_spellings_of_neighbours(spark):
    texts = ["licence licence licence", "License license LICENSE", "per cent per cent", "percent, percent", "sublicence\nlicence", "sublicense license", "licences", "licenses"]
    got = by_id(license_scan.scan(frame(spark, texts)))
    assert [got[i]["digest"] == got[i + 1]["digest"] for i in range(0, 8, 2)] == [True, True, True, False]


def test_license_lines(spark):
    texts = ["One.\nReleased under the MIT licence\nTwo\n  licensed under CC  BY-NC 4.0!", "We say: Released under the MIT License.", "Released under the MIT License.", license_scan.ISC + "\nReleased under the MIT License."]
    got = by_id(license_scan.scan_lines(frame(spark, texts)))
    assert [(got[i]["license"], got[i]["line_licenses"]) for i in range(5)] == [(None, ["CC-BY-NC-4.0-line", "MIT-line"]), (None, []), ("MIT-line", ["MIT-line"]), (None, ["MIT-line"]), (None, [])]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = con.sql(queries.oracle_sql()["op6_license_scan"])
    rows = queries.op6_license_scan(spark, SF).collect()
    assert sorted(map(repr, (tuple(r[c] for c in out.columns) for r in rows))) == sorted(map(repr, out.fetchall()))
    assert any(r["line_licenses"] for r in rows)
    assert license_scan.scan_lines(frame(spark, texts).where("false")).count() == 0


def test_license_scan_with_a_table(spark):
    full = "Mozilla Public License Version 2.0\n\n1. Definitions" + " more of it" * 4000
    table = spark.createDataFrame([("MPL-2.0", full), ("MIT", "The MIT License (MIT)\n\n" + license_scan.MIT), ("none", "!!!"), ("no text", None)], "license string, text string")
    known = license_scan.known_digests(spark).unionByName(license_scan.table_digests(table))
    rows = ["The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + license_scan.MIT, full.upper(), license_scan.ISC, "?", None, "other"]
    got = by_id(license_scan.scan(frame(spark, rows), known))
    assert [got[i]["license"] for i in range(len(rows))] == ["MIT", "MPL-2.0", "ISC", None, None, None] and len(got) == len(rows) + 1


def test_media_round_trip(spark):
    texts = ["", "a", "é" * 700, "x y\n" * 5000, "\x00\x7f", *corpus(spark, 60), "a"]
    df = frame(spark, texts)
    got = by_id(media.store_payloads(df, files=True))
    back = by_id(media.read_payloads(media.store_payloads(df, files=True)))
    for i, t in enumerate([*texts, ""]):
        raw = t.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert bytes(back[i]["payload"]) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert got[1]["feature"] == got[len(texts) - 1]["feature"] and got[1]["media_sha256"] == got[len(texts) - 1]["media_sha256"]
    tensors = {r["id"]: r for r in media.decode_images(media.store_payloads(df, files=True).select(F.col("doc_id").alias("id"), "media").unionByName(spark.createDataFrame([(-1, None), (-2, b"no"), (-3, b"\xff\xd8\xff\xd9")], "id long, media binary")), "id", "media").collect()}
    assert tensors[-1]["rgb"] is None and tensors[-1]["error"] is None and tensors[-2]["error"]
    size, _, *sums = got[3]["feature"].split()
    t = tensors[3]
    assert f"{t['width']}x{t['height']}" == size and len(t["rgb"]) == 3 * t["width"] * t["height"]
    assert [sum(t["rgb"][c::3]) for c in range(3)] == list(map(int, sums))


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.exists(), reason="this system has no licence texts")
def test_full_licence_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    assert set(files) == set(license_scan.FULL)
    rows = []
    for name, file in files.items():
        if (COMMON / file).exists():
            text = (COMMON / file).read_text()
            end = text.upper().find("END OF TERMS AND CONDITIONS")
            rows += [(name, text), (name, text.upper().replace("(C)", "(c)")), (name, text.replace("\n", "\r\n")), (None, text[:-40]), (None, text + " or else")]
            rows += [(name, text[: end + 27]), (name, text[:end])] if end > 0 else []
    got = by_id(license_scan.scan(frame(spark, [t for _, t in rows])))
    assert [got[i]["license"] for i in range(len(rows))] == [name for name, _ in rows]
    known = [r["digest"] for r in license_scan.known_digests(spark).collect()]
    assert len(known) == len(set(known))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(rows)])
    out = con.sql(queries.oracle_sql()["op6_license_scan"]).fetchall()
    assert {r[0]: (r[1], r[2]) for r in out} == {i: (got[i]["digest"], got[i]["license"]) for i in range(len(rows))}
