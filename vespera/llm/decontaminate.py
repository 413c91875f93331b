"""Benchmark decontamination in DataFrame functions only.

The n-grams (windows) of the benchmark's normalised words form a hash set that goes to every
executor inside the plan, once its size is checked; beyond the bound the windows are joined by
their hashes instead (broadcast up to `most_broadcast` windows). Every window of every text is looked up, hits are verified word for word, and
the documents, or the spans of their hit words, are removed.

Normalisation lower-cases A-Z only, in the lookup as well: lower-casing of all letters depends on
what stands around a letter (a Greek capital sigma at the end of a word), so it would give a text
and a benchmark item different words.

A null or empty text has no words; so has an empty benchmark item, which never occurs. Rows are
independent: a repeated row appears twice in the result. Repeated items each count. An empty
benchmark hits nothing, and an empty table gives an empty result. Further columns may have any names
and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import lower_ascii, packed

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIXED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))  # F.lower is fast, and the same for ASCII texts only
    return F.array_remove(F.split(lower, SEPARATORS), "")


def windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """size, gram, item: each item's windows of n words; a shorter item is one window."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    sized = rows.withColumn("size", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    return sized.select("item", "size", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("gram"))


def _starts(w: Column, size: int) -> Column:
    return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Benchmark:
    """The windows of a benchmark; only their hashes and texts, most_windows at most, come to the driver."""

    def __init__(self, items: DataFrame, n: int = 10, most_windows: int = 60_000, most_broadcast: int = 4_000_000, id_col: str = "item_id", text_col: str = "text"):
        self.grams = windows(items, n, id_col, text_col)
        distinct = self.grams.select("size", "gram").distinct()
        self.n_windows, self.most_broadcast = distinct.count(), most_broadcast
        self.small = self.n_windows <= most_windows
        self.sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())
        self.sets: dict[int, tuple[list[int], list[str]]] = {}
        if self.small:
            for r in distinct.select("size", "gram", F.xxhash64(F.split("gram", " ")).alias("h")).collect():
                hashes, grams = self.sets.setdefault(r["size"], ([], []))
                hashes.append(r["h"])
                grams.append(r["gram"])

    def hits(self, text: Column) -> Column:
        """[(start, size, gram)] of every window of the text that occurs in the benchmark, verified."""
        none = F.array().cast("array<struct<start:int,size:int,gram:string>>")

        def of_size(w: Column, k: int) -> Column:
            found = F.filter(_starts(w, k), lambda i: F.xxhash64(F.slice(w, i, k)).isin(self.sets[k][0]))
            return F.transform(found, lambda i: F.struct(i.alias("start"), F.lit(k).alias("size")))

        def loose(w: Column) -> Column:
            return F.concat(*(of_size(w, k) for k in self.sizes)) if self.sizes else F.array().cast("array<struct<start:int,size:int>>")

        def exact(found: Column) -> Column:
            with_gram = lambda w: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(F.slice(w, x["start"], x["size"]), " ").alias("gram")))
            known = lambda x: F.lit(False) if not self.sizes else x["gram"].isin([g for k in self.sizes for g in self.sets[k][1]])
            return F.when(F.size(found) > 0, F.filter(_let(words(text), with_gram), known)).otherwise(none)

        return _let(_let(words(text), loose), exact)


def _covered(hits: Column) -> Column:
    """The number of words inside any hit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["size"]).alias("end"))
    return F.aggregate(F.array_sort(hits), start, add, lambda a: a["n"].cast("long"))


def _joined_hits(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """The way for benchmarks over the bound: rows (row, w) -> row, hits. Hashes are joined first, their hits word for word."""

    def hashed(k: int) -> Column:
        return F.transform(_starts(F.col("w"), k), lambda i: F.struct(i.alias("start"), F.lit(k).alias("size"), F.xxhash64(F.slice("w", i, k)).alias("h")))

    each = rows.select("row", F.inline(F.concat(*map(hashed, bench.sizes))))
    known = bench.grams.select("size", "gram").distinct()
    hashes = known.select("size", F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
    near = each.join(F.broadcast(hashes) if bench.n_windows <= bench.most_broadcast else hashes, ["size", "h"], "left_semi")
    places = near.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("found"))
    spelled = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(F.slice("w", x["start"], x["size"]), " ").alias("gram")))
    hits = rows.join(places, "row").select("row", F.inline(spelled)).join(known, ["size", "gram"], "left_semi")
    return hits.groupBy("row").agg(F.collect_list(F.struct("start", "size", "gram")).alias("hits"))


def with_hits(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """rows (text and others) and the column `hits`."""
    if bench.small:
        return rows.withColumn("hits", bench.hits(F.col("text")))
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    found = _joined_hits(numbered.select(F.col("number").alias("row"), words(F.col("text")).alias("w")), bench).withColumnRenamed("row", "number")
    none = F.array().cast(found.schema["hits"].dataType)
    return numbered.join(found, "number", "left").withColumn("hits", F.coalesce("hits", none)).drop("number")


def report(docs: DataFrame, bench: Benchmark, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every text."""
    rows = with_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), bench)
    counted = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size(words(F.col("text"))).cast("long").alias("n_words"), _covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["gram"])).alias("grams"))
    items = bench.grams.groupBy("gram").agg(F.collect_set("item").alias("items"))
    named = counted.withColumn("gram", F.explode_outer("grams")).drop("grams").join(items, "gram", "left")
    each = named.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return each.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, bench: Benchmark, text_col: str = "text") -> DataFrame:
    """The documents without a hit, their columns unchanged."""
    return with_hits(packed(docs, text=F.col(text_col)), bench).where(F.size("hits") == 0).select("row.*")


def remove_spans(docs: DataFrame, bench: Benchmark, text_col: str = "text") -> DataFrame:
    """The documents without the words inside hits and the separators between two such words."""
    pieces = F.regexp_extract_all("text", F.lit(f"({MIXED_SEPARATORS}|{MIXED_SEPARATORS.replace('[', '[^', 1)})"), 1)
    blank = lambda p: p.rlike(f"^{MIXED_SEPARATORS}$")
    inside = lambda i: F.exists("hits", lambda x: (i >= x["start"]) & (i < x["start"] + x["size"]))

    def kept(p: Column) -> Column:
        first = F.when(blank(F.element_at(p, 1)), 1).otherwise(0)  # pieces alternate: word w is piece 2 w - 1 + first
        here = lambda i: F.when((i + 1 - first) % 2 == 1, inside(((i + 2 - first) / 2).cast("int"))).otherwise(inside(((i + 1 - first) / 2).cast("int")) & inside(((i + 3 - first) / 2).cast("int")))
        return F.array_join(F.filter(F.transform(p, lambda x, i: F.struct(x.alias("p"), here(i).alias("gone"))), lambda x: ~x["gone"]).getField("p"), "")

    text = F.when(F.size("hits") == 0, F.col("text")).otherwise(_let(pieces, kept))
    return with_hits(packed(docs, text=F.col(text_col)), bench).select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
