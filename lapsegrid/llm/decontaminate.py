"""Operator 11, benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, and a scan of the documents' windows.

Words are maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is `n` consecutive
words of an item; an item of fewer words is one window itself. The windows are a table of (64-bit hash, words, set of
items); it is broadcast, in blocks of at most `block` windows, so what is broadcast does not grow with the benchmark.
A document's windows are hashed inside array expressions, exploded, looked up in the set, and a hit is verified word
by word against the window itself. Only hits and one row for each document are shuffled. Everything is built-in
expressions; the words of a document stay in its row and are never copied to its windows.

Windows with the same items share a group, and a hit carries the group, so a window that many items hold costs no more
than any other. A row is known by its id and its text, so equal ids with different texts stay apart, rows that repeat
come back as often, and a text that many documents hold is spread by their ids.

Null and empty texts have no words. Items without words have no window. An item without an id marks words, but is neither
counted nor listed; several rows of one item_id are one item. Other columns of either table are not read. Of empty tables
an empty benchmark hits nothing. A long text is one row in one task, as in the table it comes from.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import saved

#: Words: all but ASCII characters that are neither letter nor digit. Upper case is still in the text here.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Windows of one broadcast: some 100 bytes each.
BLOCK = 500_000


def normalised(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case. Text of ASCII alone, as most words are, takes the quicker way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text, in the case they have there."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), OTHER + "+"), "")


def _window_hash(hashes: Column, at: Column | int, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, at + F.lit(j)) for j in range(size)])


def _entry(size: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), _window_hash(F.col("hw"), i, size).alias("h"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(normalised(w)))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(h, size, gram, grp): every distinct window; and (grp, items): the sorted ids of the items that hold the windows of a group."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), words_of(normalised(F.col(text_column))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("g"))
    held = grams.groupBy(F.array_join("g", " ").alias("gram")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    parts = F.split("gram", " ")
    hashed = F.lit(None).cast("long")
    for size in range(1, n + 1):
        hashed = F.when(F.size("w") == size, _window_hash(F.col("hw"), F.lit(0), size)).otherwise(hashed)
    held = held.withColumn("w", parts).withColumn("hw", _hashes(F.col("w"))).withColumn("grp", F.xxhash64(F.array_join("items", ",")))
    windows = saved(held.select(hashed.alias("h"), F.size("w").alias("size"), "gram", "grp", "items"), "windows")
    groups = windows.groupBy("grp").agg(F.first("items").alias("items"))
    return windows.drop("items"), groups


def _hits(docs: DataFrame, block: DataFrame, sizes: list[int], first: bool, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, point, n_words, at, size, grp): the verified hits in one block of windows, and, in the first block, a row with at = -1 per document."""
    text = F.col(text_column)
    d = docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("point"), words_of(text).alias("w"))
    d = d.select("doc_id", "point", "w", _hashes(F.col("w")).alias("hw"))
    none = F.array().cast("array<struct<at:int,size:int,h:bigint>>")
    parts = [F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("h")))]
    for size in sizes:
        starts = F.sequence(F.lit(0), F.size("hw") - size)
        parts.append(F.when(F.size("hw") >= size, F.transform(starts, _entry(size))).otherwise(none))
    # the entries are a column of their own, so that what explodes and looks up is one compiled stage, in which `w` is not copied;
    # outer: an inner explode would have the entries made twice, once to ask whether they are empty
    d = d.select("doc_id", "point", "w", F.concat(*parts).alias("entries"))
    e = d.select("doc_id", "point", "w", F.explode_outer("entries").alias("e")).select("doc_id", "point", "w", "e.at", "e.size", "e.h")
    table = F.broadcast(block.select("h", "gram", "grp"))
    # first what the set knows, then the words: the comparison makes a string and is asked of hits alone
    met = e.join(table, "h", "left").where((F.col("at") < 0) | F.col("gram").isNotNull())
    same = normalised(F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ")) == F.col("gram")
    kept = met.where((F.col("at") < 0) | same) if first else met.where((F.col("at") >= 0) & same)
    return kept.select("doc_id", "point", F.when(F.col("at") < 0, F.size("w")).cast("long").alias("n_words"), "at", "size", "grp")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, point, n_words, n_hit, n_items, items, spans) for every row of docs.

    point: SHA-256 of the text. items: the sorted ids, as strings. spans: maximal runs of hit words as (begin, end), end exclusive.
    """
    windows, groups = benchmark_windows(benchmark, n, text_column=text_column)
    held = windows.groupBy("size").count().collect()  # at most n rows
    sizes = sorted(r["size"] for r in held)
    blocks = max(1, math.ceil(sum(r["count"] for r in held) / block))
    part = F.pmod(F.xxhash64("gram"), F.lit(blocks))
    # a block is larger than `block` by chance only: hashes deal the windows evenly
    found = [_hits(docs, windows if blocks == 1 else windows.where(part == i), sizes, i == 0, id_column, text_column) for i in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    span = F.when(F.col("at") >= 0, F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("size")).alias("end")))
    rows = every.groupBy("doc_id", "point").agg(
        F.count_if(F.col("at") < 0).alias("copies"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("grp").alias("grps")
    )
    rows = saved(rows.withColumn("spans", _united("spans")), "hits")

    # groups stand for their items; only rows with hits come here
    hit = rows.where(F.size("grps") > 0)
    named = hit.select("doc_id", "point", F.explode("grps").alias("grp")).join(groups, "grp").select("doc_id", "point", F.explode("items").alias("item"))
    named = named.groupBy("doc_id", "point").agg(F.sort_array(F.collect_set("item")).alias("items"))
    mine = hit.alias("a").join(named.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.point") == F.col("b.point")), "left")
    mine = mine.select("a.*", F.coalesce("b.items", F.array().cast("array<string>")).alias("items"))
    clean = rows.where(F.size("grps") == 0).withColumn("items", F.array().cast("array<string>"))
    out = clean.unionByName(mine)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    out = out.select("doc_id", "point", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", "copies")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__copy", "copies")


def _united(spans: str) -> Column:
    """Sorted spans joined where they touch or overlap."""
    kind = "array<struct<begin:int,end:int>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["begin"]), grown).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = 10, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs (all its columns) without the hit words (remove = "spans", with what stands before each) or without the documents that hold any ("documents")."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    found = contamination(docs, benchmark, n, block, id_column, text_column).where("n_hit > 0")
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("point").alias("__point")).agg(F.first("spans").alias("__spans"))
    point = F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    on = F.col(id_column).eqNullSafe(F.col("__id")) & (point == F.col("__point"))
    if remove == "documents":
        return docs.join(found, on, "left_anti")
    pieces = F.regexp_extract_all(F.col(text_column), F.lit(f"{OTHER}*{WORD}+|{OTHER}+"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("__spans", lambda s: (s["begin"] <= i) & (i < s["end"])))
    text = F.when(F.col("__spans").isNull(), F.col(text_column)).otherwise(F.array_join(kept, ""))
    return docs.join(found, on, "left").select(*[text.alias(c) if c == text_column else docs[c] for c in docs.columns])
