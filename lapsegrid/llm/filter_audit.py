"""Operator 12, filter interaction audit by Lehmer-rank difference arrays.

Filters fail or pass a document whatever stands before them, so a document is its mask of failing filters. In an order it
is removed at the first filter of its mask. The orders in which that happens at step s begin with s - 1 filters outside of
the mask and one of the mask; orders with such a beginning have consecutive lexicographic (Lehmer) ranks. So the counts of a
mask are added at the first rank of each such interval and taken off behind its last, and running sums over the ranks give
every order's totals. Documents are counted by (part, mask, labels) first: all further work has a bounded number of rows a part.

Null texts are empty. A document is a repeat if its text equals that of a smaller id anywhere in the table; the rows of the
smallest id, and rows with a null id, are not. Several labels of one id count as 1 if one of them is 1; rows with a null id
have none. Repeated rows count as often. An empty table gives no part and no row. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of all orders of n filters in which a mask is removed at that step. Bit i of a mask is filter i."""
    out = []
    for mask in range(1, 2**n):
        outside = [i for i in range(n) if not mask >> i & 1]
        for before in range(len(outside) + 1):
            for head in itertools.permutations(outside, before):
                for last in (i for i in range(n) if mask >> i & 1):
                    left, rank = list(range(n)), 0
                    for place, f in enumerate((*head, last)):
                        rank += left.index(f) * math.factorial(n - 1 - place)
                        left.remove(f)
                    out.append((mask, before + 1, rank, rank + math.factorial(n - 1 - before)))
    return out


def _letters(n: int) -> Column:
    """The order of rank `rank` as a string of the first n letters, by the digits of its rank."""
    left, order, rest = F.lit(FILTERS[:n]), F.lit(""), F.col("rank")
    for place in range(n):
        unit = math.factorial(n - 1 - place)
        at = F.floor(rest / unit).cast("int")
        letter = left.substr(at + 1, F.lit(1))
        order, left, rest = F.concat(order, letter), F.concat(left.substr(F.lit(1), at), left.substr(at + 2, F.lit(n))), rest % unit
    return order


def failing(text: Column) -> Column:
    """The bits of A (1) to D (8) that a text fails. Its words are made once."""
    words, t = F.col("__words"), F.coalesce(text, F.lit(""))
    upper = F.octet_length(F.regexp_replace(t, "[^A-Z]+", ""))
    tests = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"), 100 * upper.cast("long") > 3 * F.length(t).cast("long"), t.rlike("[#$%&*|]")]
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, part: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, part, mask) for every row of docs: bits 1 to 8 are the filters of the text, bit 16 that a smaller id has it."""
    text, doc_id = F.coalesce(F.col(text_column), F.lit("")), F.col(id_column).cast("long")
    point = F.unhex(F.sha2(text, 256))
    own = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), point.alias("point"), F.col(text_column).alias("text"))
    own = own.withColumn("__words", F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANKS), ""))
    own = own.select("doc_id", "part", "point", failing(F.col("text")).alias("bits"))
    # the first id of each text, met by id and text: a text that a third of the rows hold is spread by their ids
    firsts = docs.select(doc_id.alias("first"), point.alias("same")).where("first IS NOT NULL").groupBy("same").agg(F.min("first").alias("first"))
    met = own.join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("point") == F.col("same")), "left")
    repeat = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("doc_id", "part", (F.col("bits") + F.when(repeat, 16).otherwise(0)).alias("mask"))


def audit(masked: DataFrame, labels: DataFrame, n: int = 5, id_column: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of documents (doc_id, part, mask)."""
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counts = masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic")
    )
    spark = masked.sparkSession
    rows = ", ".join(map(str, intervals(n)))
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(mask, step, lo, hi)")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign"))))
    deltas = counts.join(F.broadcast(table), "mask").select("part", "step", "n", "good", "toxic", ends.alias("e"))
    deltas = deltas.select("part", "step", "e.rank", *[(F.col(c) * F.col("e.sign")).alias(c) for c in ("n", "good", "toxic")])

    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    whole = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(bit(i), F.col("n")).otherwise(0)) for i in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]).alias("alone"),
    )
    orders = math.factorial(n)
    grid = whole.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"))
    zero = F.lit(0).cast("long")
    deltas = deltas.where(F.col("rank") < orders).unionByName(grid.select("*", *[zero.alias(c) for c in ("n", "good", "toxic")]))
    deltas = deltas.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # running sums over the ranks of one (part, step): 120 rows each
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = deltas.select("part", "step", "rank", F.sum("n").over(along).alias("removed"), F.sum("good").over(along).alias("good_lost"), F.sum("toxic").over(along).alias("toxic_lost"))
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = removed.withColumn("gone", F.sum("removed").over(steps)).join(whole, "part").withColumn("filter_order", _letters(n))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    out = out.withColumn("f", F.instr(F.lit(FILTERS), letter) - 1)
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f")))
    fails = F.get("fails", F.col("f"))
    return out.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - F.col("gone")).alias("kept"), "removed", (fails - F.col("removed")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"), "good_lost", "toxic_lost", "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return audit(masks(docs, part), labels)
