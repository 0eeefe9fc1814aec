"""Operator 4, quality rules: suffix-array repetition.

Each text becomes a sequence of words. A suffix array over it (prefix doubling, restricted to suffixes that are
still tied) and the longest common prefixes of neighbours give, for every word, the longest run of words that
starts there and also starts elsewhere in the text. The LCP interval above a suffix is the deepest one that
holds it, so those runs are the occurrences of the maximal repeats; shorter or non-left-maximal repeats lie
inside them. The union of the runs of at least `min_words` words is what the text repeats. Two limits follow:
the share of the words covered by repeats, and the longest repeat.

Null and empty texts have no words, fail the base rule and are rejected. Rows are judged one by one, so ties,
repeated rows and extra columns change nothing. A text is never cut; one text is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import map_texts, slices


@dataclass(frozen=True)
class RepetitionRules:
    """min_words: shortest repeat that counts. most_covered: largest share of words in repeats. most_longest: longest repeat, in words."""

    min_words: int = 5
    most_covered: float = 0.5
    most_longest: int = 60


def longest_repeats(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the longest run of words starting there that starts elsewhere in the same document. `doc` ascends."""
    n = len(word)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    end = np.searchsorted(doc, doc, side="right")
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key)
    at = np.arange(n)

    def starts(sorted_key: np.ndarray) -> np.ndarray:
        i = at[: len(sorted_key)]
        return np.maximum.accumulate(np.where(np.r_[True, sorted_key[1:] != sorted_key[:-1]], i, 0))

    def tied(start: np.ndarray) -> np.ndarray:
        same = start[1:] == start[:-1]
        return np.r_[same, False] | np.r_[False, same]

    start = starts(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, active, step = [rank.astype(np.int32 if n < 2**31 else np.int64)], order[tied(start)], 1
    while len(active):
        following = active + step
        second = np.where(following < end[active], rank[np.minimum(following, n - 1)] + 1, 0)
        pair = rank[active] * (n + 1) + second
        by_pair = np.argsort(pair)
        active, pair = active[by_pair], pair[by_pair]
        old = rank[active]
        start = starts(pair)
        rank[active] = old + start - starts(old)
        levels.append(rank.astype(levels[0].dtype))
        active, step = active[tied(start)], 2 * step
    suffixes = np.argsort(rank)
    a, b = suffixes[:-1], suffixes[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    i, j, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        equal = (i < n) & (j < n) & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)])
        i, j, common = i + (equal << level), j + (equal << level), common + (equal << level)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1))[:n] > 0


def measure(texts: list) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """One row of figures per text, and the flags of its words that lie in repeats are left to `judge`."""
    encoded = [t.encode() if t else b"" for t in texts]
    split = [t.split() for t in encoded]
    n_words = np.array([len(w) for w in split], np.int64)
    out = pd.DataFrame({"n_words": n_words})
    out["word_chars"] = [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) if t else 0 for t in texts]
    out["n_symbols"] = [sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) for t in encoded]
    duplicates = []
    for t in encoded:
        lines = [x for x in t.split(b"\n") if x.strip()]
        duplicates.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = duplicates
    flat = [w for words in split for w in words]
    word = pd.factorize(pd.Series(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    longest = longest_repeats(word, doc)
    n = len(word)
    inside = np.flatnonzero(longest >= 8)
    window = covered(inside, np.full(len(inside), 8), n)
    out["n_repeat_words"] = np.bincount(doc, weights=window, minlength=len(texts)).astype(np.int64)
    return out, [doc, longest]


def judge(texts: list, rules: RepetitionRules) -> pd.DataFrame:
    """Figures, the repeats' spans and the verdict for each text."""
    out, (doc, longest) = measure(texts)
    n, k = len(longest), len(texts)
    inside = np.flatnonzero(longest >= rules.min_words)
    flags = covered(inside, longest[inside], n)
    out["covered_words"] = np.bincount(doc, weights=flags, minlength=k).astype(np.int64)
    top = np.zeros(k, np.int64)
    np.maximum.at(top, doc[inside], longest[inside])
    out["longest_repeat"] = top
    first = np.r_[0, np.cumsum(out["n_words"].to_numpy())]
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: list[list] = [[] for _ in range(k)]
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        while a < b:  # flags of neighbouring texts may touch
            d = int(doc[a])
            to = min(b, int(first[d + 1]))
            spans[d].append([a - int(first[d]), to - int(first[d])])
            a = to
    out["repeat_spans"] = spans
    out["base_failed"] = (out.n_words < 20) | (100 * out.n_repeat_words > 30 * out.n_words)
    out["kept"] = ~out.base_failed & (out.covered_words <= rules.most_covered * out.n_words) & (out.longest_repeat <= rules.most_longest)
    return out


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, repeat_spans array<array<long>>, base_failed boolean, kept boolean"
)


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: figures, spans of repeated words (first, behind the last) and the verdict. No shuffle."""
    kinds = {"repeat_spans": pa.list_(pa.list_(pa.int64())), "base_failed": pa.bool_(), "kept": pa.bool_()}

    def work(texts: list) -> list[pa.Array]:
        made = judge(texts, rules)
        return [pa.array(made[c].tolist(), kinds.get(c, pa.int64())) for c in [f.split()[0] for f in SCHEMA.split(", ")][1:]]

    return map_texts(docs, [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")], work, SCHEMA)


def keep_by_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text passes."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist(), rules)["kept"].tolist(), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
