"""Operator 5, personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans: everything that looks like an address (plain or spelled out) and
every run of digit groups as a telephone number, a card number or an IP address, whole or in part. Each candidate has
features of its format and its context; boosted trees score it; a threshold calibrated on held-out candidates for a
wanted precision selects. The base rules' spans always stay, and a selected span is added only where it overlaps
neither a base span nor a better one.

The trees are fitted on a bounded sample: `sample_documents` documents at most, chosen by a hash. Labels are weak: base
spans, also rewritten in other formats (no plus sign, other separators, spelled-out signs), are positive; digit runs
that fail the checks, versions, dates, amounts and plain phrases are negative.

Null and empty texts have no spans. Texts are judged whole, one by one; every pattern takes linear time, however long
a run of digits or letters is. Repeated rows are judged alike. Without any base span in the sample nothing is added.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import map_texts, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]*+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    out = []
    for m in _PLUS.finditer(text):
        found = m[0].rstrip(" ().-")
        digits = sum(c.isdigit() for c in found)
        if len(found) >= 4 and 8 <= digits <= 15:
            out.append((m.start(), m.start() + len(found)))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


# generators

_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[(] ?at ?[\])]| at ) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]{1,63}+){1,8}", re.I
)
_HINT = re.compile(r"@|[\[(] ?at ?[\])]| at(?= )", re.I)
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9])*+")
_GROUP = re.compile(r"[0-9]+")
#: Digit groups of one candidate at most: a card, a number or an address has no more.
GROUPS = 6
_WORDS = {
    "email": re.compile(r"mail|contact|write|@", re.I), "ip": re.compile(r"\bip\b|host|server|address|addr", re.I),
    "card": re.compile(r"card|visa|pay|credit|account", re.I), "phone": re.compile(r"tel|phone|call|mobile|fax|\+", re.I),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping (kind, start, end) with high recall."""
    out: set[tuple[str, int, int]] = set()
    for hint in _HINT.finditer(text):
        # one blank may stand before the hint; a local part is at most 64 characters long, so look from there on
        end = begin = hint.start() - text.startswith(" ", max(0, hint.start() - 1), hint.start())
        while begin and end - begin < 64 and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _SPELLED.match(text, begin) if begin < end else None
        if m:
            out.add(("email", m.start(), m.end()))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, min(len(groups), i + GROUPS)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                begin, end = groups[i][0], groups[j][1]
                if i == 0:
                    begin = m.start()
                elif text[begin - 1] == "(":
                    begin -= 1
                if 7 <= digits <= 15:
                    out.add(("phone", begin, end))
                if 13 <= digits <= 19:
                    out.add(("card", groups[i][0], end))
                if j == i + 3 and digits <= 12:
                    out.add(("ip", groups[i][0], end))
    return sorted(out)


def features(text: str, kind: str, begin: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    found = text[begin:end]
    groups = [g for g in _GROUP.findall(found)]
    digits = "".join(groups)
    before, after = text[max(0, begin - 40) : begin], text[end : end + 20]
    last, following = before[-1:], after[:1]
    tail = re.split(r"[. \])]", found)[-1]
    numeric = kind != "email"
    return [
        float(KINDS.index(kind)), float(len(found)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(numeric and luhn(digits)), float(kind == "ip" and all(map(_byte, groups))), float(found.count(".")), float(found.count("-")), float(found.count(" ")), float("(" in found),
        float(found[:1] == "+"), float("@" in found), float(bool(re.search(r"[\[(] ?(?:at|dot) ?[\])]", found, re.I))), float(" dot " in found.lower()), float(tail.isalpha()), float(len(tail)),
        float(last.isalnum()), float(last in ".-/+($€£#" if last else False), float(following.isalnum()), float(following in "-/%$€" if following else False),
        float(bool(_WORDS[kind].search(before))), sum(c.isdigit() for c in before) / 40.0, sum(c.isdigit() for c in after) / 20.0,
    ]


# boosted trees


@dataclass(frozen=True)
class Boosted:
    """Trees of depth `depth` as complete arrays: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    select: np.ndarray  # the calibrated threshold of each kind, in log odds

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, precision: float = 0.99, rounds: int = 40, depth: int = 3, rate: float = 0.2) -> Boosted:
    """Boosting on the logistic loss with exact splits over quantile cuts. Every fourth row is held out to calibrate the thresholds."""
    held = np.arange(len(y)) % 4 == 3
    xt, yt = x[~held], y[~held]
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, 33))) for f in range(x.shape[1])]
    mean = min(max(yt.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(len(yt), start)
    inner = 2**depth - 1
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = yt - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(yt), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-9
            for f in range(x.shape[1]):
                if len(rows) < 20:
                    break
                place = np.searchsorted(cuts[f], xt[rows, f])  # value <= cuts[place]
                gs, hs = np.cumsum(np.bincount(place, g[rows], len(cuts[f]) + 1)), np.cumsum(np.bincount(place, h[rows], len(cuts[f]) + 1))
                gl, hl, ga, ha = gs[:-1], hs[:-1], gs[-1], hs[-1]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, feature[node], threshold[node] = gain[i], f, cuts[f][i]
            at[rows] = 2 * node + 1 + (xt[rows, feature[node]] > threshold[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += value[leaf]
        trees.append((feature, threshold, value))
    model = Boosted(*(np.array(a) for a in zip(*trees, strict=True)), start, np.full(len(KINDS), np.inf))
    s, xh, yh = model.score(x[held]), x[held], y[held]
    select = np.full(len(KINDS), np.inf)
    for kind in range(len(KINDS)):
        mine = xh[:, 0] == kind
        order = np.argsort(-s[mine])
        sk, right = s[mine][order], np.cumsum(yh[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero((right >= precision) & np.r_[sk[1:] < sk[:-1], True][: len(sk)]) if mine.any() else []
        if len(good):
            select[kind] = max(float(sk[good[-1]]), 0.0)
    return Boosted(model.feature, model.threshold, model.value, start, select)


def _rewritten(kind: str, found: str, draw: random.Random) -> list[str]:
    """The same datum in other formats."""
    digits = "".join(c for c in found if c.isdigit())
    if kind == "email":
        local, _, domain = found.partition("@")
        return [f"{local} at {domain.replace('.', ' dot ')}", f"{local}(at){domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}"]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours)]
    if kind == "phone" and len(digits) >= 10:
        area, mid, rest = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({area}) {mid}-{rest}", f"{area}-{mid}-{rest}", f"{area}.{mid}.{rest}"]
    return []


def _negative(draw: random.Random) -> tuple[str, str]:
    n = draw.randint
    number = "".join(str(n(0, 9)) for _ in range(n(16, 19)))
    bad = number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)
    return draw.choice([
        ("card", bad), ("card", "-".join(bad[i : i + 4] for i in range(0, 16, 4)) if not luhn(bad[:16]) else bad), ("ip", f"{n(256, 999)}.{n(0, 255)}.{n(0, 255)}.{n(0, 999)}"),
        ("phone", f"{n(1900, 2100)}-{n(1, 12):02d}-{n(1, 28):02d}"), ("phone", f"{n(1, 28):02d}.{n(1, 12):02d}.{n(1900, 2100)}"), ("phone", f"{n(1000000, 99999999)}"), ("phone", f"{n(1, 9)}.{n(100, 999)}.{n(100, 999)}.{n(100, 999)}"),
        ("phone", f"{n(1900, 2100)}/{n(1900, 2100)}"), ("phone", f"{n(10, 99)} {n(10, 99)} {n(100, 999)} {n(1, 9)}"), ("email", f"{draw.choice(['look', 'meet', 'was', 'is', 'one'])} at {draw.choice(['home', 'the', 'noon'])}."),
    ])


def learn(texts: list[str], precision: float = 0.99, seed: int = 5) -> Boosted | None:
    """Trees from the weak labels of a sample of texts, or None if it holds no base span."""
    draw = random.Random(seed)
    x: list[list[float]] = []
    y: list[int] = []
    contexts = [t for t in texts if len(t) > 100]
    positives = 0

    def insert(found: str, kind: str, label: int) -> None:
        host = draw.choice(contexts)
        at = host.find(" ", draw.randint(0, len(host) - 1)) + 1
        text, begin = f"{host[:at]}{found} {host[at:]}"[max(0, at - 60) : at + len(found) + 60], min(at, 60)
        x.append(features(text, kind, begin, begin + len(found)))
        y.append(label)
        for k, a, b in candidates(text) if label else []:  # its parts, and other kinds at its place, are not what it is
            if a < begin + len(found) and begin < b and (k, a, b) != (kind, begin, begin + len(found)):
                x.append(features(text, k, a, b))
                y.append(0)

    for text in texts:
        base = base_spans(text)
        taken = {(k, a, b) for k in KINDS for a, b in base[k]}
        for kind, a, b in taken:
            positives += 1
            x.append(features(text, kind, a, b))
            y.append(1)
            for other in _rewritten(kind, text[a:b], draw) if contexts else []:
                insert(other, kind, 1)
        for kind, a, b in candidates(text):
            # what the base rules pass over is taken for clean; parts of a base span say nothing, as those stay whole anyway
            if not any(k == kind and p < b and a < q for k, p, q in taken):
                x.append(features(text, kind, a, b))
                y.append(0)
    if not positives or not contexts:
        return None
    for _ in range(max(400, 2 * positives)):
        kind, found = _negative(draw)
        insert(found, kind, 0)
    order = np.random.default_rng(seed).permutation(len(y))
    return fit(np.array(x)[order], np.array(y, np.float64)[order], precision)


def find(text: str | None, model: Boosted | None) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """The base spans, and all spans by kind and start."""
    if not text:
        return {k: [] for k in KINDS}, []
    base = base_spans(text)
    taken = [(k, a, b) for k in KINDS for a, b in base[k]]
    covered = bytearray(len(text))

    def cover(a: int, b: int) -> None:
        covered[a:b] = b"\1" * (b - a)

    for _, a, b in taken:
        cover(a, b)
    proposed = [c for c in candidates(text) if covered.find(1, c[1], c[2]) < 0] if model else []
    if proposed:
        x = np.concatenate([
            np.array([features(text[max(0, a - 60) : b + 60], k, a - max(0, a - 60), b - max(0, a - 60)) for k, a, b in proposed[i : i + 10_000]])
            for i in range(0, len(proposed), 10_000)
        ])
        score = model.score(x)
        keep = score >= model.select[x[:, 0].astype(np.int64)]
        for i in np.argsort(-score, kind="stable").tolist():
            k, a, b = proposed[i]
            if keep[i] and covered.find(1, a, b) < 0:
                taken.append((k, a, b))
                cover(a, b)
    return base, sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fit_on(docs: DataFrame, sample_documents: int = 3000, precision: float = 0.99, text_column: str = "text") -> Boosted | None:
    """Trees fitted on at most 2 * `sample_documents` texts, chosen by a hash of the text (about `sample_documents` of them)."""
    n = docs.count()
    every = max(1, n // sample_documents)
    chosen = docs.select(F.col(text_column).alias("t")).where(F.col("t").isNotNull() & (F.pmod(F.xxhash64("t"), F.lit(every)) == 0)).distinct().limit(2 * sample_documents)
    parts = chosen.mapInArrow(_around, "t string")
    return learn(sorted(r["t"] for r in parts.toLocalIterator()), precision)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For fitting, the neighbourhood of each candidate stands for its text, so that little reaches the driver."""
    for batch in slices(batches, 0):
        out = []
        for text in batch.column(0).to_pylist():
            last = -1
            for _, a, b in sorted(candidates(text), key=lambda c: c[1])[:200]:
                if a > last:
                    out.append(text[max(0, a - 80) : b + 80])
                    last = b + 80
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["t"])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Boosted | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of base spans, the base spans and all spans (kind:start:end in code points, end exclusive) of every row."""

    def work(texts: list) -> list[pa.Array]:
        found = [find(t, model) for t in texts]
        counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
        base = [listed([(k, p, q) for k in KINDS for p, q in b[k]]) for b, _ in found]
        return [*counts, pa.array(base, pa.string()), pa.array([listed(s) for _, s in found], pa.string())]

    return map_texts(docs, [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")], work, SCHEMA)


def redact(docs: DataFrame, model: Boosted | None, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, with each span replaced by its kind in brackets; n_chars, if there, follows."""
    at = docs.columns.index(text_column)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def without(text: str | None) -> str | None:
        _, spans = find(text, model)
        if not spans:
            return text
        out, done = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
            if a >= done:
                out += [text[done:a], f"[{k}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = [without(t) for t in batch.column(at).to_pylist()]
            cols = batch.columns
            cols[at] = pa.array(texts, cols[at].type)
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
