"""Operator 7, SentencePiece byte-pair encoding by a merge-type prefix table, and decoding.

For each prefix of a text exactly one token can be the last of its encoding. An automaton over the vocabulary lists
the tokens that end at a place; the right one is compatible with the last token of the prefix that it leaves: merging
the two tokens' characters by score gives just these two tokens back. So one pass stores each prefix's last token, and
the ids are recovered backwards from the end. Pair tests undo the two tokens' merges from the latest on and ask
whether a merge across the border would have come first; their answers are kept.

Texts are cut where no token crosses: before the white-space marks that follow another character. Each distinct cut is
encoded once and remembered in a bounded memo. Runs of marks, whose tokens all have one score, merge from the left and
after everything else, and are handled apart. Characters outside the vocabulary become byte tokens.

Null and empty texts have no ids. Rows are encoded one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick

from lapsegrid.llm.common import tokenizer_path

MARK = "▁"
#: Cuts that a worker remembers, at most, some 250 bytes each; and answers of pair tests.
MEMO, PAIRS = 1_000_000, 1_600_000
UNKNOWN = -1
_models: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, name: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(tokenizer_path(name), "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only byte-pair models with byte fallback, identity normalisation and a dummy prefix are read")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        kinds = model.SentencePiece
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a white-space mark after another character")
        self.runs = {len(p): i for p, i in normal.items() if not p.strip(MARK)}
        self.ids = {p: i for p, i in normal.items() if p.strip(MARK) or p == MARK}
        order = sorted(self.ids, key=lambda p: -model.pieces[self.ids[p]].score)
        self.rank = {p: r for r, p in enumerate(order)}
        if len({model.pieces[self.ids[p]].score for p in order if len(p) > 1}) != sum(len(p) > 1 for p in order):
            raise ValueError("two pieces have one score")
        self.parts: dict[str, tuple[str, str]] = {}
        self.words = ahocorasick.Automaton()
        for p in sorted(self.ids, key=len):
            split = self._split(p) if len(p) > 1 else None
            if split:
                self.parts[p] = split
            if split or len(p) == 1:
                self.words.add_word(p, p)
        self.words.make_automaton()
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        border = "" if "\n" in inside else "\\n"
        self.cuts: Callable = re.compile(rf"{MARK}+[^{MARK}{border}]*|[^{MARK}{border}]+" + (rf"|{border}" if border else "")).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge, or None if merging its characters by score ends elsewhere."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 2**31), i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1])

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of left + right by score gives these two tokens."""
        key = (left, right)
        if key in self.pairs:
            return self.pairs[key]
        rank, parts, never = self.rank, self.parts, 2**31
        before_left = before_right = never  # when the merges come that use up the tokens at the border
        answer = True
        while True:
            across = rank.get(left + right, never)
            # of equal ranks the leftmost merges first: a merge inside the left token wins, one inside the right loses
            if across < before_left and across <= before_right and across != never:
                answer = False
                break
            at_left = rank[left] if left in parts else -1
            at_right = rank[right] if right in parts else -1
            if at_left < 0 and at_right < 0:
                break
            if at_left >= at_right:
                before_left, left = at_left, parts[left][1]
            else:
                before_right, right = at_right, parts[right][0]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def _word(self, text: str) -> list[str | int]:
        """Tokens of a cut with at most one mark in front; characters outside the vocabulary come as themselves with UNKNOWN before them."""
        n = len(text)
        last: list = [None] * (n + 1)  # the last token of each prefix; UNKNOWN for a foreign character
        compatible, done = self.compatible, 0
        for end, piece in self.words.iter(text):
            end += 1
            while done < end - 1:  # no token ends there: foreign
                done += 1
                if last[done] is None:
                    last[done] = UNKNOWN
            if last[end] is not None:
                continue
            begin = end - len(piece)
            if begin == 0:
                last[end] = piece
            else:
                prior = last[begin]
                if prior is UNKNOWN or prior is not None and compatible(prior, piece):
                    last[end] = piece
        for i in range(done + 1, n + 1):
            if last[i] is None:
                last[i] = UNKNOWN
        out: list = []
        at = n
        while at:
            piece = last[at]
            if piece is UNKNOWN:
                out.append((text[at - 1],))
                at -= 1
            else:
                out.append(piece)
                at -= len(piece)
        return out[::-1]

    @lru_cache(maxsize=4096)  # noqa: B019  one model per worker
    def _marks(self, n: int) -> list[int]:
        """Ids of a run of marks: equal scores merge from the left, as long as a token of that length exists."""
        settled: list[int] = []  # lengths of tokens, no two neighbours of which merge
        left = n
        while left:
            token, left = 1, left - 1
            while True:
                if settled and settled[-1] + token in self.runs:
                    token += settled.pop()
                elif left and token + 1 in self.runs:
                    token, left = token + 1, left - 1
                else:
                    break
            settled.append(token)
        return [self.runs[t] for t in settled]

    def _cut(self, cut: str) -> list[int]:
        body = cut.lstrip(MARK)
        marks = len(cut) - len(body)
        tokens = self._word(MARK * (marks > 0) + body) if body else []
        if body and marks and tokens[0] != MARK:
            marks -= 1
        elif body and marks:
            tokens = tokens[1:]
        out = list(self._marks(marks)) if marks else []
        for t in tokens:
            out += [self.byte[b] for b in t[0].encode()] if isinstance(t, tuple) else [self.ids[t]]
        return out

    def encode(self, texts: list) -> list[list[int]]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for t in texts:
            ids: list[int] = []
            if t:
                for cut in self.cuts(MARK + t.replace(" ", MARK)):
                    found = memo.get(cut)
                    if found is None:
                        found = tuple(self._cut(cut))
                        if len(cut) < 200:
                            memo[cut] = found
                    ids += found
            out.append(ids)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


def pieces(name: str) -> Pieces:
    """The worker's model for one vocabulary file."""
    if name not in _models:
        _models[name] = Pieces(name)
    return _models[name]
