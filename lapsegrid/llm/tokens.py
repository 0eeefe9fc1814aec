"""Ids of whole texts by the tokenizers library, through a memo of pieces.

A text is cut where no token of the vocabulary's pre-tokenizer crosses, so the ids of a text are those of its pieces
in turn. Each distinct piece goes to the library once; a bounded memo in the worker keeps the result. A text that
holds the string of an added token, in any case, goes to the library whole, which gives that token's own id.
"""

from __future__ import annotations

import os
import re

import numpy as np

from lapsegrid.llm.common import tokenizer_path

#: White space as the vocabularies' patterns see it: Unicode's, without the four separators 1C to 1F that Python adds.
_SPACE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CUTS = {
    # byte-level: a word takes one space before it; a run of white space keeps its last space for the next word
    "byte_bpe_50k.json": re.compile(rf" ?{_OTHER}+|{_SPACE}+(?!{_OTHER})|{_SPACE}+"),
    # white space is dropped
    "word_bpe_49k.json": re.compile(rf"{_OTHER}+"),
}
#: Pieces that a worker remembers, at most; some 200 bytes each.
MEMO = 1_200_000
#: New pieces that go to the library as one text.
TOGETHER = 100
_coders: dict[str, Coder] = {}


class Coder:
    def __init__(self, name: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.I).search
        # what each of them begins with up to its first letter is looked for before the pattern runs
        self.begins = {re.match("[^A-Za-z]*", t)[0] for t in added}
        self.pieces = CUTS[name].findall
        self.memo: dict[str, bytes] = {}
        # Pieces share a call where the ids show the borders: by an id of its own between them, or by ids that end a word.
        ends = [i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[ends] = True
        self.between = "" if ends else "\n"
        if self.between:
            (mark,) = self._ids([self.between])[0]
            self.ends[mark] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Asks the library for new pieces: those of one word many at a time, others one by one."""
        if self.between:
            alone = {p for p in fresh if p.isspace() or self.between in p}
        else:
            alone = {p for p in fresh if not (p.isalpha() and p.lower().isalpha())}
        many = [p for p in fresh if p not in alone]
        groups = [many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)]
        for group, ids in zip(groups, self._ids([(self.between or " ").join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.ends[ids])
            if self.between:
                cuts, skip = [*at.tolist(), len(ids)], 1
            else:
                cuts, skip = (at + 1).tolist(), 0
            if len(cuts) != len(group):  # a word came apart; ask for each
                alone.update(group)
                continue
            begin, raw = 0, ids.tobytes()
            for piece, cut in zip(group, cuts, strict=True):
                self.memo[piece] = raw[4 * begin : 4 * cut]
                begin = cut + skip
        rest = list(alone)
        for piece, ids in zip(rest, self._ids(rest), strict=True):
            self.memo[piece] = ids.tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text (None: empty) as little-endian unsigned 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if t and any(b in t for b in self.begins) and self.added(t)]
        if whole:
            rest = list(texts)
            for i in whole:
                rest[i] = None
            out = self.encode(rest)
            for i in whole:  # one at a time, as such a text may be long
                out[i] = self._ids([texts[i]])[0].tobytes()
            return out
        cut = [self.pieces(t) if t else [] for t in texts]
        memo = self.memo
        new = set().union(*cut).difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*cut)
        self._learn(list(new))
        return [b"".join(map(memo.__getitem__, c)) for c in cut]


def coder(name: str) -> Coder:
    """The worker's coder for one vocabulary file."""
    if name not in _coders:
        _coders[name] = Coder(name)
    return _coders[name]
