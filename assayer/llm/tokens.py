"""Token ids of whole texts, by public tokenizers."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

#: Words kept per worker (about 200 bytes each). A full table keeps the words met again since the last time, half of it at
#: most, so common words stay known and memory is bounded whatever the corpus holds.
MEMO_WORDS = 700_000
#: The id that ends a document.
END_ID = 0


class _Numbered(dict):
    """Words by number; a new word gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes texts with a tokenizers file; equal words are encoded once.

    A text is cut at each space between two characters that are no white space. The rules of both tokenizer families
    never look across such a cut, nor across one between a letter and a full stop or comma, so the pieces' ids, in
    order, are the ids of the whole text. Texts where a cut would fall elsewhere (runs of spaces, blank lines) are
    encoded whole. ``glued``: spaces belong to the word behind them, as in byte-level vocabularies; otherwise white
    space is dropped.
    """

    def __init__(self, path: str, glued: bool, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # literal: names of special tokens in a text are then ordinary text
        self.tokenizer.encode_special_tokens = literal
        self.glued = glued
        self.between = "\n" if glued else " \x01 "
        ids = self.whole(self.between)
        assert len(ids) == 1, "the mark between words must be one id"
        self.mark = ids[0]
        self.stops = {c: self.whole(c) for c in ".,"}
        self.forget()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.memo = _Numbered()
        self.known = 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 17, np.int64)
        self.sizes = np.zeros(1 << 17, np.int64)
        # words met in a later group of texts than their first one
        self.again = np.zeros(1 << 17, bool)

    def _turn(self) -> None:
        """Keep the words met again, and forget all others."""
        keep = np.flatnonzero(self.again[: self.known])[: MEMO_WORDS // 2]
        names = list(self.memo)
        sizes, starts = self.sizes[keep], self.starts[keep]
        real = np.maximum(sizes, 0)
        ends = np.cumsum(real)
        ids = self.flat[np.repeat(starts - (ends - real), real) + np.arange(real.sum())]
        self.forget()
        self.memo.update((names[i], n) for n, i in enumerate(keep.tolist()))
        self._append(ids, sizes)

    def pieces(self, text: str) -> list[str]:
        if self.glued:  # the first word stands behind a line end of its own, which is dropped again
            return ("\n" + text).replace("\n", " \n")[1:].split(" ")
        return text.replace("\n", " ").split(" ")

    def _odd(self, word: str) -> bool:
        body = word[1:] if self.glued and word[:1] == "\n" else word
        return self.glued and (not body or body[0].isspace() or body[-1].isspace()) or "\x01" in body

    def _alone(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, all encoded in one text with marks between them: the ids, and each word's start and size in them."""
        starts, sizes = np.zeros(len(stems), np.int64), np.zeros(len(stems), np.int64)
        line = np.fromiter((self.glued and w[:1] == "\n" for w in stems), bool, len(stems))
        empty = np.fromiter((not w for w in stems), bool, len(stems))
        plain, lines = np.flatnonzero(~line & ~empty), np.flatnonzero(line)
        parts = [np.zeros(0, np.uint32)]
        if len(plain):
            lead = " " if self.glued else ""
            ids = np.array(self.whole(self.between.join([lead + stems[i] for i in plain.tolist()])), np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(plain) - 1
            edges = np.concatenate([[0], cuts + 1, [len(ids) + 1]])
            starts[plain], sizes[plain] = edges[:-1], np.diff(edges) - 1
            parts.append(ids)
        if len(lines):
            ids = np.array(self.whole("".join([stems[i] for i in lines.tolist()])), np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(lines)
            starts[lines], sizes[lines] = cuts + sum(map(len, parts)), np.diff(np.append(cuts, len(ids)))
            parts.append(ids)
        return np.concatenate(parts), starts, sizes

    def _learn(self) -> None:
        """Note the ids of all words met for the first time; a full stop or comma behind a letter has ids of its own."""
        new, self.memo.new = self.memo.new, []
        number, known, used = self.memo.get, self.known, self.used
        fresh: dict[str, int] = {}
        source, stop = [], []
        for w in new:
            cut = len(w) > 1 and w[-1] in self.stops and w[-2].isalpha()
            if self._odd(w):
                source.append(-1)
                stop.append("")
                continue
            stem = w[:-1] if cut else w
            i = number(stem, known)
            source.append(i if i < known and self.sizes[i] >= 0 else known + fresh.setdefault(stem, len(fresh)))
            stop.append(w[-1] if cut else "")
        ids, starts, sizes = self._alone(list(fresh))
        # a last entry stands for words that are encoded with their whole text
        starts = np.concatenate([self.starts[:known], used + starts, [0]])
        sizes = np.concatenate([self.sizes[:known], sizes, [0]])
        source = np.array(source, np.int64)
        start, size = starts[source], sizes[source]
        ends = {c: np.flatnonzero(np.array([x == c for x in stop], bool)) for c in self.stops}
        whole = size.copy()
        for c, at in ends.items():
            whole[at] += len(self.stops[c])
        after = np.cumsum(whole)
        into = np.zeros(int(after[-1]), np.uint32)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        into[np.repeat(after - whole, size) + within] = np.concatenate([self.flat[:used], ids])[np.repeat(start, size) + within]
        for c, at in ends.items():
            for k, i in enumerate(self.stops[c]):
                into[after[at] - len(self.stops[c]) + k] = i
        self._append(into, np.where(source < 0, -1, whole))

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = self.used + len(ids), self.known + len(sizes)
        while n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k > len(self.starts):
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.again))
        self.flat[self.used : n] = ids
        real = np.maximum(sizes, 0)
        self.sizes[self.known : k] = sizes
        self.starts[self.known : k] = self.used + np.cumsum(real) - real
        self.used, self.known = n, k

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text, without end ids."""
        if self.known > MEMO_WORDS:
            self._turn()
        split = [self.pieces(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(ps) for ps in split])]).astype(np.int64)
        find = self.memo.__getitem__
        at = np.fromiter(map(find, chain.from_iterable(split)), np.int64, int(bounds[-1]))
        known = self.known
        if self.memo.new:
            self._learn()
        self.again[at[at < known]] = True
        sizes = self.sizes[at]
        bad = sizes < 0
        spoilt = np.add.reduceat(bad, bounds[:-1]) > 0 if bad.any() else np.zeros(len(texts), bool)
        sizes = np.maximum(sizes, 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        edges = np.concatenate([[0], ends])[bounds]
        drop = int(self.glued)
        return [
            np.array(self.whole(t), np.uint32) if odd else ids[edges[i] + drop : edges[i + 1]]
            for i, (t, odd) in enumerate(zip(texts, spoilt, strict=True))
        ]


#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000


def groups(texts: list[str]):
    """Slices of a list of texts, each of about ``GROUP_CHARS`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, literal: bool = False) -> Encoder:
    """The worker's encoder for a public tokenizer's file, or for a file by its whole path; kept for later tasks."""
    if (key := (name, literal)) not in _ENCODERS:
        path = name if os.path.isabs(name) else vocabulary(name)
        with open(path, encoding="utf-8") as f:
            glued = json.load(f)["model"].get("end_of_word_suffix") is None
        _ENCODERS[key] = Encoder(path, glued, literal)
    return _ENCODERS[key]


def encode_all(name: str, texts: list[str | None], end: int = END_ID, literal: bool = False):
    """Ids of each text, in turn, with the end id behind them; a null text counts as empty."""
    full = [t or "" for t in texts]
    tail = np.array([end], np.uint32)
    for part in groups(full):
        for ids in encoder(name, literal).encode(full[part]):
            yield np.concatenate([ids, tail])


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine; each worker looks it up anew."""
    import public_tokenizers

    return public_tokenizers.path(name)
