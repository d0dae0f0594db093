"""Runs: stretches of words that repeat with a period, from Lyndon arrays under both orders."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.tokens import groups

#: Shortest run that counts, in words; a run has two periods at least besides.
MIN_WORDS = 12
#: A run of ``MIN_WORDS`` and two periods repeats so many words in a row one period further on.
GRAM = MIN_WORDS // 2

_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by phase one of Baier's suffix sorter.

    Suffixes are grouped by a common beginning, first by one letter. Groups are taken from the greatest down. Each place
    of a group points to the nearest place to its left that lies in a lower group; a place that ``k`` of the group point
    to goes on with ``k`` times the group's beginning, so it moves to a new group just above its old one. When a group
    is taken its beginning is the longest Lyndon word at each of its places.
    """
    n = len(word)
    members: dict[int, list[int]] = defaultdict(list)
    for i, letter in enumerate(word):
        members[letter].append(i)
    order = sorted(members)
    number = {letter: g for g, letter in enumerate(order)}
    group = [number[letter] for letter in word]
    places = [members[letter] for letter in order]
    length = [1] * len(order)
    # neighbours in the order of groups
    below, above = list(range(-1, len(order) - 1)), list(range(1, len(order) + 1))
    above[-1:] = [-1]
    top = len(order) - 1
    # nearest place to the left that is not taken yet; places are moved up by one, 0 stands for none
    left = list(range(n + 1))
    out = [0] * n
    g = top
    while g >= 0:
        taken = [i for i in places[g] if group[i] == g]
        places[g] = []
        size = length[g]
        for i in taken:
            out[i] = size
            left[i + 1] = i
        pointed: dict[int, int] = defaultdict(int)
        for i in taken:
            root = i + 1
            while left[root] != root:
                root = left[root]
            at = i + 1
            while left[at] != root and at != root:
                left[at], at = root, left[at]
            if root:
                pointed[root - 1] += 1
        if pointed:
            moved: dict[tuple[int, int], list[int]] = defaultdict(list)
            for j, k in pointed.items():
                moved[k, group[j]].append(j)
            for k, old in sorted(moved, reverse=True):
                new = len(places)
                places.append(moved[k, old])
                length.append(length[old] + k * size)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for j in moved[k, old]:
                    group[j] = new
        g = below[g]
    return out


class _Extensions:
    """Longest common extensions by names of blocks of 1, 2, 4, ... letters: equal blocks have equal names."""

    def __init__(self, letters: np.ndarray, longest: int):
        names = np.unique(letters, return_inverse=True)[1].astype(np.int64)
        self.levels = [names]
        size = 1
        while 2 * size <= longest:
            pairs = names[:-size] * (len(letters) + 1) + names[size:]
            names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            self.levels.append(names)
            size *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the text goes on alike from a and from b > a."""
        return self._extend(a, b, 1)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the text goes on alike to the left, before a and before b > a."""
        return self._extend(a, b, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            # twice: the greatest block may fit more than once, every smaller one at most once
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                x = a + far if way > 0 else a - far - size
                y = b + far if way > 0 else b - far - size
                fits = np.flatnonzero((x >= 0) & (y < len(names)))
                far[fits[names[x[fits]] == names[y[fits]]]] += size
        return far


def runs_of(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of stretches of a text as rows ``(start, length, period)``, each once.

    ``bounds`` holds the start and end of each stretch; runs do not cross them. A run's root is the longest Lyndon word
    at one of its places, under one order of letters or the other: each such word is extended to both sides as far as
    it goes on with its own length as period, and is a run if that makes two periods.
    """
    spans = [(int(s), int(e)) for s, e in bounds]
    if not spans:
        return np.zeros((0, 3), np.int64)
    # stretches one behind the other, letters of their own between them
    joined, origin, at, roots = [], [], 0, []
    for k, (s, e) in enumerate(spans):
        part = letters[s:e]
        ranks = np.unique(part, return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            roots.append((at + np.arange(e - s), np.array(lyndon_array(order.tolist()), np.int64)))
        joined += [part.astype(np.int64), np.array([-1 - k], np.int64)]
        origin.append(np.arange(s, e + 1))
        at += e - s + 1
    text, origin = np.concatenate(joined), np.concatenate(origin)
    start = np.concatenate([r[0] for r in roots])
    period = np.concatenate([r[1] for r in roots])
    start, period = np.unique(np.stack([start, period], 1), axis=0).T
    # without an equal letter on either side there is nothing to extend
    behind = np.minimum(start + period, len(text) - 1)
    before = np.maximum(start - 1, 0)
    near = (text[start] == text[behind]) | (start > 0) & (text[before] == text[behind - 1])
    start, period = start[near], period[near]
    common = _Extensions(text, max(e - s for s, e in spans))
    right = common.right(start, start + period)
    left = common.left(start, start + period)
    found = left + right >= period
    first = origin[(start - left)[found]]
    rows = np.stack([first, (left + right + period)[found], period[found]], 1)
    rows = rows[rows[:, 1] >= np.maximum(MIN_WORDS, 2 * rows[:, 2])]
    return np.unique(rows, axis=0)


def _repeating(letters: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Start and end of the stretches that may hold runs: those covered by ``GRAM`` letters that their owner has twice.

    A run of period q repeats each of its grams q places further on or back, but for fewer than ``GRAM`` in the middle,
    so grams that occur twice cover it without a gap. Stretches too short for a run are left out. ``owner`` numbers the
    texts, or the stretches found before.
    """
    n = len(letters) - GRAM + 1
    if n <= 0:
        return np.zeros((0, 2), np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ letters[k : k + n].astype(np.uint64)) * _MIX
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ owner[:n].astype(np.uint64)) * _MIX
    whole = owner[:n] == owner[GRAM - 1 :]
    at = np.flatnonzero(whole)
    at = at[np.argsort(mixed[at], kind="stable")]
    same = mixed[at][1:] == mixed[at][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    # covered by a gram that occurs twice; a stretch ends where its owner does
    change = np.zeros(len(letters) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + GRAM, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0) | np.diff(owner, prepend=-1, append=-1).astype(bool))
    starts, ends = edge[:-1], edge[1:]
    keep = covered[starts] & (ends - starts >= MIN_WORDS)
    return np.stack([starts[keep], ends[keep]], 1)


def find_runs(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of many texts that stand one behind the other: rows ``(start, length, period)``, sorted."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = _repeating(letters, owner)
    while len(at):
        # a stretch is looked at alone: what it has once is no part of a run
        length = at[:, 1] - at[:, 0]
        place = np.repeat(at[:, 0] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        inner = _repeating(letters[place], np.repeat(np.arange(len(at)), length))
        shrunk = (inner[:, 1] - inner[:, 0]).sum() < length.sum()
        at = np.stack([place[inner[:, 0]], place[inner[:, 1] - 1] + 1], 1) if len(inner) else inner
        if not shrunk:
            break
    return runs_of(letters, at)


def _altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by hash of its id, go on periodically from a place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _describe(ids: list, texts: list[str | None]) -> Iterator[tuple]:
    # bytes split at ASCII white space, which are the separators
    words = [_altered((t or "").encode().split(), i) for i, t in zip(ids, texts, strict=True)]
    sizes = np.array([len(w) for w in words], np.int64)
    number = _Numbers().__getitem__
    letters = np.fromiter((x for w in words for x in map(number, w)), np.int64, int(sizes.sum()))
    found = find_runs(letters, sizes)
    starts = np.cumsum(sizes) - sizes
    of = np.searchsorted(starts, found[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
    for k, (doc_id, w) in enumerate(zip(ids, words, strict=True)):
        mine = found[cuts[k] : cuts[k + 1]] - [starts[k], 0, 0]
        if not len(mine):
            yield doc_id, 0, None, None, None, None, _digest(b""), _digest(b" ".join(w))
            continue
        start, length, period = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, mine[:, 0] + mine[:, 2], 1)
        np.add.at(change, mine[:, 0] + mine[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
        collapsed = b" ".join([w[i] for i in kept])
        yield doc_id, len(mine), start, length, period, 1000 * length // period, _digest(listed.encode()), _digest(collapsed)


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.string() if "sha256" in name else pa.int64() for name in names]
    for batch in batches:
        ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
        for part in groups([t or "" for t in texts]):
            columns = zip(*_describe(ids[part], texts[part]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of words of ``docs(doc_id, text)``, one row per row; other columns are left out.

    A run is a stretch of words with smallest period q that is 12 words and two periods long at least and that no
    neighbouring word extends. Per document: their number, the longest (ties: first, then smallest period), digests of
    the list of all runs and of the text without the repeats, that is without the words behind a run's first q. Every
    tenth document, by the checksum of its id, is made periodic first; one without id never is. A null or empty text
    has no words and no runs; equal rows get equal results; an empty table gives no rows.

    Each document is worked on where its row is read, without a shuffle; a task holds the words of about a million
    characters, or of one longer document, at a time.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_batches, SCHEMA)
