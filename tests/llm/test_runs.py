"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from assayer.llm import runs

WORD = r"[^\x20\x09-\x0D]+"


def brute_lyndon(word):
    out = []
    for i in range(len(word)):
        starts = [word[i:j] for j in range(i + 1, len(word) + 1)]
        out.append(max(len(x) for x in starts if all(x < x[k:] for k in range(1, len(x)))))
    return out


def brute_runs(word):
    found = set()
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(12, 2 * q):
                part = word[s:e]
                if next(r for r in range(1, q + 1) if part[r:] == part[: len(part) - r]) == q:
                    found.add((s, e - s, q))
            i = max(j, i + 1)
    return sorted(found)


def brute_row(doc_id, text):
    words = re.findall(WORD, text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)]
    if not found:
        return (doc_id, 0, None, None, None, None, *digests)
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
    return (doc_id, len(found), s, length, q, 1000 * length // q, *digests)


def test_lyndon_array():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.choice([1, 2, 2, 3, 5])
        word = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        assert runs.lyndon_array(word) == brute_lyndon(word)


def test_runs_of_many_texts():
    rng = random.Random(2)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 6)):
            k = rng.choice([1, 2, 2, 3, 50])
            word = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5 and len(word) > 4:
                p, a = rng.randint(1, len(word) // 2), rng.randrange(len(word))
                word = word[:a] + [word[a + i % p] if a + i % p < len(word) else 0 for i in range(len(word) - a)]
            words.append(word)
        at = np.cumsum([0, *map(len, words)])
        got = runs.find_runs(np.array(sum(words, []), np.int64), np.diff(at))
        assert [tuple(r) for r in got.tolist()] == sorted((at[i] + s, n, q) for i, w in enumerate(words) for s, n, q in brute_runs(w))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a " * 900, "x\x1fy\x85z " * 14, "é ü\n" * 7]
    texts += [" ".join(f"w{i}" for i in range(600)), ("one two three four five six\n" * 2 + "other words ") * 3]
    # fibonacci words hold many runs
    a, b = "a", "a b"
    while len(b) < 1000:
        a, b = b, f"{b} {a}"
    texts.append(b)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) for _ in range(120)]
    out = [(i, t, "c", 1) for i, t in enumerate(texts)]
    return out + [out[-1], (None, "a b " * 10, "c", 1)]


def test_documents_match_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int").repartition(3)
    got = [tuple(r) for r in runs.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(r[0], r[1]) for r in rows), key=repr)
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)
    assert runs.periodic_runs(docs.where("false")).collect() == []


def test_long_text():
    word = [i % 7919 for i in range(200_000)]
    assert runs.find_runs(np.array(word, np.int64), np.array([len(word)])).tolist() == [[0, 200_000, 7919]]
