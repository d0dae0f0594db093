"""Merkle fingerprints against a plain version of the same tree, and the places of edits."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer.llm import fingerprints
from assayer.llm.oracles import ORACLES

SCHEMA = "doc_id long, text string, print string, before string, start string, key_id string, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_pieces(text):
    return re.findall(fingerprints.PIECE, text)


def plain_print(text):
    body, short = "", ""
    for piece in plain_pieces(text):
        digest = sha(piece)
        ends = piece.endswith("\n") or digest[0] == "0"
        mark = (";" if digest[1] in "0123" else ",") if ends else ""
        body, short = body + digest + mark, short + digest[:8] + mark
    sections = [s for s in body.split(";") if s]
    root = sha(";".join(sha(",".join(sha(p) for p in s.split(",") if p)) for s in sections))
    return f"{root}:{short}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (Counter(sha(p)[:8] for p in plain_pieces(t)) for t in (a, b))
    total = x.total() + y.total()
    return min(2 * (x & y).total() / total, 1 - 1 / total)


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdensty") for _ in range(rng.randint(1, 9)))
    out = [None, "", "a", "é ü\nx", "x" * 1000, " ", "\n\n\n", "a\n" * 40, "ab. " * 50]
    for n in (3, 40, 300, 300, 6000):
        out.append(" ".join(word() + rng.choice(["", "", ".", "\n"]) for _ in range(n)))
    return out + [out[-2], "b. a. ", "a. b. "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c", "c", "c", "c", "c") for i, t in enumerate(texts())]
    # a repeated row, an id with two texts, a missing id
    rows += [rows[10], (12, "another text of twelve", "c", "c", "c", "c", "c"), (None, "no id", "c", "c", "c", "c", "c")]
    return spark.createDataFrame(rows, SCHEMA)


def test_fingerprints_match_the_plain_tree(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in rows})
    following = {(k[1] if k[0] else None, k[3]): order[(i + 1) % len(order)][3] for i, k in enumerate(order)}
    want = []
    for r in rows:
        own, then = r.text, following[r.doc_id, r.text]
        k = len(own) // 4
        edited = own[: len(own) - k] + then[:k]
        want.append((r.doc_id, len(own), sha(edited), plain_print(own), plain_print(edited), plain_likeness(own, edited), plain_likeness(own, then)))
    got = [tuple(r)[:7] for r in fingerprints.edited_fingerprints(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_difference_places_the_edit(spark):
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abdensty") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "\n"]) for _ in range(800))
    pairs = [(base, base), (base, ""), ("", base), (base, base[:2000] + "an insertion" + base[2000:]), (base, base[:500] + base[900:]), (base, base[1:])]
    pairs += [(base, base[:1500] + "Q" + base[1501:]), (base, base + " more"), ("a. b. ", "b. a. ")]
    for _ in range(30):
        i, j = sorted(rng.sample(range(len(base)), 2))
        pairs.append((base, base[:i] + "new words here. " * rng.randint(0, 3) + base[j:]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = df.withColumn("d", fingerprints.difference(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))))
    for r in found.select("*", fingerprints.edit_place(F.col("a"), F.col("d")).alias("p"), fingerprints.likeness(F.col("d")).alias("l")).collect():
        x, y = plain_pieces(r.a), plain_pieces(r.b)
        lead = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        rest = min(len(x), len(y)) - lead
        tail = next((k for k in range(rest) if x[-1 - k] != y[-1 - k]), rest)
        assert (r.p.start, r.p.end) == (len("".join(x[:lead])), len("".join(x[: len(x) - tail])))
        assert r.a[: r.p.start] == r.b[: r.p.start] and r.b.endswith(r.a[r.p.end :])
        assert r.l == pytest.approx(plain_likeness(r.a, r.b)) and (r.l == 1.0) == (r.a == r.b)
        assert r.d.n_a == len(x) and r.d.n_b == len(y)
    # one letter changed costs few pieces, wherever it is
    assert plain_likeness(*pairs[6]) > 0.98 and plain_likeness(*pairs[5]) > 0.98


def test_pieces_join_to_the_text(spark):
    df = spark.createDataFrame([(t or "",) for t in texts()], "t string").select("t", fingerprints.pieces(F.col("t")).alias("p"))
    assert all("".join(r.p) == r.t and all(0 < len(x) <= 64 for x in r.p) for r in df.collect())


def test_sql_and_small_tables(spark, docs):
    # ids without two texts, which SQL orders otherwise
    plain = docs.where("doc_id <> 12 OR doc_id IS NULL").distinct()
    con = duckdb.connect()
    con.register("documents", plain.toArrow())
    columns = "doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_start, edit_end".split(", ")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op11_fingerprints']})").fetchall()
    got = [tuple(r) for r in fingerprints.edited_fingerprints(plain).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fingerprints.edited_fingerprints(docs.where("false")).count() == 0
    one = fingerprints.edited_fingerprints(docs.where("doc_id = 11")).collect()
    assert [r.near_next for r in one] == [1.0]
