"""Each stage of the corpus pipeline, and the chain, against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from assayer.llm import line_dedup
from assayer.llm.tokens import encode_all

WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    base = [f"b{i}" for i in range(100)]
    lines = ["\n".join(f"l{k}x{i} a b c" for i in range(6)) for k in range(3)]
    texts = [None, "", " \n ", "one two", "one two", "one two three four five", "One two three four five", " ".join(base), " ".join([*base[:50], "x", *base[50:]])]
    texts += [" ".join(base[:50] + base[80:]), lines[0], "head\n" + lines[0] + "\ntail", lines[1] + "\n" + lines[0], "own\n" + lines[2], "é ü " * 40]
    texts += [" ".join(f"w{i % 503}y{i}" for i in range(5000))] + [f"text number {i} of many" * (1 + i % 5) for i in range(30)]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_stages_keep_the_columns_and_empty_tables(spark, docs):
    for name, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, docs, "").schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.where("false"), "").count() == 0, name


def test_line_stage(spark, docs):
    seen, want = set(), {}
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        n, out = [len(re.findall(WORDS, x)) for x in lines], set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n[a : b + 1]) >= line_dedup.MIN_WORDS and (b > a or n[a] >= line_dedup.LONG_LINE):
                    key = tuple(lines[a : b + 1])
                    out |= set(range(a, b + 1)) if key in seen else set()
                    seen.add(key)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in out) if out else t
    got = pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text or "") for r in got)


def _sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    return out


def _kept(texts):
    sets = _sets(texts)
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i for i in root if root[i] == i}


def test_near_duplicate_stage(spark, docs):
    got = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = _kept({i: t for i, t, *_ in rows()})
    assert sorted(got) == sorted(want) and len(want) < len(rows()) and {0, 1, 2} <= want


def test_mixing_stage(spark, docs):
    got = Counter(r.doc_id for r in pipeline.mix_sources(spark, docs, "").collect())
    size = {i: len(re.findall(WORDS, t or "")) for i, t, *_ in rows()}
    by = defaultdict(list)
    for i, _, _, source, _ in rows():
        by[source].append(i)
    assert max(got.values()) <= 2
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    words = {s: sum(size[i] for i in v) for s, v in by.items()}
    # the excess over twice a source's words goes to the others by weight until none is above
    fixed, rest = {}, 1.5 * sum(words.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (rest - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 2 * words[s]]
        if not above:
            break
        fixed |= {s: 2 * words[s] for s in above}
    target = fixed | {s: level * weight[s] for s in free}
    for s, v in by.items():
        # each document is taken as often as its source expects, rounded up or down
        rate = target[s] / words[s]
        assert all(abs(got[i] - rate) < 1 for i in v), s
        assert abs(sum(got[i] for i in v) - rate * len(v)) <= 1 + 1e-9, s


def test_packing_stage(spark, docs):
    got = pipeline.pack_sequences(spark, docs, "").collect()
    n = Counter()
    sequences = defaultdict(list)
    for r in got:
        n[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert n == {i: len(x) for (i, *_), x in zip(rows(), encode_all("word_bpe_49k.json", [r[1] for r in rows()]), strict=True)}
    for parts in sequences.values():
        ends = [0, *(o + k for o, k in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_run_drops_toxic_rows_and_copies(spark, tmp_path):
    given = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{given}/documents.parquet").where("doc_id < 400").select(*pipeline.COLUMNS)
    planted = [(10**6 + i, t, "en", "s", len(t or "")) for i, t in enumerate([None, "", "kept words of the very first copy", "kept words of the very first copy"])]
    real.union(spark.createDataFrame(planted, real.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{given}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    all_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.drop_toxic(spark, all_docs, str(tmp_path))
    toxic = labels.where("toxic = 1").join(real, "doc_id", "left_semi").select("doc_id").distinct()
    n_toxic, n_left = toxic.count(), toxic.join(kept, "doc_id", "left_semi").count()
    assert n_toxic > 0 and n_left <= 0.1 * n_toxic
    clean = labels.where("toxic = 0").join(real, "doc_id", "left_semi").select("doc_id").distinct()
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert kept.where("doc_id >= 1000000").count() == 4
    got = pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids <= {r.doc_id for r in kept.collect()} and 10**6 + 3 not in ids
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end OR n > 2048").count() == 0
