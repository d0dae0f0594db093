import random

import pytest

from assayer.operators import leak


def _norm(value):
    return " ".join(value.strip().strip(";").lower().split())


@pytest.mark.parametrize("limit", [10**9, 0])
def test_corpus_leaks_match_brute_force(spark, limit):
    rng = random.Random(3)
    words = ["select", "from", "a", "of", "the", "customer_table_name", "join", "x1", "where", "supercalifragilistic", "or"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [(i, sentence(rng.randint(3, 12))) for i in range(40)]
    passages += [(100, "x" * 45), (101, "averyveryverylongleadingword andanotherverylongone"), (102, "short")]
    texts = []
    for i in range(120):
        body = sentence(rng.randint(5, 60))
        if i % 3 == 0:
            # whole, glued to neighbours so that its outer words are parts of longer ones
            body += " pre" + rng.choice(passages)[1] + "post " + sentence(3)
        texts.append((i, body.upper() if i % 2 else body))
    # one hot passage in a third of the texts
    texts += [(1000 + i, "zz" + "x" * 45 + "zz " + passages[0][1]) for i in range(60)]
    want = {
        (t, p) for t, text in texts for p, passage in passages if len(_norm(passage)) >= 40 and _norm(passage) in _norm(text)
    }
    got = leak.corpus_leaks(
        spark.createDataFrame(texts, "text_id bigint, text string"),
        spark.createDataFrame(passages, "passage_id bigint, passage string"),
        broadcast_chars=limit,
    ).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 60


def test_filter_passes_every_wanted_key(spark):
    keyed = spark.range(10_000).selectExpr("id AS text_id", "xxhash64(id % 5000) AS key")
    wanted = spark.range(40).selectExpr("xxhash64(id * 100) AS key")
    exact = keyed.join(wanted, "key", "left_semi").count()
    assert exact == 80
    for places, most in ((1 << 22, 90), (1, 10_000)):
        passed = leak.filtered_keys(keyed, wanted, places)
        assert passed.columns == keyed.columns and exact <= passed.count() <= most
        assert passed.join(wanted, "key", "left_semi").count() == exact
    assert leak.filtered_keys(keyed, wanted.where("false")).count() == 0
