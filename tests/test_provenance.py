import hashlib

from pyspark.sql import functions as F

from assayer.operators import prompts, provenance
from assayer.session import materialize


def test_long_keys_stream_to_the_same_digest(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).alias("pos"), F.concat(F.lit("é"), "id").alias("piece"))
    rows = rows.unionByName(spark.range(3).select(F.lit(7).cast("bigint").alias("run"), F.col("id").alias("pos"), F.col("id").cast("string").alias("piece")))
    want = {k: hashlib.sha256("\n".join(f"é{i}" for i in range(3000) if i % 2 == k).encode()).hexdigest() for k in (0, 1)}
    want[7] = hashlib.sha256(b"0\n1\n2").hexdigest()
    for short in (1, 1000):
        found = provenance.ordered_digest(rows, "run", "pos", "piece", "\n", per_chunk=16, short_chunks=short)
        assert {r["run"]: r["digest"] for r in found.collect()} == want


def test_chat_parts_join_to_the_whole(spark):
    chat = spark.range(700).select(F.lit("c").alias("chat_id"), F.col("id").alias("pos"), F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("content"))
    parts = prompts.chat_parts(chat)
    whole = "\n\n".join(f"USER:\nm{i}" for i in range(700))
    assert "\n\n".join(r["text"] for r in parts.orderBy("part").collect()) == whole
    assert [r["text"] for r in prompts.flatten_chats(chat).collect()] == [whole]
    assert provenance.chat_digest(parts).first()["digest"] == hashlib.sha256(whole.encode()).hexdigest()
    assert provenance.chat_sizes(parts).first()["prompt_chars"] == len(whole)


def test_strict_profile_adds_missing_messages(spark):
    rows = [("a", 0, "user", "hi  "), ("b", 0, "system", "sys"), ("b", 1, "assistant", "x"), ("c", 0, "user", "1"), ("c", 1, "user", None)]
    found = prompts.strict_messages(spark.createDataFrame(rows, "chat_id string, pos bigint, role string, content string"))
    by_chat = {}
    for r in found.orderBy("chat_id", "pos").collect():
        by_chat.setdefault(r["chat_id"], []).append((r["role"], (r["content"] or "")[:6]))
    assert [role for role, _ in by_chat["a"]] == ["system", "user"] and by_chat["a"][1][1].startswith("hi\n\n")
    assert [role for role, _ in by_chat["b"]] == ["system", "assistant", "user"] and by_chat["b"][0][1].startswith("sys\n\n")
    assert by_chat["c"][1] == ("user", "1")


def test_tree_digest_hashes_chunks_then_their_digests(spark):
    rows = spark.range(30).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).alias("pos"), F.concat(F.lit("é"), "id").alias("piece"))

    def hashed(pieces):
        return hashlib.sha256("\n".join(pieces).encode()).hexdigest()

    def tree(pieces):
        for _ in range(2):
            pieces = [hashed(pieces[i : i + 4]) for i in range(0, len(pieces), 4)]
        return hashed(pieces)

    want = {k: tree([f"é{i}" for i in range(30) if i % 2 == k]) for k in (0, 1)}
    for parts in (1, 7):
        found = provenance.tree_digest(rows.repartition(parts), "run", "pos", "piece", per_chunk=4)
        assert {r["run"]: r["digest"] for r in found.collect()} == want
    assert provenance.tree_digest(rows.limit(0), "run", "pos", "piece").count() == 0


def test_contexts_meet_chats_without_a_broadcast(spark):
    rows = [(f"c{i}", pos, role, f"{role} {i} ") for i in range(6) for pos, role in enumerate(["system", "user", "user"] if i % 2 else ["system"])]
    messages = spark.createDataFrame(rows, "chat_id string, pos int, role string, content string")
    given = [(f"c{i}", "" if i == 5 else f"context {i}") for i in (0, 1, 3, 5)] + [("nowhere", "lost"), (None, "lost")]
    contexts = spark.createDataFrame(given, "chat_id string, context string")
    found = prompts.with_tool_context(materialize(messages, "t"), materialize(contexts, "t"))
    # both sides look small by their files and grow with the chats
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["chat_id"], r["pos"]): (r["role"], r["content"]) for r in found.collect()}
    expected = {(chat, pos): (role, content) for chat, pos, role, content in rows}
    expected |= {("c0", 1): ("user", "context 0"), ("c1", 2): ("user", "user 1\n\ncontext 1"), ("c3", 2): ("user", "user 3\n\ncontext 3")}
    assert got == expected and found.count() == len(expected)
