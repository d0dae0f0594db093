"""Removal of repeated passages by content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SEPARATORS, WORD, materialize, meet

#: A line of so many words counts as a passage of its own.
LONG_LINE = 25
#: Fewest words of a passage that is removed when it repeats.
MIN_WORDS = 10
PLACE = ["doc_id", "row", "place"]


def with_chunks(docs: DataFrame, long_line: int = LONG_LINE, min_words: int = MIN_WORDS) -> DataFrame:
    """Add ``_chunks``, an array of ``(place, anchor, hash)``, to ``docs(text, ...)``: the chunks around each boundary.

    Between each two adjacent lines stands a rolling hash: that of the line before, turned by one bit, XOR that of the
    line behind. A run of lines counts with at least ``min_words`` words in two lines and more, or in one of
    ``long_line`` words. In each shortest run that counts, from a line with words on or up to one, the place with the
    least rolling hash is a boundary (its anchor); a long line is its own. So boundaries are local minima, as dense as
    runs are short; each follows from the run's own lines, so a passage has the same ones wherever it stands; and every
    repeated run that counts holds one. The chunk is the run around its boundary.

    Of a longer run that counts, the shortest one from its first line and those that end behind cover every line with
    words, which extends a match line by line to both sides. Of a line without words, only one next to a single line
    belongs to a run that begins or ends with it. Places between two lines without words are never boundaries.
    ``place`` holds the first line in its upper and the last line in its lower 32 bits.
    """
    most = max(long_line, min_words)
    space, word = SEPARATORS.replace("]+", "]*+"), WORD.replace("]+", "]++")
    # counts end where more words make no difference
    n_words = lambda x: F.when(x.rlike(rf"\A{space}(?:{word}{space}){{{most}}}"), most).otherwise(F.regexp_count(x, F.lit(WORD)))
    cut = docs.withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    cut = cut.withColumns({"_words": F.transform("_lines", n_words), "_hashes": F.transform("_lines", lambda x: F.xxhash64(x))})
    # no boundary is between lines without words: least values pass over nulls
    rolling = F.expr(
        "transform(_hashes, (h, i) -> CASE WHEN i + 1 < size(_hashes) AND (_words[i] > 0 OR _words[i + 1] > 0) "
        "THEN (shiftleft(h, 1) | shiftrightunsigned(h, 63)) ^ _hashes[i + 1] END)"
    )
    cut = cut.withColumn("_rolling", rolling)
    cut = cut.withColumn("_at", F.expr("filter(transform(_words, (w, i) -> CASE WHEN w > 0 THEN i END), i -> i IS NOT NULL)"))

    def ends(near: str, beside: str) -> str:
        # each line with words adds one at least
        return f"""transform(_at, (p, k) -> CASE
            WHEN _words[p] >= {most} THEN p
            WHEN _words[p] >= {min_words} THEN {beside}
            ELSE aggregate({near}, struct(_words[p] AS n, CAST(NULL AS int) AS e),
                (a, q) -> CASE WHEN a.n >= {min_words} THEN a ELSE struct(a.n + _words[q] AS n, q AS e) END,
                a -> CASE WHEN a.n >= {min_words} THEN a.e END) END)"""

    ahead = ends(f"slice(_at, k + 2, {min_words})", "CASE WHEN p + 1 < size(_words) THEN p + 1 END")
    behind = ends(f"reverse(slice(_at, greatest(k - {min_words}, 0) + 1, least(k, {min_words})))", "CASE WHEN p > 0 THEN p - 1 END")
    cut = cut.withColumns({"_ahead": F.expr(ahead), "_behind": F.expr(behind)})
    # both ends in one number: distinct numbers are found by hash
    both = F.expr(
        "filter(array_distinct(concat(transform(_at, (p, k) -> shiftleft(bigint(p), 32) + _ahead[k]), "
        "transform(_at, (p, k) -> shiftleft(bigint(_behind[k]), 32) + p))), w -> w IS NOT NULL)"
    )
    first, n_lines = "int(shiftright(w, 32))", "(int(w & 4294967295L) - int(shiftright(w, 32)) + 1)"
    anchor = f"CASE WHEN {n_lines} = 1 THEN _hashes[{first}] ELSE array_min(slice(_rolling, {first} + 1, {n_lines} - 1)) END"
    chunks = f"transform(_both, w -> struct(w AS place, {anchor} AS anchor, xxhash64(slice(_hashes, {first} + 1, {n_lines})) AS hash))"
    cut = cut.withColumn("_both", both).withColumn("_chunks", F.expr(chunks))
    return cut.drop("_lines", "_words", "_hashes", "_rolling", "_at", "_ahead", "_behind", "_both")


def remove_repeated(docs: DataFrame, long_line: int = LONG_LINE, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)``, with passages removed from ``text`` that stand elsewhere before.

    Every run of lines counts that has at least ``min_words`` words in two lines and more, or is one line of
    ``long_line`` words. Of equal runs the one with the smallest (doc_id, row, line) stays, where ``row`` is a hash of the
    text; every other is removed, with its line ends, if its bytes are equal to that one's. So the first of equal lines
    always stays, and a longer passage goes whole, from its first line with words to its last, whatever stands around
    it. ``removed_lines`` counts the lines taken out.

    Boundaries chosen by rolling hashes are counted first (see ``with_chunks``); only chunks around those that repeat go
    on. Of these, chunks with a hash that repeats get their text, and each meets the first of its kind alone, so a
    passage of a third of all documents is compared row by row, over many tasks.

    A null text stays null; a text whose lines all go is empty; equal rows have the same place and keep the same
    passages; rows with equal doc_id and other texts are told apart by their texts; rows with a null doc_id keep their
    text and remove nothing. An empty table gives no rows; an input column named ``removed_lines`` is replaced, all
    others come back as they are, whatever their names.
    """
    narrow = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    # a plain explode would add a filter on the size of the array, which works it out once more
    row = F.xxhash64("text").alias("row")
    each = with_chunks(narrow, long_line, min_words).select("doc_id", row, F.explode_outer("_chunks").alias("c"))
    chunks = materialize(each.where("c IS NOT NULL").select("doc_id", "row", "c.*"), "line-chunks")
    anchors = materialize(chunks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "line-anchors")
    held = materialize(meet(chunks, anchors, "anchor", PLACE, chunks.count()).drop("anchor"), "anchored-chunks")
    first_of = F.min(F.struct("doc_id", "row", "place")).alias("origin")
    origins = materialize(held.groupBy("hash").agg(F.count("*").alias("n"), first_of).where("n > 1"), "chunk-origins")
    n_held = held.count()
    placed = meet(held, origins, "hash", PLACE, n_held).withColumn("at_origin", F.expr("struct(doc_id, row, place) = origin")).drop("origin")
    # a document has a bounded number of lines
    asked = placed.groupBy("doc_id", "row").agg(F.collect_set(F.struct("place", "hash", "at_origin")).alias("_asked"))
    texts = narrow.withColumn("row", row).join(asked, ["doc_id", "row"]).withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = "array_join(slice(_lines, int(shiftright(w.place, 32)) + 1, int(w.place & 4294967295L) - int(shiftright(w.place, 32)) + 1), '\n')"
    asked_lines = F.expr(f"transform(_asked, w -> struct(w.place AS place, w.hash AS hash, w.at_origin AS at_origin, {lines} AS lines))")
    texts = texts.select("doc_id", "row", F.explode_outer(asked_lines).alias("w"))
    texts = materialize(texts.select("doc_id", "row", "w.*"), "chunk-texts")
    kept = texts.where("at_origin").groupBy("hash").agg(F.min("lines").alias("kept_lines")).join(origins.select("hash", "n"), "hash")
    gone = meet(texts.where("NOT at_origin"), kept, "hash", PLACE, n_held).where("lines = kept_lines")
    per_doc = gone.groupBy("doc_id", "row").agg(F.collect_set("place").alias("gone"))
    # the input's columns travel as one, so that none can clash
    whole = docs.drop("removed_lines").select(F.struct("*").alias("input"), "doc_id", "text", row)
    joined = whole.join(per_doc, ["doc_id", "row"], "left").withColumn("lines", F.split("text", "\n"))
    # the removed line numbers, each once, then the lines that are none of them
    joined = joined.withColumn("out", F.expr("array_distinct(flatten(transform(gone, g -> sequence(int(shiftright(g, 32)), int(g & 4294967295L)))))"))
    left = F.expr(
        "CASE WHEN gone IS NULL THEN text ELSE array_join(transform(array_except(sequence(0, size(lines) - 1), out), "
        "i -> lines[i]), '\n') END"
    )
    removed = F.when(F.col("out").isNull(), 0).otherwise(F.size("out")).cast("long")
    columns = docs.drop("removed_lines").columns
    return joined.select(*(left.alias(c) if c == "text" else F.col("input")[c].alias(c) for c in columns), removed.alias("removed_lines"))
