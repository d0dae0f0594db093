"""Merkle fingerprints of texts: pieces below paragraphs below sections below a root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import materialize

#: A piece ends behind a line end, or behind a blank after one of these characters, and has 64 characters at most.
#: What follows an edit is therefore cut as before, wherever the edit moved it to.
PIECE = r"(?s).{0,62}?(?:\n|[.,:;!?] )|.{1,64}"
#: Hex digits of a piece's digest that a fingerprint keeps.
LEAF = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    """The pieces of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _parts(branch: Column, mark: str) -> Column:
    return F.filter(F.split(branch, mark), lambda part: part != "")


def _mark(digest: Column) -> Column:
    """What stands behind a piece: the end of a section, of a paragraph, or nothing.

    A paragraph ends with its line, or at one piece in 16, so that texts without lines have branches too; one
    paragraph in four ends its section. The digest decides, so equal runs of pieces make equal branches.
    """
    ends = digest.endswith("+") | digest.startswith("0")
    return F.when(ends & digest.substr(2, 1).between("0", "3"), ";").when(ends, ",").otherwise("")


def _branches(text: Column) -> Column:
    digests = F.transform(pieces(text), lambda p: F.concat(F.sha2(p, 256), F.when(p.endswith("\n"), "+").otherwise("")))
    return F.array_join(F.transform(digests, lambda d: F.concat(d.substr(1, 64), _mark(d))), "")


def _root(branches: Column) -> Column:
    paragraphs = lambda section: F.transform(_parts(section, ","), lambda p: F.sha2(p, 256))
    sections = F.transform(_parts(branches, ";"), lambda s: F.sha2(F.array_join(paragraphs(s), ","), 256))
    return F.sha2(F.array_join(sections, ";"), 256)


def fingerprint(text: Column) -> Column:
    """``root:pieces``: the root digest, then the pieces' shortened digests, ``,`` behind paragraphs, ``;`` behind sections.

    The root is the SHA-256 of its sections' digests, a section's that of its paragraphs', a paragraph's that of its
    pieces', all at full length: equal texts, and they alone, have equal roots. A null text counts as empty.
    """
    short = lambda branches: F.regexp_replace(branches, rf"([0-9a-f]{{{LEAF}}})[0-9a-f]{{{64 - LEAF}}}", "$1")
    return _let(_branches(F.coalesce(text, F.lit(""))), lambda b: F.concat(_root(b), F.lit(":"), short(b)))


def _leaves(branch: Column) -> Column:
    return F.regexp_extract_all(branch, F.lit(rf"[0-9a-f]{{{LEAF}}}"), F.lit(0))


def _n_leaves(branch: Column) -> Column:
    return F.length(F.translate(branch, ",;", "")) / LEAF


def _equal_lead(a: Column, b: Column) -> Column:
    """How many entries two arrays start with in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return _let(same, lambda s: F.when(F.array_position(s, False) > 0, F.array_position(s, False) - 1).otherwise(F.size(s)).cast("int"))


def _tail(items: Column, n: Column) -> Column:
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def difference(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: ``(n_a, n_b, lead, trail, rest_a, rest_b)``.

    ``lead`` pieces at the start and ``trail`` pieces at the end are the same in both; ``rest_a`` and ``rest_b`` are the
    pieces between. Equal sections are passed over whole, then equal paragraphs of the first section that differs, then
    pieces; equal roots end it at once.
    """
    body = lambda f: F.substring_index(f, ":", -1)

    def descend(both: Column) -> Column:
        # both: sections of a and of b
        sections = _equal_lead(both["a"], both["b"])
        return _let(F.struct(sections.alias("n"), both.alias("of")), lambda x: F.struct(
            _n_leaves(F.array_join(F.slice(x["of"]["a"], 1, x["n"]), "")).cast("int").alias("before"),
            F.array_join(_tail(x["of"]["a"], x["n"]), ";").alias("a"),
            F.array_join(_tail(x["of"]["b"], x["n"]), ";").alias("b"),
        ))

    def paragraphs(left: Column) -> Column:
        # the first sections that differ, by paragraphs; what stands behind them stays as it is
        first = lambda side: _parts(F.substring_index(left[side], ";", 1), ",")
        return _let(F.struct(_equal_lead(first("a"), first("b")).alias("n")), lambda x: F.struct(
            (left["before"] + _n_leaves(F.array_join(F.slice(first("a"), 1, x["n"]), ""))).cast("int").alias("before"),
            _n_leaves(F.array_join(F.slice(first("a"), 1, x["n"]), "")).cast("int").alias("skip"),
            _leaves(left["a"]).alias("a"),
            _leaves(left["b"]).alias("b"),
        ))

    def by_piece(left: Column) -> Column:
        more = lambda x: _equal_lead(x["a"], x["b"])
        cut = F.struct(left["before"].alias("before"), _tail(left["a"], left["skip"]).alias("a"), _tail(left["b"], left["skip"]).alias("b"))
        return _let(cut, lambda x: _let(F.struct(more(x).alias("n")), lambda m: F.struct(
            (x["before"] + m["n"]).alias("lead"), _tail(x["a"], m["n"]).alias("a"), _tail(x["b"], m["n"]).alias("b"),
        )))

    def trail(left: Column) -> Column:
        back = F.struct(left["lead"].alias("lead"), F.reverse(left["a"]).alias("a"), F.reverse(left["b"]).alias("b"))
        return _let(back, lambda x: _let(F.struct(_equal_lead(x["a"], x["b"]).alias("n")), lambda m: F.struct(
            x["lead"].alias("lead"), m["n"].alias("trail"), _tail(x["a"], m["n"]).alias("rest_a"), _tail(x["b"], m["n"]).alias("rest_b"),
        )))

    split = F.struct(_parts(body(a), ";").alias("a"), _parts(body(b), ";").alias("b"))
    found = _let(_let(_let(_let(split, descend), paragraphs), by_piece), trail)
    none = F.array().cast("array<string>")
    n = lambda f: _n_leaves(body(f)).cast("int")
    equal = F.struct(n(a).alias("lead"), F.lit(0).alias("trail"), none.alias("rest_a"), none.alias("rest_b"))
    return _let(F.when(a == b, equal).otherwise(found), lambda x: F.struct(
        n(a).alias("n_a"), n(b).alias("n_b"), *[x[c].alias(c) for c in ("lead", "trail", "rest_a", "rest_b")]
    ))


def _numbered(leaves: Column) -> Column:
    """Equal entries told apart by a number, so that sets of them count repeats."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(leaves), ""), F.lit(rf"([0-9a-f]{{{LEAF}}})\1*"), F.lit(0))
    times = lambda run: F.sequence(F.lit(1), (F.length(run) / LEAF).cast("int"))
    each = lambda run: F.transform(times(run), lambda i: F.concat(F.left(run, F.lit(LEAF)), i.cast("string")))
    single = lambda run: F.length(run) == LEAF
    repeated = F.flatten(F.transform(F.filter(runs, lambda run: ~single(run)), each))
    return F.concat(F.transform(F.filter(runs, single), lambda run: F.concat(run, F.lit("1"))), repeated)


def likeness(found: Column) -> Column:
    """Share of pieces that two texts have in common (Dice), from ``difference`` of their fingerprints.

    Pieces of the differing branches are matched wherever they stand, each as often as it occurs on both sides. Only
    equal texts reach 1: pieces in another order count half a piece less. Two empty texts are equal.
    """
    shared = F.size(F.array_intersect(_numbered(found["rest_a"]), _numbered(found["rest_b"])))
    total = found["n_a"] + found["n_b"]
    equal = (F.size(found["rest_a"]) == 0) & (F.size(found["rest_b"]) == 0)
    part = 2 * (found["lead"] + found["trail"] + shared) / total
    return F.when(equal, F.lit(1.0)).otherwise(F.least(part, 1 - 1 / total))


def _chars(items: Column) -> Column:
    return F.coalesce(F.length(F.array_join(items, "")), F.lit(0)).cast("long")


def edit_place(text: Column, found: Column) -> Column:
    """``(start, end)`` in code points of what differs in the first text, to whole pieces; start = end where nothing does."""
    return _let(pieces(text), lambda p: F.struct(
        _chars(F.slice(p, 1, found["lead"])).alias("start"),
        _chars(F.slice(p, 1, F.size(p) - found["trail"])).alias("end"),
    ))


#: What tells documents apart and orders them: whether there is an id, the id, a hash of the text.
KEY = ["named", "id", "print"]


def _before(keys: DataFrame) -> DataFrame:
    """Each of the distinct keys with the key and size ``n`` before it, ascending; the first follows the last.

    Narrow rows are sorted by ranges; the last key of each range, one row a range, leads over to the next range.
    """
    ranged = materialize(keys.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "order")
    key = F.struct(*KEY, "n")
    tails = ranged.groupBy("range").agg(F.max(key).alias("tail"))
    over = Window.orderBy("range")
    tails = tails.select("range", F.coalesce(F.lag("tail").over(over), F.max("tail").over(Window.partitionBy())).alias("tail"))
    inside = ranged.withColumn("before", F.lag(key).over(Window.partitionBy("range").orderBy(*KEY)))
    return inside.join(tails, "range").select(*KEY, F.coalesce("before", "tail").alias("before"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts; other columns are left out.

    The edited text ends with the start of the next document's in place of its own last quarter, rounded down. Next is
    the next ``doc_id``; documents with equal ids are ordered by a hash of their text, and rows equal in both are one
    document, so each of them has the same result. A null id comes first, a null text is empty; a single document is its
    own next. ``edit_start`` and ``edit_end`` place the edit in the document's own text. An empty table gives no rows.

    Texts are shuffled once, by document: the next document sends its start and its fingerprint to the one before it.
    """
    # a null id is a number of its own kind, so that plain keys join and group alike
    texts = docs.select(
        F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("print", F.xxhash64("text"))
    keys = texts.groupBy(KEY).agg(F.max(F.length("text")).alias("n"))
    before = _before(materialize(keys, "keys"))
    sent = texts.join(before, KEY).select(
        *[F.col(f"before.{name}").alias(name) for name in KEY],
        F.left("text", F.floor(F.col("before.n") / 4).cast("int")).alias("start"),
        fingerprint(F.col("text")).alias("next_fingerprint"),
    )
    # rows of one document send the same
    sent = sent.groupBy(KEY).agg(F.first("start").alias("start"), F.first("next_fingerprint").alias("next_fingerprint"))
    n = F.length("text")
    met = texts.join(sent, KEY).select(
        F.when(F.col("named"), F.col("id")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "text",
        F.concat(F.left("text", n - F.floor(n / 4).cast("int")), "start").alias("edited"),
        "next_fingerprint",
    )
    marked = met.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
        "text",
    )
    compared = marked.select(
        "*",
        difference(F.col("fingerprint"), F.col("edited_fingerprint")).alias("of_edited"),
        difference(F.col("fingerprint"), F.col("next_fingerprint")).alias("of_next"),
    )
    place = edit_place(F.col("text"), F.col("of_edited"))
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("of_edited")).alias("near_edited"),
        likeness(F.col("of_next")).alias("near_next"),
        place.alias("place"),
    ).select("*", F.col("place.start").alias("edit_start"), F.col("place.end").alias("edit_end")).drop("place")
