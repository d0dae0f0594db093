"""Text features of questions and model outputs."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.rules import vocab
from assayer.rules.scanning import EDGE, SPACE

PLURAL_KEY_CHARS = 24


def text_array(values: list[str]) -> Column:
    """A literal string array (also when empty)."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_map(mapping: dict[str, list[str]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), text_array(v)) for k, v in mapping.items()))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row.

    Inside a lambda an outer expression would be worked out again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# fixed value: every white-space character
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends; looks at the ends only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def normalize(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def phrase(name: Column) -> Column:
    """An identifier as words."""
    return normalize(F.replace(name, F.lit("_"), F.lit(" ")))


def words(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def _singulars(found: Column) -> Column:
    plural = F.filter(found, lambda w: w.endswith("s") & (F.length(w) > 3))
    return F.transform(plural, lambda w: w.substr(F.lit(1), F.length(w) - 1))


def _looked_up(found: Column, mapping: dict[str, list[str]]) -> Column:
    table = word_map(mapping)
    return F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(table, w), text_array([]))))


def tokens(text: Column, *, keep_stopwords: bool = False, expand: bool = False) -> Column:
    """Distinct words of two characters or more, with singulars and spelled-out abbreviations.

    ``expand`` adds synonyms too. Additions come from the words of the text only, never from other additions.
    """
    found = F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 1))
    if not keep_stopwords:
        found = F.array_except(found, text_array(vocab.STOPWORDS))

    def widened(base: Column) -> Column:
        parts = [base, _singulars(base), _looked_up(base, vocab.ABBREVIATIONS)]
        if expand:
            parts.append(_looked_up(base, vocab.SYNONYMS))
        return F.array_distinct(F.concat(*parts))

    return bound(found, widened)


def ngrams(text: Column, max_n: int = 4) -> Column:
    """Distinct runs of 1 to ``max_n`` words, without those made of stop-words only."""
    stop = text_array(vocab.STOPWORDS)

    def runs(found: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (size - 1))
        run = F.transform(starts, lambda start: F.slice(found, start, F.lit(size)))
        kept = F.filter(run, lambda r: F.exists(r, lambda w: ~F.array_contains(stop, w)))
        joined = F.transform(kept, lambda r: F.array_join(r, " "))
        return F.when(F.size(found) >= size, joined).otherwise(text_array([]))

    return bound(
        words(text), lambda found: F.array_distinct(F.concat(*[runs(found, size) for size in range(1, max_n + 1)]))
    )


def plural_keys(text: Column, shortest: int = 1, longest: int = PLURAL_KEY_CHARS) -> Column:
    """Join keys for 'does this text contain <phrase>s or <phrase>es anywhere'.

    Every piece that ends in an ``s``, up to ``PLURAL_KEY_CHARS`` long. A phrase's plural occurs in the text
    exactly if its own last characters (see ``plural_key``) are among them and the text contains it as a whole,
    so the containment test becomes an equi-join plus a check of the joined pairs. Pieces shorter or longer than any key
    at hand may be left out.
    """

    def pieces(body: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.length(body)), lambda at: (at >= shortest) & (body.substr(at, F.lit(1)) == F.lit("s")))
        ending = F.transform(
            ends,
            lambda at: F.transform(
                F.sequence(F.lit(shortest), F.least(F.lit(longest), at)),
                lambda size: body.substr(at - size + 1, size),
            ),
        )
        return F.when(F.length(body) > 0, F.array_distinct(F.flatten(ending))).otherwise(text_array([]))

    return bound(normalize(text), pieces)


def plural_key(plural: Column) -> Column:
    return F.right(plural, F.lit(PLURAL_KEY_CHARS))


def question_values(text: Column) -> Column:
    """Quoted pieces and capitalised words of three characters or more."""
    quoted = F.transform(
        F.regexp_extract_all(text, F.lit("'[^']+'|\"[^\"]+\""), F.lit(0)),
        lambda v: v.substr(F.lit(2), F.length(v) - 2),
    )
    capitals = F.regexp_extract_all(text, F.lit(rf"{EDGE}[A-Z][A-Za-z0-9_&/-]{{2,}}{EDGE}"), F.lit(0))
    return F.array_distinct(F.concat(quoted, capitals))


def required_operations(text: Column) -> Column:
    """Operations a question asks for, as an array of structs; an operation may occur twice.

    Hints count wherever their letters occur, also inside other words.
    """
    return bound(normalize(text), _operations)


def _operations(q: Column) -> Column:
    def found(operation: str, evidence: Column, wanted: Column) -> Column:
        return F.when(wanted, F.struct(F.lit(operation).alias("operation"), evidence.alias("evidence")))

    rows = []
    for operation, hints in vocab.OPERATION_HINTS:
        matched = F.filter(text_array(hints), lambda h: F.contains(q, h))
        rows.append(found(operation, matched, F.size(matched) > 0))
    counted = q.rlike(r"\bnumber of .*subjects? offered\b") | q.rlike(r"\bnumber of .*records?\b")
    rows.append(found("count", text_array(["number of offered subjects/records"]), counted))
    totals = F.regexp_extract_all(q, F.lit(r"\btotal ([a-z0-9 ]{2,40}?)(?: and| for| within|$)"), F.lit(1))
    summed = F.exists(totals, lambda t: ~F.array_contains(F.split(t, " "), "unit"))
    rows.append(found("sum", text_array(["total aggregate phrase"]), summed))
    dense = F.contains(q, F.lit("dense rank"))
    rows.append(found("dense_rank", text_array(["dense rank"]), dense))
    rows.append(found("rank", text_array(["rank"]), ~dense & F.contains(F.concat(F.lit(" "), q), F.lit(" rank"))))
    ordered = F.contains(q, F.lit("order by")) | F.contains(q, F.lit("ordered by"))
    rows.append(found("order_by", text_array(["ordered by"]), ordered))
    grouped = F.contains(q, F.lit("for each")) | F.contains(q, F.lit("grouped by"))
    rows.append(found("group_by", text_array(["for each/grouped by"]), grouped))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def required_grain(text: Column) -> Column:
    """Up to four phrases that name the row grain: 'for each X' first, then new ones from 'per X' and 'by X'."""
    return bound(normalize(text), _grain)


def _grain(q: Column) -> Column:
    def after(pattern: str) -> Column:
        return F.filter(
            F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), lambda g: F.trim(g)), lambda g: g != ""
        )

    each = after(r"for each ([a-z0-9 ]{2,80}?)(?: where| with| ordered| and|$)")
    others = F.concat(
        after(r"\bper ([a-z0-9 ]{2,40}?)(?: and| ordered|$)"), after(r"\bby ([a-z0-9 ]{2,40}?)(?: and| ordered|$)")
    )
    return F.slice(F.concat(each, F.array_except(others, each)), 1, 4)


def search_tokens(text: Column) -> Column:
    """Distinct letter-or-digit words of three characters or more, with singulars."""
    split = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    found = F.array_distinct(F.filter(split, lambda w: F.length(w) > 2))
    return bound(found, lambda base: F.array_distinct(F.concat(base, _singulars(base))))


def extract_answer(output: Column) -> Column:
    """The SQL of a model output: tags first, then a fence, then a leading label."""
    answer = F.substring_index(output, "<ans>", -1)
    answer = F.substring_index(answer, "</ans>", 1)
    answer = F.substring_index(answer, "```sql", -1)
    answer = strip(F.substring_index(answer, "```", 1))
    return F.when(
        F.lower(answer).startswith("sql:"), strip(answer.substr(F.lit(5), F.length(answer)))
    ).otherwise(answer)


def extract_plan(output: Column) -> Column:
    """The first declared plan: raw text, whether it is JSON, and the required keys it lacks.

    NULL without a plan. JSON that is not an object lacks all keys; text that is not JSON has no key list.
    """
    pattern = rf"(?is)<plan>{SPACE}*(.*?){SPACE}*</plan>"
    found = F.when(output.rlike(pattern), strip(F.regexp_extract(output, pattern, 1)))
    return bound(found, _checked_plan)


def _checked_plan(raw: Column) -> Column:
    value = F.try_parse_json(raw)
    is_object = raw.rlike(r"(?s)^\{.*\}$") & value.isNotNull()
    is_other = raw.rlike(r"(?s)^(\[.*\]|\".*\"|-?\d[\d.eE+-]*|true|false|null)$") & value.isNotNull()
    keys = F.coalesce(F.json_object_keys(raw), text_array([]))
    missing = F.when(is_object, F.array_except(text_array(vocab.PLAN_KEYS), keys)).when(
        is_other, text_array(vocab.PLAN_KEYS)
    )
    return F.when(
        raw.isNotNull(),
        F.struct(raw.alias("raw"), (is_object | is_other).alias("parseable"), missing.alias("missing_keys")),
    )


def normalize_sql(sql: Column) -> Column:
    """Lower case, outer blanks and then outer semicolons removed, inner white space as one blank."""
    return F.regexp_replace(F.lower(F.btrim(strip(sql), F.lit(";"))), f"{SPACE}+", " ")
