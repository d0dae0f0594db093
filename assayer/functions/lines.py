"""Lines of a text, file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import bound

# fixed value: every line break, with carriage return + line feed as one
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a break at the very end does not start another line."""

    def without_last(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return bound(F.split(text, LINE_BREAK, -1), without_last)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot of the name and what follows; empty for dot-files and names that end in a dot."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def resolve(path: Column) -> Column:
    """Path segments after folding ``.``, empty segments and ``..``; the root is its own parent."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.array_append(done, s)).otherwise(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ),
    )
