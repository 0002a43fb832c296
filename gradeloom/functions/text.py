"""Text expressions with the string rules of Python, as Spark columns.

Patterns carry ``(?U)`` where classes must be Unicode-aware and ``(?d)`` where
only ``\\n`` ends a line; ``trim`` in Spark removes spaces alone, so white space
is stripped by pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: a lambda inside f would compute an outer expression for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quoted(chars: str) -> str:
    """The characters inside a regex class."""
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in chars)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Remove the characters from both ends."""
    q = quoted(chars)
    return F.regexp_replace(c, f"^[{q}]+|[{q}]+$", "")


def strip_punctuation(c: Column) -> Column:
    return strip_chars(c, PUNCTUATION + " ")


def drop_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def is_blank(c: Column) -> Column:
    return F.regexp_like(c, F.lit("(?U)^\\s*$"))


def tokens(c: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(c, "(?U)\\s+"), lambda x: x != "")


def words(c: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(c, F.lit("(?U)(\\w+)"), 1)


def count_matches(c: Column, pattern: str | Column) -> Column:
    return F.regexp_count(c, F.lit(pattern) if isinstance(pattern, str) else pattern).cast("int")


def slugify(c: Column) -> Column:
    """Lower case; runs of other than a-z and 0-9 become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def run_id(model: Column) -> Column:
    """The default run id of a model name: its last path part in lower case, other runs as a hyphen."""
    part = F.element_at(F.split(F.regexp_replace(model, "/+$", ""), "/"), -1)
    tidy = F.regexp_replace(F.regexp_replace(F.lower(part), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit("model"))


def tail(c: Column, n: int = 1000) -> Column:
    """The last n code points: bounds what a pattern may scan."""
    return F.right(c, F.lit(n))


def last_match(c: Column, pattern: str | Column, group: int = 1) -> Column:
    """The last match's group; null without a match."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern) if isinstance(pattern, str) else pattern, group), F.lit(-1))


def collapse(c: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return strip(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))
