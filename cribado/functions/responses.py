"""Parsing of model responses.

The plain patterns are in `fixed`. Two things differ in what the JVM runs:

* `\\s`, `\\d` and `\\w` are spelled out as Unicode classes.
* Repeated groups are possessive. `java.util.regex` recurses once per repetition of a group
  that may backtrack, so one long rambling response would overflow the stack and take its
  executor down. Possessive groups iterate instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribado.functions.fixed import (
    DIGIT_CLASS,
    DOMAIN_PATTERN,
    NO_MATCH,
    RATING_PATTERN,
    SPACE_CLASS,
    USE_CASE_PATTERN,
    WORD_CLASS,
)


def unicode_classes(pattern: str) -> str:
    """Spell out the shorthand classes of a plain pattern."""
    return (
        pattern.replace(r"[:\s]", f"[:{SPACE_CLASS}]")
        .replace(r"[\d\.]", rf"[{DIGIT_CLASS}\.]")
        .replace(r"\s", f"[{SPACE_CLASS}]")
        .replace(r"\w", f"[{WORD_CLASS}]")
    )


def possessive(pattern: str) -> str:
    """Make the repetitions possessive.

    Only for patterns in which giving characters back can never turn a failure into a match:
    each repeated item starts with a character that the item before it cannot contain.
    """
    return pattern.replace("+", "++").replace("*", "*+")


# A domain list ends at a line break, yet words may be joined by line breaks too. So it is the
# longest run of complete lines, and the last line break falls off.
_LINE = r"\w+(?:[^\S\n]\w+)*(?:,\s*\w+(?:[^\S\n]\w+)*)*"
_INLINE_SPACE = SPACE_CLASS.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")


def _domain_lines() -> str:
    head = DOMAIN_PATTERN.split("(", 1)[0]
    lines = rf"{head}((?:{_LINE}\n)+)".replace(r"[^\S\n]", f"[{_INLINE_SPACE}]")
    return possessive(unicode_classes(lines))


def _first_group(response: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(response, pattern, 1), F.lit(""))


def rating_text(response: Column) -> Column:
    """First rating in the response, kept as text; NULL when there is none."""
    return _first_group(response, possessive(unicode_classes(RATING_PATTERN)))


def _with_hyphens(pattern: str, hyphen_tags: bool) -> str:
    return pattern.replace(f"[{WORD_CLASS}]", f"[{WORD_CLASS}-]") if hyphen_tags else pattern


def domain_list(response: Column, hyphen_tags: bool = False) -> Column:
    """Comma-joined domains; the list has to end at a line break."""
    lines = F.regexp_extract(response, _with_hyphens(_domain_lines(), hyphen_tags), 1)
    return F.nullif(F.left(lines, F.length(lines) - 1), F.lit(""))


def use_case_list(response: Column, hyphen_tags: bool = False) -> Column:
    """Comma-joined use cases."""
    pattern = possessive(unicode_classes(USE_CASE_PATTERN))
    return _first_group(response, _with_hyphens(pattern, hyphen_tags))


def null_if_no_match(value: Column) -> Column:
    """The whole-value sentinel becomes NULL; inside a list it stays a tag."""
    return F.nullif(value, F.lit(NO_MATCH))
