"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPRECATION = "(?i)deprecat"
#: The start of a word of ASCII letters, digits and underscores, and ASCII white space: the Java classes also know other letters and the vertical tab.
WORD_START, SPACE = "(?<![0-9A-Za-z_])", r"[\t\n\f\r ]"


def strip(c: Column) -> Column:
    """Remove all white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Collapse every run of white space to one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def matching_paragraphs(doc: Column, pattern: str = DEPRECATION, separator: str = "\n\n") -> Column:
    """Squeezed paragraphs that match the pattern, joined by `` ~ ``."""
    found = F.filter(F.split(doc, separator), lambda p: p.rlike(pattern))
    return F.array_join(F.transform(found, squeeze), " ~ ")


def location_file(location: Column) -> Column:
    """The part of ``file:line`` before the last colon; all of it when there is none."""
    return F.regexp_replace(location, r"(?s):[^:]*$", "")


def canonical_path(path: Column) -> Column:
    """Spelling-independent form of a path; ``<string>`` stays as it is."""
    clean = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/{2,}", "/")
    return F.regexp_replace(clean, r"^(\./)+", "")


def module_path(relative: Column, library: Column) -> Column:
    """Dotted module of a file: ``lib`` + ``a/b/__init__.py`` -> ``lib.a.b``."""
    stem = F.regexp_replace(relative, r"\.py$", "")
    stem = F.regexp_replace(stem, r"(^|/)__init__$", "")
    return F.when(stem == "", library).otherwise(F.concat(library, F.lit("."), F.replace(stem, F.lit("/"), F.lit("."))))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def numbered_lines(code: Column, pointer: Column) -> Column:
    """Lines with numbers; an arrow marks the pointed-to line."""
    lines = F.split(F.regexp_replace(code, r"\r\n?", "\n"), "\n")
    # a trailing line break does not start another line
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    shown = F.transform(
        lines,
        lambda text, i: F.concat(
            F.when(i + 1 == pointer, F.lit("--> ")).otherwise(F.lit("    ")),
            F.format_string("%3d | ", i + 1), text,
        ),
    )
    return F.array_join(shown, "\n")


def as_array(c: Column) -> Column:
    """A text that holds one value or a JSON list of values, as an array."""
    return F.when(
        F.ltrim(c).startswith("["), F.from_json(c, "array<string>")
    ).otherwise(F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c)))
