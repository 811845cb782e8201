"""Column functions on file content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filescape.functions.names import _col


def content_hash(content: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of the content."""
    return F.sha2(_col(content), 256)


def raw_lines(content: Column | str) -> Column:
    """Lines without their newline, carriage returns kept; no line after a final newline."""
    content = _col(content)
    closed = F.when(
        F.endswith(content, F.lit("\n")), F.left(content, F.length(content) - 1)
    ).otherwise(content)
    none = F.array().cast("array<string>")
    return F.when(content == "", none).otherwise(F.split(closed, "\n", -1))


def searchable_lines(content: Column | str, max_line_bytes: int | None = None) -> Column:
    """All lines, or with `max_line_bytes` those up to the first one that does not fit, its newline included."""
    lines = raw_lines(content)
    if max_line_bytes is None:
        return lines
    fits = F.transform(lines, lambda line: F.octet_length(line) < max_line_bytes)
    bad = F.array_position(fits, F.lit(False))
    kept = F.when(bad == 0, lines).otherwise(
        F.slice(lines, F.lit(1), (bad - 1).cast("int"))
    )
    return F.when(F.octet_length(_col(content)) < max_line_bytes, lines).otherwise(kept)


def without_cr(line: Column | str) -> Column:
    """The line less one trailing carriage return."""
    line = _col(line)
    return F.when(
        F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)
    ).otherwise(line)


def is_text(content: Column | str) -> Column:
    """False where the first line holds a NUL."""
    first = F.substring_index(_col(content), "\n", 1)
    return ~F.contains(first, F.lit("\u0000"))
