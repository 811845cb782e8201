"""Column functions on file names and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from filescape.functions.labels import (
    NATIVE_MIME_LABELS,
    NO_EXTENSION,
    NO_EXTENSION_LABEL,
    NOISE_DIRS,
    TYPE_LABELS,
)

# Fixed value: the pieces names are split into.
SEGMENT_RE = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"
#: Capitals whose lower case is one letter, which full case rules do not give.
_SINGLE = ("\u0130\u03a3", "i\u03c3")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"'{text}'" for entry in table.items() for text in entry)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def base_name(path: Column | str) -> Column:
    """Last path component."""
    return F.substring_index(_col(path), "/", -1)


def fold(text: Column | str) -> Column:
    """Lower case, letter by letter: the place of a sigma in a word does not matter, and the
    dotted capital I gives one letter. ASCII text has neither and is only lowered."""
    text = _col(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, *_SINGLE)))


def fold_text(text: str) -> str:
    """`fold` for a parameter."""
    return text.translate(str.maketrans(*_SINGLE)).lower()


def file_ext(name: Column | str) -> Column:
    """Lower-cased text from the last dot on; "" when there is none or it leads the name."""
    name = _col(name)
    tail = F.substring_index(name, ".", -1)
    dot_at = F.octet_length(name) - F.octet_length(tail)
    found = (dot_at > 1) & ~F.contains(tail, F.lit("/"))
    return F.when(found, F.concat(F.lit("."), fold(tail))).otherwise(F.lit(""))


def shown_ext(ext: Column | str) -> Column:
    """Extension as reports show it."""
    ext = _col(ext)
    return F.when(ext == "", F.lit(NO_EXTENSION)).otherwise(ext)


def type_label(ext: Column | str) -> Column:
    """Human-readable type of an extension made by `file_ext`."""
    ext = _col(ext)
    plain = F.when(ext == "", F.lit(NO_EXTENSION_LABEL)).otherwise(
        F.concat(F.substring(ext, 2, 2**31 - 1), F.lit(" file"))
    )
    return F.coalesce(_lookup(TYPE_LABELS, ext), plain)


def drive_ext(name: Column | str, mime_type: Column | str) -> Column:
    """`file_ext`, except that a drive's native documents have none."""
    native = _col(mime_type).isin(list(NATIVE_MIME_LABELS))
    return F.when(native, F.lit("")).otherwise(file_ext(name))


def drive_type_label(name: Column | str, mime_type: Column | str) -> Column:
    """Label of a drive file: by mime type for native documents, else by extension."""
    return F.coalesce(
        _lookup(NATIVE_MIME_LABELS, _col(mime_type)), type_label(file_ext(name))
    )


def drive_dedup_key(name: Column | str, size: Column | str, md5: Column | str) -> Column:
    """Checksum key, or name and size where the listing has no checksum."""
    md5 = _col(md5)
    weak = F.concat(F.lit("namesize:"), _col(name), F.lit(":"), _col(size).cast("string"))
    return F.when(md5 != "", F.concat(F.lit("md5:"), md5)).otherwise(weak)


def name_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def name_stem(name: Column | str, ext: Column | str, fold_ext_case: bool = False) -> Column:
    """Name without its extension.

    `ext` is lower case, so an upper-case extension stays in the stem unless
    `fold_ext_case` is set.
    """
    name, ext = _col(name), _col(ext)
    compared = fold(name) if fold_ext_case else name
    cut_name = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(F.endswith(compared, ext), cut_name).otherwise(name)


def segment_values(stem: Column | str) -> Column:
    """Runs of ASCII letters, of ASCII digits and of anything else, in order."""
    return F.regexp_extract_all(_col(stem), F.lit(SEGMENT_RE), F.lit(0))


def segment_kind(value: Column) -> Column:
    """A for letters, D for digits, S for separators, told by the first character."""
    first = F.ascii(value)
    letter = first.between(65, 90) | first.between(97, 122)
    return (
        F.when(letter, F.lit("A"))
        .when(first.between(48, 57), F.lit("D"))
        .otherwise(F.lit("S"))
    )


def name_segments(stem: Column | str) -> Column:
    """Segments of a stem as array<struct<kind, value>>."""
    return F.transform(
        segment_values(stem),
        lambda value: F.struct(segment_kind(value).alias("kind"), value.alias("value")),
    )


def shape_key(stem: Column | str) -> Column:
    """The stem with every run of letters written A and every run of digits written D.

    Separators stay as they are, so two stems share a key exactly when their segments
    agree in number, kind and separator text.
    """
    letters = F.regexp_replace(_col(stem), "[A-Za-z]+", "A")
    return F.regexp_replace(letters, "[0-9]+", "D")


def trash_name(path: Column | str) -> Column:
    """Flat name of a path inside a trash folder."""
    return F.replace(F.regexp_replace(_col(path), "^/", ""), F.lit("/"), F.lit("__"))


def relative_path(path: Column | str, root: str) -> Column:
    """Path below `root`, with a leading slash; "" for the root itself."""
    base = root.rstrip("/")
    return F.substring(_col(path), len(base) + 1, 2**31 - 1)


def in_scope(path: Column | str, root: str, is_dir: Column | None = None) -> Column:
    """True unless a component below `root` is hidden or a noise directory."""
    noise = "|".join(re.escape(name) for name in NOISE_DIRS if not name.startswith("."))
    below = relative_path(path, root)
    if is_dir is not None:
        below = F.concat(below, F.when(is_dir, F.lit("/")).otherwise(F.lit("")))
    return ~below.rlike(rf"/\.|/(?:{noise})/")


def tree_key(path: Column | str, root: str) -> Column:
    """Sort key of a depth-first listing with siblings in lower-case name order."""
    parts = F.split(relative_path(path, root), "/", -1)
    return F.transform(
        parts, lambda part: F.struct(fold(part).alias("folded"), part.alias("exact"))
    )


def depth(path: Column | str, root: str) -> Column:
    """Number of components below `root`."""
    below = relative_path(path, root)
    return (F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit("")))).cast("bigint")


def parent_path(path: Column | str) -> Column:
    """Path of the containing directory."""
    path = _col(path)
    head = F.substring(
        path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    )
    return F.when(head == "", F.lit("/")).otherwise(head)
