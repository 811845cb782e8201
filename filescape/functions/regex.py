"""Content-search patterns.

Patterns follow the linear-time dialect (no look-around, no back-references). `rlike`
runs them as Java patterns, so the few constructs that mean something else there are
rewritten, and those only Java has are refused. Patterns are only ever tested on single
lines for a yes or no, so group names and greediness need not survive. Where case is ignored,
Java takes the dotted capital and the dotless small I for an i; that is left as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Bracket class names and what they are called in Java.
_POSIX = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "ascii": "ASCII",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}
_SPACE = r"\t\n\f\r "
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
# Classes that hold s and k, and what folds to these besides S and K.
_FOLDED = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "graph": "!-~", "lower": "A-Za-z", "print": " -~", "upper": "A-Za-z"}
_FOLDED_WORD = "0-9A-Za-z_"
_ALSO = r"\x{17F}\x{212A}"
_ANY = r"\x{0}-\x{10FFFF}"
# Fixed value: letters that letters beyond ASCII fold to, with and without a dot on the i.
_LOOSE = re.compile("[iIkKsS]")
_REPEAT = re.compile(r"[*+?]|\{(\d+)(?:,(\d*))?\}")
_MAX_REPEAT = 1000


def _fail(pattern: str, why: str):
    raise ValueError(f"invalid pattern {pattern!r}: {why}")


def _escape(pattern: str, at: int, in_class: bool, fold: bool = False) -> tuple[str, int]:
    """Java text for the escape at `at`, and the position after it; `fold` where case is ignored."""
    if at + 1 >= len(pattern):
        _fail(pattern, "trailing backslash")
    char = pattern[at + 1]
    after = at + 2
    if char in "pP":
        name = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(pattern, after)
        if not name:
            _fail(pattern, "bad character property")
        prop = name[2] or name[3]
        flip = bool(name[1]) != (char == "P")
        if prop == "Any":
            return (_ANY if in_class and not flip else f"[{'^' * flip}{_ANY}]"), name.end()
        java = prop if len(prop) <= 2 else f"Is{prop}"
        return f"\\{'P' if flip else 'p'}{{{java}}}", name.end()
    if char == "s":
        return (_SPACE if in_class else f"[{_SPACE}]"), after
    if char == "S":
        return (r"\S\x0B" if in_class else f"[^{_SPACE}]"), after
    if char in "bB" and not in_class:
        return (_EDGE if char == "b" else _NO_EDGE), after
    if char == "v":
        return r"\x0B", after
    if char == "x":
        digits = re.compile(r"\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}").match(pattern, after)
        if not digits:
            _fail(pattern, "bad hexadecimal escape")
        return pattern[at : digits.end()], digits.end()
    octal = re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(pattern, at + 1)
    if octal:
        return f"\\x{{{int(octal[0], 8):x}}}", octal.end()
    if char in "wW" and fold:
        inside = _FOLDED_WORD + _ALSO
        return (inside if in_class and char == "w" else f"[{'^' * (char == 'W')}{inside}]"), after
    if char in "dDwWafnrt" or (char in "Az" and not in_class):
        return pattern[at:after], after
    if char.isascii() and not char.isalnum():
        return pattern[at:after], after
    return _fail(pattern, f"unsupported escape \\{char}")


def _bracket(pattern: str, at: int, fold: bool = False) -> tuple[str, int]:
    """Java text for the bracket class opening at `at`, and the position after it; `fold` where
    case is ignored."""
    out, at = ["["], at + 1
    if pattern.startswith("^", at):
        out.append("^")
        at += 1
    first = True
    while at < len(pattern):
        char = pattern[at]
        if char == "]" and not first:
            return "".join(out) + "]", at + 1
        first = False
        posix = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, at)
        if posix:
            if fold and (posix[2] == "word" or posix[2] in _FOLDED):
                inside = _FOLDED.get(posix[2], _FOLDED_WORD) + _ALSO
                out.append(f"[^{inside}]" if posix[1] else inside)
            elif posix[2] == "word":
                out.append(r"\W" if posix[1] else r"\w")
            elif posix[2] in _POSIX:
                out.append(f"\\{'P' if posix[1] else 'p'}{{{_POSIX[posix[2]]}}}")
            else:
                _fail(pattern, f"unknown class {posix[0]}")
            at = posix.end()
        elif char == "\\":
            text, at = _escape(pattern, at, True, fold)
            out.append(text)
        else:
            out.append("\\" + char if char in "[]&^" else char)
            at += 1
    return _fail(pattern, "missing closing ]")


def _group(pattern: str, at: int) -> tuple[str, int]:
    """Java text for the opening parenthesis at `at`, and the position after it. Flags without
    a group end with their parenthesis."""
    named = re.compile(r"\(\?P?<[A-Za-z_]\w*>").match(pattern, at)
    if named:
        return "(", named.end()
    flags = re.compile(r"\(\?([imsU]*)(-[imsU]+)?([:)])").match(pattern, at)
    if flags:
        # Greediness (U) cannot change whether a line matches.
        on = flags[1].replace("U", "").replace("i", "iu")
        off = (flags[2] or "").replace("U", "").replace("i", "iu")
        off = "" if off == "-" else off
        bare = flags[3] == ")" and not on and not off
        return ("(?:)" if bare else f"(?{on}{off}{flags[3]}"), flags.end()
    if pattern.startswith("(?", at):
        _fail(pattern, "look-around and special groups are not supported")
    return "(", at + 1


def _folds(opened: str, fold: bool) -> bool:
    """Whether case is ignored after flags or an opening parenthesis in Java text."""
    on, _, off = opened.removeprefix("(?").partition("-") if opened.startswith("(?") else ("", "", "")
    return (fold or "i" in on) and "i" not in off


def java_pattern(pattern: str, ignore_case: bool = False, fixed: bool = False) -> str:
    """The Java pattern equal to `pattern`; ValueError where it is not valid."""
    flags = "(?diu)" if ignore_case else "(?d)"
    if fixed:
        return flags + re.sub(r"([^\w\s]|_)", r"\\\1", pattern, flags=re.ASCII)
    out, at = [], 0
    repeatable = repeated = False
    fold, outer = ignore_case, []
    while at < len(pattern):
        char = pattern[at]
        repeat = _REPEAT.match(pattern, at)
        if repeat:
            if repeated or not repeatable:
                _fail(pattern, f"nothing to repeat at {at}")
            if any(int(bound) > _MAX_REPEAT for bound in repeat.groups() if bound):
                _fail(pattern, "repeat count too large")
            lazy = pattern.startswith("?", repeat.end())
            out.append(repeat[0])
            at = repeat.end() + lazy
            repeated = True
            continue
        repeated = False
        repeatable = char not in "(|"
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            literal = pattern[at + 2 : end if end >= 0 else len(pattern)]
            out.append(re.sub(r"([^\w\s]|_)", r"\\\1", literal, flags=re.ASCII))
            at = end + 2 if end >= 0 else len(pattern)
        elif char == "\\":
            text, at = _escape(pattern, at, False, fold)
            out.append(text)
        elif char == "[":
            text, at = _bracket(pattern, at, fold)
            out.append(text)
        elif char == "(":
            text, at = _group(pattern, at)
            out.append(text)
            repeatable = False
            if not text.endswith(")"):
                outer.append(fold)
            fold = _folds(text, fold)
        else:
            if char == ")" and outer:
                fold = outer.pop()
            out.append("\\" + char if char in "{}]" else char)
            at += 1
    return flags + "".join(out)


def required_literals(pattern: str, ignore_case: bool = False, fixed: bool = False) -> list[list[str]]:
    """For every alternative of a pattern, ASCII texts that each of its matches holds.

    Only plain characters count, so the lists may say less than the pattern does. Where case
    is ignored in any part, letters that other letters than ASCII ones fold to end a text.
    """
    if fixed:
        found, fold = [_plain(pattern)], ignore_case
    else:
        java_pattern(pattern, ignore_case)
        found, _, fold = _alternatives(pattern, 0)
        fold = fold or ignore_case
    split = _LOOSE.split if fold else lambda text: [text]
    return [[part for text in texts for part in split(text) if part] for texts in found]


def _plain(text: str) -> list[str]:
    return re.findall(r"[\x00-\x7F]+", text)


def _alternatives(pattern: str, at: int) -> tuple[list[list[str]], int, bool]:
    """The texts of every alternative up to the end or the closing parenthesis, the position
    there, and whether flags ignore case in some part."""
    done, texts, text, fold = [], [], "", False
    begin = None  # where the texts of the last item begin; None for what has none of its own

    def flush():
        nonlocal text
        texts.append(text)
        text = ""

    while at < len(pattern) and pattern[at] != ")":
        char, repeat = pattern[at], _REPEAT.match(pattern, at)
        if repeat:
            if repeat[0] in "*?" or (repeat[1] is not None and int(repeat[1]) == 0):
                if begin is not None:
                    del texts[begin:]
                text = text[:-1]
            flush()
            begin, at = None, repeat.end() + pattern.startswith("?", repeat.end())
            continue
        begin = None
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            literal = pattern[at + 2 : end if end >= 0 else len(pattern)]
            flush()
            if literal.isascii():
                text = literal
            at = end + 2 if end >= 0 else len(pattern)
        elif char == "\\" and pattern[at + 1].isascii() and not pattern[at + 1].isalnum():
            text, at = text + pattern[at + 1], at + 2
        elif char in "\\[":
            flush()
            _, at = _escape(pattern, at, False) if char == "\\" else _bracket(pattern, at)
        elif char == "(":
            flush()
            opened, at = _group(pattern, at)
            fold = fold or _folds(opened, False)
            if not opened.endswith(")"):
                inner, at, folded = _alternatives(pattern, at)
                fold, at = fold or folded, at + 1
                begin = len(texts)
                texts += inner[0] if len(inner) == 1 else []
        elif char == "|":
            flush()
            done.append(texts)
            texts, at = [], at + 1
        elif char in ".^$" or not char.isascii():
            flush()
            at += 1
        else:
            text, at = text + char, at + 1
    flush()
    return [*done, texts], at, fold


def check_pattern(spark: SparkSession, pattern: str, ignore_case: bool = False) -> None:
    """Raise ValueError for a bad pattern before any file is read."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern, ignore_case))
    except ValueError:
        raise
    except Exception as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from None


def line_matches(
    text: Column, pattern: str, ignore_case: bool = False, fixed: bool = False
) -> Column:
    """True where `pattern` occurs anywhere in `text`."""
    if fixed and not ignore_case:
        return F.contains(text, F.lit(pattern))
    return text.rlike(java_pattern(pattern, ignore_case, fixed))
