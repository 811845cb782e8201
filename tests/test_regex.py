import duckdb
import pytest

from filescape.functions.regex import check_pattern, java_pattern

TEXTS = [
    "",
    "TODO: fix",
    "Hello (World)",
    "hello world",
    "a1 b22 c333",
    "tab\there",
    "v\x0bt",
    "snake_case x",
    "ünï straße",
    "a.b[c]{d}&&e",
    "2024-05-06",
    "line sep",
    "price 5$",
    "Kelvin",
    "^start",
    "x{,3}",
    "αβγ",
    "\u212a",
    "\u017f!",
]
PATTERNS = [
    "TODO|FIXME",
    "[[:digit:]]+",
    "[[:^alpha:]]",
    "[[:upper:]][[:lower:]]+",
    "^[^[:space:]]+$",
    r"\bworld\b",
    r"\Bor\B",
    r"h.*w",
    "line.sep",
    r"\s",
    r"t\Sh",
    r"[\s]",
    r"[^\S]",
    r"\d{2,3}",
    r"x{,3}",
    "{d}",
    r"[a[]",
    r"[]a]",
    r"[^]a-z]",
    r"[a&&b]",
    r"(?P<word>[a-z]+)_",
    r"(?i)HELLO",
    r"(?i:WORLD)$",
    r"(?i)k",
    r"(?i)STRASSE",
    r"(?U)a.*c",
    r"(?s).+",
    r"a*?b",
    r"\pL\d",
    r"\p{Greek}",
    r"\P{Latin}",
    r"\x41|\x{3b1}",
    r"\Qa.b[c]\E",
    r"\$$",
    r"\v",
    r"\056",
    r"5\$\z",
    r"\Ahello",
    "",
    "(a|b|)c",
    r"[\d-]+-",
    r"[[:word:]]+ x",
    r"(?i)^\w$",
    r"(?i)^[\w]!",
    r"(?i)^\W$",
    r"(?i)^[^\W]",
    r"(?i)^[[:upper:]]$",
    r"(?i)^[[:lower:]]!",
    r"(?i)^[[:^alpha:]]$",
    r"(?i:[[:word:]])!",
    r"(?i:a)\w!|^\w$",
    r"(?i)(?-i:^\w$)",
    r"^\w$",
    r"\p{Any}x",
    r"^\P{Any}*$",
    r"[\p{Any}]\d",
]
BAD = [
    "(",
    "[a",
    "a**",
    "*a",
    "a*+",
    "a++",
    r"\1",
    r"(a)\1",
    "(?=a)",
    "(?!a)",
    "(?<=a)b",
    "(?<!a)b",
    "(?>a)",
    r"\Z",
    r"\h",
    r"\R",
    "a{1001}",
    "[[:nope:]]",
    "a\\",
    "(?x)a",
    ")",
]


def test_same_lines_match_as_in_the_linear_time_engine(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for pattern in PATTERNS:
        check_pattern(spark, pattern)
        found = {r[0] for r in frame.where(frame.t.rlike(java_pattern(pattern))).collect()}
        expected = {
            t
            for t in TEXTS
            if duckdb.execute("select regexp_matches(?, ?)", [t, pattern]).fetchone()[0]
        }
        assert found == expected, pattern


@pytest.mark.parametrize("pattern", BAD)
def test_bad_patterns_are_refused_before_any_scan(spark, pattern):
    with pytest.raises(ValueError):
        check_pattern(spark, pattern)


def test_literal_patterns(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for literal in ["(World)", "a.b[c]{d}&&e", "5$", "x{,3}", "α"]:
        wanted = {t for t in TEXTS if literal.lower() in t.lower()}
        pattern = java_pattern(literal.swapcase(), ignore_case=True, fixed=True)
        assert {r[0] for r in frame.where(frame.t.rlike(pattern)).collect()} == wanted, literal
