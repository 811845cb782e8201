import datetime

import pytest
from pyspark.sql import functions as F

from filescape.functions import names, sizes
from filescape.operators.scope import parse_ext_list


def values(spark, inputs, column, kind="string"):
    """The column function applied to each input, in order."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"at int, v {kind}")
    return [r[0] for r in frame.orderBy("at").select(column(F.col("v")).alias("out")).collect()]


def test_extension_and_label(spark):
    cases = {
        "tide.table.go": (".go", "Go source"),
        "LOGBOOK": ("", "File (no extension)"),
        ".harbourrc": ("", "File (no extension)"),
        "x.svg.gz": (".gz", "Gzip archive"),
        "\u0130.T\u0130F": (".tif", "tif file"),
        "a.": (".", " file"),
        "A.PDF": (".pdf", "PDF document"),
        "data.xyz": (".xyz", "xyz file"),
        "a.b/c": ("", "File (no extension)"),
        "x/.b": (".b", "b file"),
        "": ("", "File (no extension)"),
        "é.txt": (".txt", "Text document"),
    }
    exts = values(spark, cases, names.file_ext)
    labels = values(spark, cases, lambda c: names.type_label(names.file_ext(c)))
    assert list(zip(exts, labels)) == list(cases.values())


def test_drive_labels(spark):
    rows = [
        ("Plan", "application/vnd.google-apps.document", "", "Google Doc"),
        ("v1.2", "application/vnd.google-apps.spreadsheet", "", "Google Sheet"),
        ("a.pdf", "application/pdf", ".pdf", "PDF document"),
        ("b.zip", None, ".zip", "ZIP archive"),
    ]
    frame = spark.createDataFrame(rows, "name string, mime string, ext string, label string")
    found = frame.select(
        "ext", names.drive_ext("name", "mime"), "label", names.drive_type_label("name", "mime")
    ).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in found)


def test_drive_key_tests_the_checksum_not_the_type(spark):
    frame = spark.createDataFrame(
        [("a", 3, "x1"), ("a", 3, None), ("a", 3, "")], "name string, size long, md5 string"
    )
    keys = [r[0] for r in frame.select(names.drive_dedup_key("name", "size", "md5")).collect()]
    assert keys == ["md5:x1", "namesize:a:3", "namesize:a:3"]


def test_tokens(spark):
    found = values(spark, ["Tide+table~7b [N].csv", "crêpe9", "--", "\u0130stanbul.txt"], names.name_tokens)
    assert found == [["tide", "table", "7b", "n", "csv"], ["cr", "pe9"], [], ["istanbul", "txt"]]


def test_stem_keeps_an_upper_case_extension(spark):
    def stem(**flags):
        return lambda c: names.name_stem(c, names.file_ext(c), **flags)

    inputs = ["a_1.PDF", "a_1.pdf", "README", "a.", ".x"]
    assert values(spark, inputs, stem()) == ["a_1.PDF", "a_1", "README", "a", ".x"]
    assert values(spark, inputs, stem(fold_ext_case=True))[0] == "a_1"


def test_segments_and_shape(spark):
    inputs = ["ab12__x", "é9", "", "--"]
    pieces = [
        [(s["kind"], s["value"]) for s in found]
        for found in values(spark, inputs, names.name_segments)
    ]
    assert pieces == [
        [("A", "ab"), ("D", "12"), ("S", "__"), ("A", "x")],
        [("S", "é"), ("D", "9")],
        [],
        [("S", "--")],
    ]
    assert values(spark, inputs, names.shape_key) == ["AD__A", "éD", "", "--"]


def test_trash_name_and_paths(spark):
    assert values(spark, ["/a/b", "a/b", "//a"], names.trash_name) == ["a__b", "a__b", "__a"]
    assert values(spark, ["/a/b/c", "/a"], names.parent_path) == ["/a/b", "/"]
    assert values(spark, ["/r/a/b", "/r"], lambda c: names.depth(c, "/r")) == [2, 0]
    assert values(spark, ["/a"], lambda c: names.depth(c, "/")) == [1]


def test_human_size(spark):
    cases = {
        0: "0 B",
        500: "500 B",
        1023: "1023 B",
        1024: "1.0 KiB",
        1280: "1.2 KiB",
        1792: "1.8 KiB",
        2048: "2.0 KiB",
        5242880: "5.0 MiB",
        1048575: "1024.0 KiB",
        1 << 40: "1.0 TiB",
        3 << 50: "3.0 PiB",
        (1 << 63) - 1: "8.0 EiB",
    }
    assert values(spark, cases, sizes.human_size, "long") == list(cases.values())


SIZE_TEXTS = {
    "100MB": 100000000,
    "1.5GiB": 1610612736,
    "512k": 524288,
    "7": 7,
    " 2 KB ": 2000,
    "3.B": 3,
    ".5K": 512,
    "1.5.2": None,
    "PiB": None,
    "1PiB": None,
    "": None,
    "-5": None,
    ".": None,
    "5 x": None,
}


def test_parse_size_column(spark):
    assert values(spark, SIZE_TEXTS, sizes.parse_size) == list(SIZE_TEXTS.values())


@pytest.mark.parametrize("text,expected", SIZE_TEXTS.items())
def test_parse_size_parameter(text, expected):
    if expected is None:
        with pytest.raises(ValueError):
            sizes.size_in_bytes(text)
    else:
        assert sizes.size_in_bytes(text) == expected


def test_modified_time(spark):
    micros = values(
        spark,
        [
            "1970-01-01T00:00:01Z",
            "1970-01-01T02:00:00.5+02:00",
            "1970-01-01T00:00:00,25Z",
            "1970-01-01",
            "1970-01-01 00:00:01Z",
            "1970-13-01T00:00:00Z",
            "1970-01-01T00:00:00",
            "soon",
            None,
        ],
        lambda c: F.unix_micros(sizes.modified_time(c)),
    )
    assert micros == [1000000, 500000, 250000, None, None, None, None, None, None]
    assert isinstance(values(spark, ["2020-01-01T00:00:00Z"], sizes.modified_time)[0], datetime.datetime)


def test_ext_list():
    assert parse_ext_list(" PDF, .docx ,,") == [".pdf", ".docx"]
    assert parse_ext_list(",") == []


def test_sizes_round_on_whole_numbers(spark):
    eib = 1024**6
    cases = [int(1.15 * eib) - 16, 1280, 1331, 1024 + 51, 1024 + 52, 1024 * 1024 - 1]
    assert values(spark, cases, sizes.human_size, "long") == ["1.1 EiB", "1.2 KiB", "1.3 KiB", "1.0 KiB", "1.1 KiB", "1024.0 KiB"]


def test_times_end_where_they_end(spark):
    assert values(spark, ["2020-01-01T00:00:00Z\n"], sizes.modified_time) == [None]
