"""Column functions and small parsers."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from migcheck.functions import compare, mainframe
from migcheck.sources import copybook, flatfiles, tables
from migcheck.sources.shared import shared_dir

EQUAL = [
    (None, None, True), (None, "", False), ("Y", "true", True), ("1", "TRUE", True), ("n", "0", True), ("Y", "N", False),
    ("03/20/75", "1975-03-20", True), ("March 20, 1975", "3/20/1975", True), ("2024-01-05T10:00:00", "2024-1-5", True), ("01/01/69", "1969-01-01", True), ("01/01/68", "2068-01-01", True),
    ("(555) 123-4567", "5551234567", True), ("555-1234", "5551234", True), ("12.0001", "12", True), ("12.01", "12", False), (" Active ", "ACTIVE", True), ("a", "b", False),
    ("2024-02-30", "2024-03-01", False), ("1", "1.0", True),
]


def test_equivalent(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in EQUAL], "a string, b string")
    got = [r.same for r in df.select(compare.equivalent(F.col("a"), F.col("b")).alias("same")).collect()]
    assert got == [x for _, _, x in EQUAL]


def test_parse_date_refuses_other_forms(spark):
    df = spark.createDataFrame([("20.03.1975",), ("",), ("x",), ("1975-13-01",), ("Dec 1, 2020",), ("December 1, 2020",)], "t string")
    assert [r.d for r in df.select(compare.parse_date(F.col("t")).alias("d")).collect()] == [None] * 5 + [datetime.date(2020, 12, 1)]


def test_ebcdic_covers_all_bytes(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),), (None,)], "raw binary")
    got = [r.t for r in df.select(mainframe.decode_ebcdic(F.col("raw")).alias("t")).collect()]
    assert got == [" " + bytes(range(1, 256)).decode("cp037"), "", None]
    with pytest.raises(ValueError):
        mainframe.decode_ebcdic(F.col("raw"), "cp500")


def test_packed_decimals(spark):
    cases = [("12345C", 2, "123.45"), ("00001D", 2, "-0.01"), ("0C", 0, "0"), ("99999F", 0, "99999"), ("00120D", 0, "-120"), ("5C", 2, "0.05")]
    for text, decimals, want in cases:
        df = spark.createDataFrame([(bytearray.fromhex(text if len(text) % 2 == 0 else "0" + text),)], "raw binary")
        assert df.select(mainframe.decode_packed(F.col("raw"), decimals)).first()[0] == want


def test_pic_clauses():
    types = {"X": "CHAR(1)", "X(20)": "VARCHAR(20)", "9(4)": "SMALLINT", "S9(9)": "INTEGER", "9(18)": "BIGINT", "9(20)": "NUMERIC(20)", "S9(7)V99": "NUMERIC(9,2)"}
    assert {p: mainframe.pic_type(p) for p in types} == types
    assert mainframe.pic_bytes("S9(7)V99", "COMP-3") == 5 and mainframe.pic_bytes("9(4)", "COMP") == 2 and mainframe.pic_bytes("9(10)", "COMP") == 8


LAYOUT = """
000100* a comment
000200 01 REC.
000300    05 A-KEY   PIC 9(4).
000400    05 B-AMT   PIC S9(5)V99
000500               COMP-3.
000600    05 B-TEXT  REDEFINES B-AMT PIC X(4).
000700    05 C-FLAG  PIC X OCCURS 3 TIMES.
000800       88 C-YES VALUE 'Y'.
000900    05 FILLER  PIC X(2).
"""


def test_copybook():
    got = [(f.name, f.offset, f.length, f.decimals, f.sql_type) for f in copybook.parse(LAYOUT)]
    assert got == [
        ("A-KEY", 0, 4, 0, "SMALLINT"), ("B-AMT", 4, 4, 2, "NUMERIC(7,2)"), ("B-TEXT", 4, 4, 0, "VARCHAR(4)"), ("C-FLAG", 8, 3, 0, "CHAR(1)"), ("FILLER", 11, 2, 0, "VARCHAR(2)"),
    ]
    assert copybook.record_length(copybook.parse(LAYOUT)) == 13


def test_ebcdic_records_with_packed_fields(spark, tmp_path):
    fields = copybook.parse(LAYOUT)
    record = lambda key, packed, flags: f"{key:04}".encode("cp037") + bytes.fromhex(packed) + flags.encode("cp037") + b"\x00\x00"
    (tmp_path / "data.bin").write_bytes(record(7, "0012345C", "YNY") + record(8, "0000001D", "   ") + b"part")
    rows = flatfiles.read_records(spark, str(tmp_path / "data.bin"), fields, "ebcdic").orderBy("a_key").collect()
    assert [(r.a_key, r.b_amt, r.c_flag) for r in rows] == [("0007", "123.45", "YNY"), ("0008", "-0.01", "")]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text(" First-Name |b|c|d\n x | 1||\n y y|2|z|w\n")
    df = flatfiles.read_delimited(spark, str(tmp_path / "a.dat"))
    assert df.columns == ["first_name", "b", "c", "d"]
    assert [tuple(r) for r in df.collect()] == [("x", "1", None, None), ("y y", "2", "z", "w")]
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    assert flatfiles.sniff_delimiter(spark, str(tmp_path / "b.csv")) is None
    assert flatfiles.read_delimited(spark, str(tmp_path / "b.csv")).columns == ["a", "b"]


def test_damaged_lines_are_kept(spark, tmp_path):
    (tmp_path / "f.txt").write_text("0001abcdXYZ--\n\n0002ab\n")
    df = flatfiles.read_fixed_width(spark, str(tmp_path / "f.txt"), copybook.parse(LAYOUT), keep_damaged=True)
    assert [(r.a_key, r._damaged) for r in df.collect()] == [("0001", None), ("0002", "0002ab")]


def test_source_registry(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert tables.read_source(spark, {"type": "parquet", "path": str(tmp_path / "t")}).count() == 3
    own = {"mine": lambda spark, config, query: spark.range(config["n"])}
    assert tables.read_source(spark, {"type": "mine", "n": 4}, more=own).count() == 4
    with pytest.raises(ValueError, match="available"):
        tables.read_source(spark, {"type": "nothing"})
    assert tables.jdbc_url({"type": "oracle", "host": "h", "sid": "X"}) == "jdbc:oracle:thin:@h:1521:X"
    assert tables.jdbc_url({"type": "postgres", "host": "h", "database": "d"}) == "jdbc:postgresql://h:5432/d"


def test_full_load_replaces(spark):
    path = shared_dir(spark, "load-test")
    assert tables.full_load(spark.range(5).toDF("id"), path) == 5
    assert tables.full_load(spark.range(2).toDF("id"), path) == 2


def plain_date(text):
    text = text.strip()
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%B %d, %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.datetime.strptime(text, form).date()
        except ValueError:
            pass
    return None


def plainly_equivalent(a, b):
    if a is None or b is None:
        return a is b
    low = [x.strip().lower() for x in (a, b)]
    flags = [compare.BOOLEANS.get(x) for x in low]
    if None not in flags:
        return flags[0] == flags[1]
    days = [plain_date(x) for x in (a, b)]
    if None not in days:
        return days[0] == days[1]
    digits = ["".join(c for c in x if c in "0123456789") for x in (a, b)]
    if len(digits[0]) >= 7 and digits[0] == digits[1]:
        return True
    try:
        return abs(float(a) - float(b)) < 0.001
    except ValueError:
        return low[0] == low[1]


def test_equivalent_on_random_pairs(spark):
    rng = random.Random(11)
    forms = [
        lambda: rng.choice(["Y", "n", "TRUE", "false", "1", "0", " y ", "yes", ""]),
        lambda: f"{rng.randint(1960, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 30):02}",
        lambda: f"{rng.randint(1, 13)}/{rng.randint(1, 31)}/{rng.randint(0, 99):02}",
        lambda: f"{rng.randint(1, 12):02}/{rng.randint(1, 28):02}/{rng.randint(1990, 1993)}",
        lambda: f"({rng.randint(555, 556)}) 123-{rng.randint(4567, 4569)}",
        lambda: f"555123{rng.randint(4567, 4569)}",
        lambda: rng.choice(["1", "1.0", "1.0004", "01", "2", "1e0", "-1", "+1"]),
        lambda: rng.choice(["a", "A ", "b", "March 3, 1991", "march 03, 1991", "1991-03-03T00:00:00", "1991-03-03 10:00:00"]),
        lambda: None,
    ]
    pairs = [(rng.choice(forms)(), rng.choice(forms)()) for _ in range(3000)]
    for _ in range(1000):
        form = rng.choice(forms)
        pairs.append((form(), form()))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.same for r in df.select("i", compare.equivalent(F.col("a"), F.col("b")).alias("same")).collect()}
    wrong = [(a, b, got[i]) for i, (a, b) in enumerate(pairs) if got[i] != plainly_equivalent(a, b)]
    assert not wrong, wrong[:10]
