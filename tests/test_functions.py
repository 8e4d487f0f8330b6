import datetime

import pytest
from pyspark.sql import functions as F

from cratework import functions as fn


def values(spark, texts, expression, kind="string"):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_duration_seconds(spark):
    cases = {
        "3:45": 225, "1:23:45": 5025, "45": 45, "": None, "  ": None, None: None, "3:4": None,
        "99:99": 99 * 60 + 99, "1:2:3": None, " 3:45\n": 225, " 3:45": 225, "x": None,
        "120:00": 7200, "-3:45": None, "1:00:00:00": None, "99999999999999999999": None,
    }
    assert values(spark, list(cases), fn.duration_seconds("x")) == list(cases.values())


def test_duration_text(spark):
    cases = {0: "0:00", 59: "0:59", 225: "3:45", 3600: "1:00:00", 5025: "1:23:45", -1: None,
             None: None}
    assert values(spark, list(cases), fn.duration_text("x"), "int") == list(cases.values())


def test_duration_round_trip(spark):
    seconds = list(range(0, 90000, 37))
    assert values(
        spark, seconds, fn.duration_seconds(fn.duration_text("x")), "int"
    ) == seconds


def test_partial_date(spark):
    day = datetime.date
    cases = {
        "1999-03-05": day(1999, 3, 5), "1999-3-5": day(1999, 3, 5), "1999-03": day(1999, 3, 1),
        "1999-3": day(1999, 3, 1), "1999": day(1999, 1, 1), "1999-03-00": None,
        "2023-13-45": None, "2023/12/25": None, "not-a-date": None, "": None, None: None,
        "0000": None, " 2001 ": day(2001, 1, 1),
    }
    assert values(spark, list(cases), fn.partial_date("x")) == list(cases.values())


def test_iso_timestamp(spark):
    texts = ["2019-11-05T21:08:30-07:00", "2019-11-05T21:08:30Z", "bad", None]
    got = values(spark, texts, F.unix_seconds(fn.iso_timestamp("x")))
    utc = int(datetime.datetime(2019, 11, 5, 21, 8, 30, tzinfo=datetime.UTC).timestamp())
    assert got == [utc + 7 * 3600, utc, None, None]


def test_dump_date(spark):
    names = ["catalogue_20250601_artists.xml.gz", "artists.xml.gz", "a_2025_x.xml", "a_20251399_x"]
    assert values(spark, names, fn.dump_date("x")) == [datetime.date(2025, 6, 1), None, None, None]


def test_numbers(spark):
    texts = ["12", " 12 ", "+5", "x", "1.5", "", None, "99999999999"]
    assert values(spark, texts, fn.safe_long("x")) == [
        12, 12, 5, None, None, None, None, 99999999999
    ]
    assert values(spark, texts, fn.safe_int("x"))[-1] is None
    assert values(spark, ["1987", "1987x", "x", "", None, " -3a"], fn.leading_int("x")) == [
        1987, 1987, 0, 0, None, -3
    ]


def test_text(spark):
    assert values(spark, [" a\n", "　", "", None], fn.clean_text("x")) == ["a", None, None, None]
    assert values(spark, ["ABCÄ", "z"], fn.ascii_lower("x")) == ["abcÄ", "z"]


@pytest.mark.parametrize(
    "text, needle, found",
    [("The Band", "the b", True), ("Ä", "ä", False), ("abc", "a_c", True), ("a%c", "%", True),
     ("a\\b", "\\b", True), ("ab", "\\b", False)],
)
def test_contains_ci(spark, text, needle, found):
    assert values(spark, [text], fn.contains_ci("x", needle)) == [found]


def test_json_list(spark):
    cases = {
        '["a","b"]': ["a", "b"], '["a"': None, "not": None, "[]": [], '"s"': ["s"],
        '[1,null]': ["1", None], None: None,
    }
    assert values(spark, list(cases), fn.json_list("x")) == list(cases.values())
    assert sorted(values(spark, ['{"k":"v","l":2}'], fn.json_list("x"))[0]) == ["2", "v"]
    assert values(spark, ['["a"', "{}"], fn.is_valid_json("x")) == [False, True]


def test_reference_id(spark):
    cases = {"5": 5, '{"text":"7"}': 7, '{"value":8}': 8, '{"text":"","value":"9"}': 9, "0": None,
             "x": None, '{"other":1}': None, None: None}
    assert values(spark, list(cases), fn.reference_id("x")) == list(cases.values())
