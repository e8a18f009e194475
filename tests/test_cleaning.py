import pytest
from pyspark.sql import functions as F

from attesta.functions import cleaning as clean
from attesta.operators.serving import in_place


def _column(spark, values, expr, ddl="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {ddl}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "value, want",
    [("12", 12), (" 12 ", 12), ("12.0", None), ("1e3", None), ("", None), (None, None), ("-4", -4)],
)
def test_safe_int(spark, value, want):
    assert _column(spark, [value], clean.safe_int) == [want]


def test_json_arrays(spark):
    texts = ['["a","b","a"]', '["a",null,null]', '["a",1]', '{"a":1}', '"a"', '["a"', "", None, "[]"]
    want = [["a", "b"], ["a", None], ["a", "1"], None, None, None, None, None, []]
    assert _column(spark, texts, clean.parse_json_array) == want


def test_names_and_categories(spark):
    assert _column(spark, ["  tamil   nadu ", "St-john\tx", None], clean.normalize_name) == [
        "Tamil Nadu", "St-john X", None]
    assert _column(spark, ["  Clinic ", "   ", None], clean.clean_category) == ["clinic", None, None]


def test_bbox_is_three_valued_and_inclusive(spark):
    points = [(6.0, 68.0), (37.0, 98.0), (5.9, 70.0), (20.0, 98.1), (None, 70.0), (None, 10.0), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, b double")
    got = df.select("i", clean.in_bbox(F.col("a"), F.col("b")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, True, False, False, None, False, None]


def test_sentinel_and_flags(spark):
    assert _column(spark, ["NA", "1.5", "x", None], clean.sentinel_double) == [None, 1.5, None, None]
    assert _column(spark, ["TRUE", "true", "1", None], clean.text_bool) == [True, True, False, None]


def test_display_names(spark):
    names = {
        "SCB MEDICAL COLLEGE AND HOSPITAL": "SCB Medical College and Hospital",
        "the eye-care centre of pune": "The Eye-Care Centre of Pune",
        "a&b clinic (icu)": "a&b Clinic ICU",
        "24x7 'quoted' tmh.": "24x7 'quoted' TMH",
        "  ": "",
        None: "",
    }
    assert _column(spark, list(names), clean.display_name) == list(names.values())


def test_top_urls(spark):
    urls = [["a", "", "b", "a", None, "c"], [str(i % 15) for i in range(40)], [], None]
    got = _column(spark, urls, clean.top_urls, "array<string>")
    assert got == [["a", "b", "c"], [str(i) for i in range(10)], [], None]


def test_prefix_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("100%x", "a"), ("100 x", "b"), ("c_d", None), ("cxd", None)], "state string, city string")
    found = lambda q: [r.state for r in in_place(df, q).collect()]
    assert found("100%") == ["100%x"]
    assert found("C_") == ["c_d"]
    assert found(" B ") == ["100 x"]
    assert len(found("")) == 4
