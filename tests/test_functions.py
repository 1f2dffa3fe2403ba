"""Hand-made edge cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from stagelens.functions import conditions as C
from stagelens.functions import numeric as N
from stagelens.functions import text as X


def value(spark, expr, schema="a string, b string", row=(None, None)):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, names", [
    ("박지훈(배역), 김준태 등, , 이하나 외", ["박지훈", "김준태", "이하나"]),
    ("A B , C　등　", ["A B", "C"]),
    ("등", []),
    ("", []),
    (None, []),
    ("가(x)(y) 外,나", ["가", "나"]),
])
def test_split_names(spark, cell, names):
    assert value(spark, X.split_names("a"), row=(cell, None)) == names


def test_split_names_variants(spark):
    assert value(spark, X.split_names_legacy("a"), row=("박지훈, 김준태 등", None)) == ["박지훈", "김준태등"]
    assert value(spark, X.split_names("a"), row=("가 외 등", None)) == ["가 외"]
    assert value(spark, X.split_names("a", passes=2), row=("가 외 등", None)) == ["가"]


def test_labels_and_pairs(spark):
    assert value(spark, X.norm_genre("a"), row=("서양음악 (클래식)", None)) == "서양음악"
    assert value(spark, X.norm_genre("a")) is None
    for row in (("뮤지컬", "연극"), ("연극", "뮤지컬")):
        assert value(spark, X.pair_key("a", "b"), row=row) == "뮤지컬+연극"
    assert value(spark, X.pair_key("a", "b"), row=("연극", None)) is None
    assert value(spark, X.pair_side("a", 1), row=("x+y", None)) == "y"
    assert value(spark, X.genre_prefix("a"), row=("무용(x)", None)) == "무용"


def test_org_roles(spark):
    assert value(spark, X.org_name("a"), row=(" 극단(가) (주최) ", None)) == "극단(가)"
    assert value(spark, X.org_role("a"), row=("극단(가) (주최) ", None)) == "주최"
    assert value(spark, X.org_role("a"), row=("극단", None)) == "미상"
    assert value(spark, X.org_role("a"), row=("극단()", None)) == "미상"


def test_missing(spark):
    for text, gone in ((None, True), (" \t　", True), ("x", False)):
        assert value(spark, X.is_missing("a"), row=(text, None)) is gone


@pytest.mark.parametrize("seats, size, strict", [
    (300, "small", "medium"), (299, "small", "small"), (301, "medium", "medium"),
    (1000, "medium", "large"), (1001, "large", "large"), (None, "large", "large"),
])
def test_venue(spark, seats, size, strict):
    df = spark.createDataFrame([(seats,)], "s int")
    row = df.select(C.venue_size("s").alias("a"), C.venue_size("s", inclusive=False).alias("b")).first()
    assert tuple(row) == (size, strict)


def test_free_rules(spark):
    df = spark.createDataFrame([(None, 10.0), (0.0, 0.0), (5.0, -1.0), (5.0, 5.0)], "p double, r double")
    rows = df.select(*[C.is_free("p", "r", k).alias(k) for k in ("any_or_missing", "any_known", "both_zero")]).collect()
    assert [tuple(r) for r in rows] == [
        (True, False, False), (True, True, True), (True, True, False), (False, False, False)]


def test_conditions(spark):
    assert value(spark, C.not_equal_keep_null("a", "x")) is True
    assert value(spark, C.contains("a", "x")) is False
    assert value(spark, C.segment("a"), row=("TRUE", None)) == "Free"
    assert value(spark, C.parse_bool("a"), row=("Y", None)) is True
    assert value(spark, C.parse_bool("a"), row=("?", None)) is None
    assert value(spark, C.parse_number("a"), row=("1x", None)) is None
    assert value(spark, C.map_values("a", {"x": "y"}), row=("x", None)) == "y"
    flags = spark.createDataFrame([(True, None), (True, True)], "a boolean, b boolean")
    assert [r[0] for r in flags.select(C.count_true("a", "b")).collect()] == [None, 2]


def test_pick_and_assert(spark):
    df = spark.createDataFrame([(1, None)], "` a ` int, b string")
    assert C.pick_existing(df, ["a", "c"], add_missing=True).first().asDict() == {"a": 1, "c": ""}
    with pytest.raises(ValueError):
        C.assert_columns(df, ["b"])
    with pytest.raises(ValueError):
        C.assert_columns(df, ["zz"])


def test_numbers(spark):
    df = spark.createDataFrame([(None,), (0.5,), (9.0,)], "v double")
    assert [r[0] for r in df.select(N.clip("v", 1.0, 3.0)).collect()] == [None, 1.0, 3.0]
    assert [r[0] for r in df.select(N.log1p_count("v")).collect()][0] == 0.0
    assert [r[0] for r in df.select(N.geo_score([F.col("v"), F.lit(0.5)], (0.6, 0.4))).collect()][:2] == [None, pytest.approx(50)]
    cv = N.coefficient_of_variation(N.ratio_list("a"))
    assert value(spark, cv, row=("[0.5, 1.5, x]", None)) == pytest.approx(0.5)
    assert value(spark, cv) is None
    lo, hi, mean = N.row_extremes([F.lit(None).cast("double"), F.lit(2.0), F.lit(4.0)])
    assert (value(spark, lo), value(spark, hi), value(spark, mean)) == (2.0, 4.0, 3.0)
