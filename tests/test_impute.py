import pytest
from pyspark.sql import functions as F

from lociflow.operators.impute import Categorical, Level, Numeric, fill_missing

SCHEMA = "id bigint, grp string, site string, v double, c string, note string"
LEVELS = [Level("own", {"grp": "grp"}), Level("site", {"site": "site"}, 2), Level("all", {}, 1)]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = fill_missing(df, [Numeric("v", 0, 10, 0.5), Categorical("c", ("na",))], LEVELS)
    return {r.id: r for r in out.collect()}


def test_levels_back_off_and_flags_are_stored(spark):
    got = run(spark, [
        (1, "a", "s", 2.0, "x", None), (2, "a", "s", 4.0, "y", None), (3, "a", "s", None, "NA", "n"),
        (4, "b", "s", 99.0, " ", None), (5, None, None, float("nan"), None, None),
    ])
    assert (got[3].v_filled, got[3].v_fill_level, got[3].v_fill_support, got[3].v_was_missing) == (3.0, "own", 2, True)
    assert (got[3].c_filled, got[3].c_fill_level) == ("x", "own")  # tie: the smallest
    assert (got[4].v_filled, got[4].v_fill_level) == (3.0, "site")
    assert (got[5].v_filled, got[5].v_fill_level) == (3.0, "all")
    assert got[1].v_filled == 2.0 and not got[1].v_was_missing and got[1].v_fill_level is None
    assert got[3].note == "n"


def test_support_too_small_goes_on_to_the_next_level(spark):
    got = run(spark, [(1, "a", "s", 2.0, "x", None), (2, "b", "s", None, "x", None)])
    assert got[2].v_fill_level == "all"


def test_identical_rows_count_once_and_differing_ones_stay(spark):
    got = run(spark, [(1, "a", "s", 1.0, "x", None)] * 3 + [(2, "a", "s", 4.0, "x", None), (3, "a", "s", None, "x", None)])
    assert got[3].v_filled == 2.5 and len(got) == 3


def test_empty_and_nothing_to_fill_from(spark):
    assert run(spark, []) == {}
    got = run(spark, [(1, None, None, None, None, None)])
    assert got[1].v_filled is None and got[1].v_was_missing and got[1].v_fill_level is None


def test_clashing_names_are_refused_and_extra_columns_pass(spark):
    df = spark.createDataFrame([(1, "a", "s", 1.0, "x", None)], SCHEMA)
    with pytest.raises(ValueError):
        fill_missing(df.withColumn("v_filled", F.lit(1)), [Numeric("v", 0, 10)], LEVELS)
    out = fill_missing(df.withColumns({"_v": F.lit(7), "_n": F.lit(8), "m": F.create_map(F.lit("k"), F.lit("e"))}), [Numeric("v", 0, 10)], LEVELS).first()
    assert (out._v, out._n, out.m) == (7, 8, {"k": "e"})


def test_a_hot_group_gives_the_exact_median(spark):
    df = spark.range(30_000).select("id", F.lit("hot").alias("grp"), F.lit("s").alias("site"), F.when(F.col("id") % 100 > 0, (F.col("id") % 21) / 2).alias("v"), F.lit("c").alias("c"), F.lit(None).cast("string").alias("note"))
    out = fill_missing(df, [Numeric("v", 0, 10, 0.5)], LEVELS)
    assert [tuple(r) for r in out.where("v_was_missing").groupBy("v_filled", "v_fill_level").count().collect()] == [(5.0, "own", 300)]
