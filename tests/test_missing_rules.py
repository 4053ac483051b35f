"""One test per rule in which plain Spark would give another answer."""

import math

import pytest
from pyspark.sql import functions as F

from granary import functions as fn
from granary.functions.missing import known
from granary.operators import aggregate, columns, joins, sets, windows

INF = float("inf")


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.fixture(scope="module")
def texts(frame):
    return frame([(1, "a b c"), (2, None), (3, "x.y")], "i int, s string").orderBy("i")


def test_replace_first_replaces_one_match(frame):
    df = frame([("a_b_c",), ("none",), (None,), ("l1\nx_y_z",)], "s string")
    assert values(df, fn.replace_first("s", "_", " ")) == ["a b_c", "none", None, "l1\nx y_z"]
    assert values(df, fn.replace_first("s", "_", "$1")) == ["a$1b_c", "none", None, "l1\nx$1y_z"]


def test_replace_first_with_groups_alternatives_and_anchors(frame):
    df = frame([("catdog",), ("dogcat",)], "s string")
    assert values(df, fn.replace_first("s", "(cat|dog)", "")) == ["dog", "cat"]
    assert values(df, fn.replace_first("s", "cat$", "!")) == ["catdog", "dog!"]


def test_n_distinct_counts_missing_as_a_value(frame):
    df = frame([(1,), (1,), (2,), (None,)], "x int")
    assert df.agg(fn.n_distinct_r("x"), fn.n_distinct_r("x", True)).first()[:] == (3, 2)
    assert df.where("x > 5").agg(fn.n_distinct_r("x")).first()[0] == 0


def test_sum_and_mean_are_missing_if_any_value_is(frame):
    df = frame([(1.0, 1.0), (None, 3.0)], "x double, y double")
    row = df.agg(fn.sum_r("x"), fn.sum_r("y"), fn.mean_r("x"), fn.mean_r("y"), fn.mean_r("x", True)).first()
    assert row[:] == (None, 4.0, None, 2.0, 1.0)


def test_sum_of_no_values_is_zero(frame):
    df = frame([(None,)], "x double")
    assert df.agg(fn.sum_r("x", na_rm=True)).first()[0] == 0
    assert df.where("false").agg(fn.sum_r("x")).first()[0] == 0


def test_max_of_no_values_is_missing(frame):
    out = aggregate.consolidate(frame([(1, None)], "k int, x double"), ["k"], {"x": "max"}, [])
    assert out.first()["x"] is None


def test_row_wise_bounds_keep_missing(frame):
    df = frame([(None, 1), (3, 2)], "a int, b int")
    assert values(df, fn.pmin("a", "b")) == [None, 2]
    assert values(df, fn.pmax("a", "b")) == [None, 3]
    assert values(df, fn.clamp("a", 0, 2)) == [None, 2]


def test_membership_is_never_missing(frame):
    df = frame([("a",), ("b",), (None,)], "s string")
    assert values(df, fn.is_in("s", ["a"])) == [True, False, False]
    assert values(df, fn.not_in("s", ["a"])) == [False, True, True]
    assert values(df, fn.is_in("s", ["a", None])) == [True, False, True]


def test_joins_match_missing_keys(frame):
    left = frame([(1, "a"), (2, None), (3, "z")], "i int, k string")
    right = frame([("a", 10), (None, 20)], "k string, v int")
    got = {r.i: r.v for r in joins.left_join_na(left, right, "k").collect()}
    assert got == {1: 10, 2: 20, 3: None}
    assert [r.i for r in joins.anti_join(left, right, "k").collect()] == [3]
    assert sorted(r.i for r in joins.semi_join(left, right, "k").collect()) == [1, 2]


def test_paste_spells_missing_as_text(texts):
    assert values(texts, fn.paste("s", "i", sep="-")) == ["a b c-1", "NA-2", "x.y-3"]
    assert values(texts, fn.paste("s", "i", sep="-", na=None)) == ["a b c-1", None, "x.y-3"]


def test_listed_texts_skip_missing_keep_order_and_may_be_empty(frame):
    df = frame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)], "k int, o int, s string")
    got = {r.k: r.t for r in df.groupBy("k").agg(aggregate.listed("s", " / ", ["o"]).alias("t")).collect()}
    assert got == {1: "a / b", 2: ""}
    got = aggregate.consolidate(df, ["k"], {"s": "list: / "}, ["o"]).collect()
    assert {r.k: r.s for r in got} == {1: "a / b", 2: ""}


def test_if_else_of_unknown_is_missing(frame):
    df = frame([(1,), (9,), (None,)], "x int")
    assert values(df, fn.if_else(F.col("x") > 5, F.lit("hi"), F.lit("lo"))) == ["lo", "hi", None]


def test_ratio_by_zero(frame):
    df = frame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, 4.0)], "x double, y double")
    got = values(df, fn.ratio("x", "y"))
    assert got[:2] == [INF, -INF] and math.isnan(got[2]) and got[3:] == [None, 0.25]
    assert values(df, known(fn.ratio("x", "y")) > 1) == [True, False, None, None, False]


def test_text_that_is_no_number_is_missing(frame):
    assert values(frame([("1.5",), ("no data",), (None,)], "s string"), fn.to_number("s")) == [1.5, None, None]


def test_top_k_with_and_without_ties(frame):
    df = frame([("a", 3), ("b", 2), ("c", 2), ("d", 2), ("e", 1)], "n string, v int").withColumn("g", F.lit(1))
    assert sorted(r.n for r in windows.top_k_ties(df, ["g"], "-v", 2).collect()) == ["a", "b", "c", "d"]
    assert [r.n for r in windows.top_k(df, ["g"], ["-v", "n"], 2).collect()] == ["a", "b"]


def test_missing_sorts_last_in_both_directions(frame):
    df = frame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in df.orderBy(*windows.ordering(["x"])).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(*windows.ordering(["-x"])).collect()] == [2, 1, None]


def test_round_half_to_even(frame):
    assert values(frame([(0.5,), (1.5,), (2.5,)], "x double"), fn.half_even("x")) == [0.0, 2.0, 2.0]


def test_extract_is_missing_without_a_match_and_knows_unicode_letters(frame):
    df = frame([("Tract 1, Doña Ana",), ("12",)], "s string")
    assert values(df, fn.extract("s", "[[:alpha:] ]+$")) == [" Doña Ana", None]
    assert values(df, fn.extract("s", "[[:digit:]]+")) == ["1", "12"]


def test_first_row_per_key(frame):
    df = frame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "k int, o int, s string")
    assert {r.k: r.s for r in sets.first_per_key(df, ["k"], ["o"]).collect()} == {1: "early", 2: "only"}


def test_selectors_ignore_case(frame):
    df = frame([(1, 2, 3)], "RISK_x int, risk_y int, other int")
    assert columns.cols(df, starts_with="risk") == ["RISK_x", "risk_y"]
    assert columns.cols(df, starts_with="risk", ignore_case=False) == ["risk_y"]
    with pytest.raises(KeyError):
        columns.cols(df, all_of=["absent"])


def test_month_windows_clip_to_the_month_end(frame):
    df = frame([("2023-02-27",), ("2023-02-28",)], "d string").select(F.to_date("d").alias("d"))
    start = F.lit("2023-01-31").cast("date")
    assert values(df, fn.in_months_after("d", start, 1)) == [True, False]
    assert values(df, fn.in_months_after("d", F.lit(None).cast("date"), 1)) == [None, None]


def test_inclusive_months(frame):
    df = frame([("2022-01-01", "2023-05-01")], "a string, b string")
    assert values(df, fn.inclusive_months(F.to_date("a"), F.to_date("b"))) == [17]


def test_totals_add_up_the_summary(frame):
    df = frame([("FL", 2, 1.5), ("SC", 3, None)], "state string, n int, x double")
    total = aggregate.add_totals_row(df, "state").where("state = 'Total'").first()
    assert (total.n, total.x) == (5, 1.5)


def test_unknown_comparisons_count_as_no(frame):
    df = frame([(17.0, None), (40.0, 12.0)], "age_a double, age_b double")
    assert values(df, fn.row_count_if(["age_a", "age_b"], lambda c: c < 18)) == [1, 1]


def test_filters_drop_unknown(frame):
    df = frame([("13",), ("1",), (None,)], "region string")
    assert [r.region for r in df.where(F.col("region") != "13").collect()] == ["1"]


def test_yes_no(frame):
    df = frame([("Yes",), ("No",), (None,), ("maybe",)], "s string")
    assert values(df, fn.yes_no("s")) == [True, False, None, None]
    assert values(df, fn.yes_no("s", missing=True)) == [True, False, True, None]


def test_distinct_if_can_count_the_others_as_one(frame):
    df = frame([("a", True), ("b", False), ("c", True)], "id string, f boolean")
    row = df.agg(aggregate.distinct_if(F.col("f"), "id"), aggregate.distinct_if(F.col("f"), "id", na_rm=False)).first()
    assert row[:] == (2, 3)


def test_histogram_bins_are_centred_and_right_closed(frame):
    df = frame([(0.5,), (0.50001,), (1.5,), (float("nan"),), (INF,), (None,)], "x double")
    assert {r.bin: r.n for r in aggregate.histogram(df, "x", 1.0).collect()} == {0.0: 1, 1.0: 2}


def test_clean_names():
    names = ["Grant Number", "ZIP+4", "% Funded", "grantNumber", "2nd Year"]
    assert [columns.clean_name(n) for n in names] == ["grant_number", "zip_4", "percent_funded", "grant_number", "x2nd_year"]
