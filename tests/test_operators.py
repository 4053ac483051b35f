"""Operators against brute force on small tables, hot groups included."""

import hashlib
import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import (
    aggregate,
    checks,
    columns,
    enrich,
    geometry,
    joins,
    linkage,
    network,
    quantiles,
    reshape,
    sampling,
    survey,
    topics,
    windows,
)

SMALL = 40  # rows of a slice, so that groups lie in many


@pytest.fixture(scope="module")
def skewed(frame):
    """One key holds most rows; values come in no order."""
    rng = random.Random(7)
    rows = [(1 if i % 3 else 2 + i % 5, i, rng.choice([None, None, f"v{i}"])) for i in range(400)]
    rng.shuffle(rows)
    return frame(rows, "k int, o int, s string").repartition(5)


def test_numbering_of_large_groups_equals_the_plain_window(skewed):
    plain = windows.number_rows(skewed, ["k"], ["o"], "n")
    sliced = windows.number_rows(skewed, ["k"], ["o"], "n", slice_rows=SMALL)
    assert {(r.k, r.o): r.n for r in plain.collect()} == {(r.k, r.o): r.n for r in sliced.collect()}


def test_numbering_of_a_whole_table_in_descending_order(skewed):
    got = {r.o: int(r.pk) for r in windows.row_key(skewed, ["-o"]).collect()}
    assert got == {o: 400 - o for o in range(400)}


def test_fill_down_of_large_groups_equals_the_plain_window(skewed):
    plain = windows.fill_down(skewed, ["k"], ["o"], ["s"])
    sliced = windows.fill_down(skewed, ["k"], ["o"], ["s"], slice_rows=SMALL)
    assert {(r.k, r.o): r.s for r in plain.collect()} == {(r.k, r.o): r.s for r in sliced.collect()}
    whole = windows.fill_down(skewed, [], ["o"], ["s"], slice_rows=SMALL).orderBy("o").collect()
    last = None
    by_order = {r.o: r.s for r in skewed.collect()}
    for row in whole:
        last = by_order[row.o] or last
        assert row.s == last


def test_slices_are_cut_in_any_order(frame):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.5]), f"{i:03d}", i) for i in range(500)]
    df = frame(rows, "g string, x double, s string, i int")
    sliced, cut = windows._sliced(df, ["g"], ["-x", "s"], 30)
    assert 8 <= sliced.select("_slice").distinct().count() <= 40 and cut.count() == 3
    got = {r.i: r.n for r in windows.number_rows(df, ["g"], ["-x", "s"], "n", 30).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[3]: k for k, r in enumerate(own, 1)}
    assert got == want
    assert windows.number_rows(df.where("i < 0"), ["g"], ["s"], "n").collect() == []


def test_first_k_by_column(skewed):
    sized = skewed.withColumn("k_rows", F.col("k").cast("long"))
    got = windows.first_k_by_column(sized, ["k"], ["o"], "k_rows", at_most=100).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {k: k for k in range(1, 7)}
    with pytest.raises(Exception, match="is above 2"):
        windows.first_k_by_column(sized, ["k"], ["o"], "k_rows", at_most=2).collect()


@pytest.mark.parametrize("most", [20, 50_000])
@pytest.mark.parametrize("spread", [1_000_000, 12])
def test_quantiles_are_exact_with_narrow_and_wide_brackets(frame, most, spread):
    rng = random.Random(spread)
    rows = [("hot" if i % 4 else "cold", float(rng.randrange(spread))) for i in range(3000)]
    rows += [("one", 5.0), ("none", None), ("nan", float("nan")), ("nan", 2.0)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.exact_quantiles(frame(rows, "g string, x double"), ["g"], "x", probs, most).collect()
    found = {(r.g, r.q): r.x for r in got}
    for g in ("hot", "cold", "one", "nan"):
        xs = [x for h, x in rows if h == g and x is not None and not math.isnan(x)]
        for q in probs:
            assert found[g, q] == pytest.approx(np.quantile(xs, q))
    assert not any(g == "none" for g, _ in found)


def test_quantiles_of_a_group_far_above_the_bound(spark, monkeypatch):
    rows = spark.range(300_000).select((F.col("id") % 10 == 0).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("x"))
    table = rows.toPandas()
    met = []
    monkeypatch.setattr(quantiles, "_interpolated", lambda counts, by, keep=quantiles._interpolated: met.append(counts) or keep(counts, by))
    got = {(r.g, r.q): r.x for r in quantiles.exact_quantiles(rows, ["g"], "x", [0.0, 0.3, 0.5, 0.99, 1.0], most=500).collect()}
    for (g, q), x in got.items():
        assert x == pytest.approx(np.quantile(table.x[table.g == g], q), rel=1e-12)
    assert len(got) == 10
    assert met[0].groupBy("g", "q").count().agg(F.max("count")).first()[0] <= 502


def test_quantiles_of_a_whole_table_and_of_several_columns(frame):
    df = frame([(1.0, 10.0), (2.0, None), (3.0, 30.0), (10.0, 50.0)], "x double, y double")
    assert quantiles.exact_quantiles(df, [], "x", [0.75]).first()[:] == (0.75, 4.75)
    wide = quantiles.group_quantiles(df, [], {"a": ("x", 0.5), "b": ("y", 0.5)}).first()
    assert (wide.a, wide.b) == (2.5, 30.0)


def test_quantiles_keep_missing_groups(frame):
    df = frame([(None, 1.0), (None, 3.0), ("a", None)], "g string, x double")
    got = {r.g: r.m for r in quantiles.group_quantiles(df, ["g"], {"m": ("x", 0.5)}).collect()}
    assert got == {None: 2.0, "a": None}


def test_numeric_summary(frame):
    row = aggregate.numeric_summary(frame([(1.0,), (2.0,), (None,), (6.0,)], "x double"), "x").first()
    assert (row["min"], row.q1, row.median, row["mean"], row.q3, row["max"], row.n_missing) == (1, 1.5, 2, 3, 4, 6, 1)


@pytest.mark.parametrize("block", [2, 512])
@pytest.mark.parametrize("text", [False, True])
def test_cooccurrence_equals_brute_force(frame, block, text):
    rng = random.Random(3)
    pairs = {(rng.randrange(12), rng.randrange(40)) for _ in range(150)} | {(i, 99) for i in range(12)}
    name = (lambda i: f"item {i:02d}") if text else (lambda i: i)
    rows = [(name(i), v) for i, v in pairs] * 2 + [(None, 1), (name(0), None)]
    edges = network.cooccurrence(frame(rows, f"item {'string' if text else 'int'}, via int"), block=block)
    want = {}
    for (a, v), (b, w) in itertools.product(pairs, pairs):
        if v == w and a < b:
            want[name(a), name(b)] = want.get((name(a), name(b)), 0) + 1
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == want


def test_network_parts(frame):
    edges = frame([("a", "b", 5), ("a", "c", 1), ("b", "c", 1)], "src string, dst string, weight long")
    nodes = frame([("a",), ("b",), ("c",), ("d",)], "name string")
    heavy = network.heavy_edges(edges, 0.95)
    assert [(r.src, r.dst) for r in heavy.collect()] == [("a", "b")]
    assert [r.name for r in network.isolated_nodes(nodes, edges).collect()] == ["d"]
    assert sorted(r.name for r in network.connected_nodes(nodes, heavy).collect()) == ["a", "b"]


def test_names_are_those_of_the_first_row_and_equal_names_merge(frame):
    rows = [(1, "Old", "x", "X", 1), (1, "New", "y", "Y", 2), (2, "Old", "y", "Other", 3), (3, "Lone", None, None, 4)]
    df = frame(rows, "p int, title string, r string, rname string, o int")
    pairs = network.named_pairs(df, "p", "title", "r", "rname", ["o"])
    assert sorted(r[:] for r in network.incidence(pairs).collect()) == [("Old", "X"), ("Old", "Y")]
    assert sorted(r.name for r in network.nodes_of(pairs).collect()) == ["Lone", "Old"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.6, 0.34, 0.05])
def test_similar_pairs_equal_brute_force(frame, threshold):
    rng = random.Random(11)
    def word():
        return "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 9)))
    left = {(rng.choice("xy"), word()) for _ in range(40)}
    right = {(rng.choice("xy"), word()) for _ in range(40)}
    want = {
        (k, a, b)
        for (k, a), (m, b) in itertools.product(left, right)
        if k == m and 1 - distance(a, b) / max(len(a), len(b)) >= threshold - 1e-12
    }
    got = linkage.similar_pairs(
        frame(sorted(left), "block string, a string"), frame(sorted(right), "block string, b string"), threshold
    )
    assert {(r.block, r.a, r.b) for r in got.collect()} == want


def test_link_prefers_the_exact_field_and_searches_elsewhere_only_without_it(frame):
    left = frame(
        [("l1", "cherokee nation", "EMI"), ("l2", "cherokee nation", "ERE"), ("l3", "zuni pueblo", "EMI"), ("l4", None, "EMI")],
        "lk string, name string, program string",
    )
    right = frame(
        [("r1", "cherokee nations", "EMI"), ("r2", "cherokee nation", "SEDS"), ("r3", "cherokee nation", "SEDS"), ("r4", "other", None)],
        "rk string, name string, program string",
    )
    got = {r.lk: r for r in linkage.link(left, right, "name", "program", "lk", "rk").collect()}
    assert got["l1"].rk == "r1" and got["l1"].is_exact_equal and got["l1"].similarity == pytest.approx(15 / 16)
    assert got["l1"].score == pytest.approx(0.25 * 15 / 16 + 0.75)
    # no ERE on the right: found among the others, ties to the smallest key
    assert got["l2"].rk == "r2" and not got["l2"].is_exact_equal and got["l2"].score == pytest.approx(0.25)
    # a weak partner is still a partner; without a text there is none
    assert got["l3"].rk == "r1" and got["l3"].similarity < 0.5 and got["l4"].rk is None and len(got) == 4


def test_every_row_gets_its_best_partner(frame):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    left, right = ([(f"{side}{i:02d}", word(), rng.choice("xy")) for i in range(25)] for side in "lr")
    got = linkage.link(frame(left, "lk string, name string, kind string"), frame(right, "rk string, name string, kind string"), "name", "kind", "lk", "rk").collect()
    want = {}
    for key, a, kind in left:
        ranked = [(-(1 - distance(a, b) / max(len(a), len(b))), b, rk) for rk, b, other in right if other == kind]
        want[key] = min(ranked)
    assert {r.lk: (r.rk, round(r.similarity, 9)) for r in got} == {k: (rk, round(-s, 9)) for k, (s, _, rk) in want.items()}


def test_threshold_zeroes_weak_amounts(frame):
    df = frame([(0.8, 5.0), (0.5, 6.0), (None, None)], "similarity double, amount double")
    got = [(r.amount, r.is_weak) for r in linkage.apply_threshold(df, "amount").collect()]
    assert got == [(5.0, False), (0.0, True), (0.0, True)]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


@pytest.fixture(scope="module")
def polygons(frame):
    notch = [ring((0, 0), (10, 0), (10, 10), (5, 5), (0, 10)), ring((1, 1), (3, 1), (3, 3), (1, 3))]
    rows = [("notch", notch), ("pair", [ring((20, 0), (24, 0), (22, 4), (20, 0))]), ("pair", [ring((30, 0), (34, 0), (32, 4))])]
    rows += [("over", [ring((8, 0), (21, 0), (21, 2), (8, 2))])]
    return geometry.read_polygons(frame(rows, "id string, shape " + geometry.RINGS), "id", "shape")


@pytest.mark.parametrize("most", [1, 3, 32])
def test_points_strictly_within(frame, polygons, monkeypatch, most):
    monkeypatch.setattr(geometry.polygon_cells, "__defaults__", (most,))
    points = [
        (1, 5.0, 2.0, {"notch"}),
        (2, 2.0, 2.0, {None}),  # in the hole
        (3, 5.0, 7.0, {None}),  # in the notch
        (4, 0.0, 5.0, {None}),  # on a side
        (5, 10.0, 10.0, {None}),  # on a corner
        (6, 9.0, 1.0, {"notch", "over"}),
        (7, 22.0, 1.0, {"pair"}),
        (8, 32.0, 1.0, {"pair"}),
        (9, 27.0, 1.0, {None}),
        (10, -3.0, -3.0, {None}),
        (11, 1.0, 2.0, {None}),  # on the hole's side
        (12, 20.5, 0.5, {"pair", "over"}),
    ]
    df = frame([p[:3] for p in points], "i int, x double, y double")
    got = {}
    for r in geometry.within_join(df, polygons, "id", "x", "y").collect():
        got.setdefault(r.i, []).append(r.id)
    assert {i: set(ids) for i, ids in got.items()} == {p[0]: p[3] for p in points}
    assert all(len(ids) == len(set(ids)) for ids in got.values())


def even_odd(rings, x, y):
    """Strictly inside, by exact fractions."""
    odd, x, y = False, Fraction(x), Fraction(y)
    for r in rings:
        for p, q in zip(r, r[1:] + r[:1]):
            x1, y1, x2, y2 = map(Fraction, (p["x"], p["y"], q["x"], q["y"]))
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return odd


@pytest.mark.parametrize("most", [1, 4, 32])
def test_random_polygons_against_brute_force(frame, monkeypatch, most):
    monkeypatch.setattr(geometry.polygon_cells, "__defaults__", (most,))
    rng = random.Random(most)
    shapes = []
    for k in range(12):  # crossing sides, holes, whole numbers so that points lie on sides and corners
        size = rng.choice([2, 6, 40])
        dot = lambda: (rng.randrange(-size, size), rng.randrange(-size, size))  # noqa: B023, E731
        shapes.append((f"s{k % 9}", [ring(*(dot() for _ in range(rng.randrange(3, 9)))) for _ in range(rng.randrange(1, 3))]))
    dots = [(i, rng.randrange(-80, 80) / 2, rng.randrange(-80, 80) / 2) for i in range(300)] + [(900, None, 1.0), (901, 0.5, 0.5), (902, 0.5, 0.5)]
    table = geometry.read_polygons(frame(shapes, "id string, shape " + geometry.RINGS), "id", "shape")
    got = sorted((r.i, str(r.id)) for r in geometry.within_join(frame(dots, "i int, x double, y double"), table, "id", "x", "y").collect())
    want = []
    for i, x, y in dots:
        ids = {k for k, rings in shapes if x is not None and even_odd(rings, x, y)}
        want += [(i, k) for k in ids or {"None"}]
    assert got == sorted(want) and sum(k != "None" for _, k in got) > 50


def test_huge_polygon_has_few_cell_sides(frame):
    n = 40_000  # a coast of many sides round a wide land, among small squares
    coast = [(1000 * math.cos(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rows = [("land", [ring(*coast)])] + [(f"q{k}", [ring((k, 0), (k + 1, 0), (k + 1, 1), (k, 1))]) for k in range(50)]
    table = geometry.read_polygons(frame(rows, "id string, shape " + geometry.RINGS), "id", "shape")
    cells = geometry.polygon_cells(table, "id").select("id", F.size("cell.sides").alias("n")).groupBy("id").agg(F.count("n").alias("cells"), F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    land = next(r for r in cells if r.id == "land")
    assert land.n < 4 * n and land.cells < n and land.most <= geometry.SIDES
    assert all(r.n <= 16 for r in cells if r.id != "land")
    dots = frame([(1, 0.5, 0.5), (2, 700.0, 700.0), (3, 990.0, 400.0), (4, 3.5, 0.5)], "i int, x double, y double")
    got = {(r.i, r.id) for r in geometry.within_join(dots, table, "id", "x", "y").collect()}
    assert got == {(1, "land"), (1, "q0"), (2, "land"), (3, None), (4, "land"), (4, "q3")}


def test_web_mercator(frame):
    lon, lat = geometry.to_wgs84("x", "y")
    row = frame([(111319.49079327357, 111325.1428663851)], "x double, y double").select(lon, lat).first()
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(1.0)


def test_survey_totals_closed_form(frame):
    reps = [f"repwtp{i}" for i in range(1, 81)]
    rows = [("a", 10.0, *[10.0 + (i % 2) for i in range(80)]), ("a", 5.0, *[5.0] * 80), ("b", 0.0, *[0.0] * 80)]
    df = frame(rows, "g string, perwt double, " + ", ".join(f"{r} double" for r in reps))
    got = {r.g: r for r in survey.with_moe(survey.survey_total(df, ["g"], survey.Design("perwt", tuple(reps)))).collect()}
    assert (got["a"].estimate, got["a"].n) == (15.0, 2)
    assert got["a"].estimate_se == pytest.approx(math.sqrt(4 / 80 * 40))
    assert got["a"].estimate_moe == pytest.approx(1.645 * math.sqrt(2))
    assert math.isnan(got["b"].estimate_moe_rel)


def test_margin_shares_are_unknown_with_an_unknown_margin(frame):
    df = frame([(0.6,), (0.2,), (float("inf"),)], "m double")
    assert survey.moe_shares(df, "m", {"half": 0.5}).first().half == pytest.approx(2 / 3)
    worse = df.union(frame([(float("nan"),)], "m double"))
    assert survey.moe_shares(worse, "m", {"half": 0.5}).first().half is None


def test_margin_band(frame):
    df = frame([(0.1, 0.3), (0.9, 0.2), (0.0, 0.1), (None, 0.1)], "m double, e double")
    got = [r[:] for r in df.select(*[c.alias(n) for n, c in survey.margin_band("m", "e").items()]).collect()]
    assert got[0] == pytest.approx((0.0, 0.4, 3.0)) and got[1] == pytest.approx((0.7, 1.0, 0.2 / 0.9))
    assert got[2][2] is None and got[3] == (None, None, None)


def test_multi_row_header(frame):
    sheet = frame(
        [
            (1, None, "Jan 2022", None, None, None),
            (2, None, "HS", None, "EHS", None),
            (3, "Grant Number", "funded", "reported", "funded", "reported"),
            (4, "g1", "10", "9", None, "4"),
            (5, "g2", "20", None, "7", "7"),
        ],
        "row int, grant string, a string, b string, c string, d string",
    )
    got = reshape.tidy_multi_header(sheet, "row", 3, ["grant"], ["a", "b", "c", "d"], ["month", "program", "metric"], ["funded", "reported"])
    assert sorted((r.grant, r.month, r.program, r.funded, r.reported) for r in got.collect()) == [
        ("g1", "Jan 2022", "EHS", None, "4"),
        ("g1", "Jan 2022", "HS", "10", "9"),
        ("g2", "Jan 2022", "EHS", "7", "7"),
        ("g2", "Jan 2022", "HS", "20", None),
    ]


def test_two_columns_of_one_header_fail(frame):
    sheet = frame([(1, None, "Jan", None), (2, "id", "n", "n"), (3, "g", "1", "2")], "row int, id string, a string, b string")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        reshape.tidy_multi_header(sheet, "row", 2, ["id"], ["a", "b"], ["month", "metric"], ["n"]).collect()


def test_repeated_cells_are_reported_and_fail(frame):
    df = frame([(1, "a", 5), (1, "a", 6), (2, "b", 7)], "k int, n string, v int")
    assert [r[:] for r in reshape.repeated_cells(df, ["k"], "n").collect()] == [(1, "a", 2)]
    with pytest.raises(Exception, match="more than one v"):
        reshape.pivot_wider_unique(df, ["k"], "n", "v", ["a", "b"]).collect()


def test_split_columns_fails_on_another_count(frame):
    good = frame([("a,b",), (None,)], "s string")
    assert [r[:] for r in reshape.split_columns(good, "s", ["x", "y"], ",").collect()] == [("a", "b"), (None, None)]
    bad = frame([("a,b,c",)], "s string")
    assert reshape.wrong_part_count(bad, "s", ",", 2).count() == 1
    with pytest.raises(Exception, match="not 2 parts"):
        reshape.split_columns(bad, "s", ["x", "y"], ",").collect()


def test_join_checked(frame):
    one = frame([(1, "a"), (2, "b")], "k int, s string")
    many = frame([(1, 5), (1, 6)], "k int, v int")
    assert joins.join_checked(one, many, ["k"], "one-to-many").count() == 3
    with pytest.raises(Exception, match="repeated key on the right side of a one-to-one join"):
        joins.join_checked(one, many, ["k"], "one-to-one").collect()
    with pytest.raises(ValueError, match="both sides"):
        joins.left_join_na(one, one, ["k"])


def test_join_coalesce_by_priority(frame):
    left = frame([(1, None), (2, "l"), (3, None)], "k int, s string")
    right = frame([(1, "r", 7), (2, "r", 8)], "k int, s string, extra int")
    assert [r[:] for r in joins.join_coalesce(left, right, "k", ["s"]).orderBy("k").collect()] == [
        (1, "r", 7), (2, "l", 8), (3, None, None)
    ]
    assert [r.s for r in joins.join_coalesce(left, right, "k", ["s"], "right").orderBy("k").collect()] == ["r", "r", None]


def test_cascade_takes_all_values_from_the_first_source_that_answers(frame):
    df = frame([("a",), ("b",), ("c",)], "k string")
    first = frame([("a", 1.0, 2.0), ("b", None, 9.0)], "k string, lat double, lon double")
    second = frame([("b", 5.0, None), ("b", 5.0, None), ("a", 7.0, 7.0)], "k string, lat double, lon double")
    got = enrich.cascade_lookup(df, "k", ["lat", "lon"], [("osm", first), ("arcgis", second)])
    assert sorted(r[:] for r in got.collect()) == [("a", 1.0, 2.0, "osm"), ("b", 5.0, None, "arcgis"), ("c", None, None, None)]


def test_repair_keeps_every_row(frame):
    df = frame([("1", "T1", "AL"), ("2", None, "AL"), ("3", None, "PW"), ("4", None, "AL")], "id string, tract string, st string")
    fallback = frame([("2", "T2")], "id string, tract string")
    facts = frame([("T1", 10), ("T2", 20)], "tract string, risk int")
    got = enrich.repair_unmatched(df, "id", "tract", fallback, facts)
    assert sorted((r.id, r.tract, r.risk) for r in got.collect()) == [("1", "T1", 10), ("2", "T2", 20), ("3", None, None), ("4", None, None)]


def test_bands_and_codes(frame):
    df = frame([(200000,), (150000,), (150001,), (0,), (None,), (9999999,)], "x int")
    cuts = [(">=", 200000, "top"), (">", 150000, "upper"), (">", 0, "low")]
    got = [r[0] for r in df.select(columns.band("x", cuts, "none")).collect()]
    assert got == ["top", "low", "upper", "none", "none", "top"]
    got = [r[0] for r in df.select(columns.band("x", cuts, "none", [9999999])).collect()]
    assert got[-1] == "none"


def test_recode_keeps_other_values(frame):
    df = frame([("old", 1), ("same", 2), (None, 3)], "s string, i int")
    assert sorted(r[:] for r in columns.recode(df, "s", {"old": "new"}).where("i < 3").collect()) == [("new", 1), ("same", 2)]


def test_checks(frame):
    df = frame([(1, 1), (2, 3), (None, 4)], "a int, b int")
    assert checks.violations(df, F.col("a") == F.col("b")).count() == 2
    row = checks.control_total(df, F.sum("b"), df.where("a is not null"), F.sum("b")).first()
    assert row[:] == (8, 4, 4)
    assert checks.remove_ids(df, "a", [1]).count() == 2


def test_stratified_sample_is_proportional_and_reproducible(frame):
    rows = [(f"g{i}", "big" if i % 4 else "small") for i in range(400)] + [("n1", None)]
    df = frame(rows, "id string, region string")
    sample = sampling.stratified_sample(df, "region", "id", 40, seed=5)
    got = {r.region: r["count"] for r in sample.groupBy("region").count().collect()}
    assert got == {"big": 30, "small": 10, None: 1}
    again = sampling.stratified_sample(df.repartition(7), "region", "id", 40, seed=5)
    other = sampling.stratified_sample(df, "region", "id", 40, seed=6)
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(sample) == ids(again) != ids(other)
    balance = sampling.sample_balance(sample, sampling.strata_sizes(df, "region", 40), "region").collect()
    assert all(abs(r.pct_diff) < 0.05 for r in balance)


def test_share_within(frame):
    df = frame([("a", "x", 1), ("a", "y", 3), (None, "x", 5)], "g string, f string, n long")
    got = {(r.g, r.f): r.pct for r in windows.share_within(df, "n", "g").collect()}
    assert got == {("a", "x"): 0.25, ("a", "y"): 0.75, (None, "x"): 1.0}


def test_rank_by(frame):
    df = frame([("a", 5), ("b", 7), ("c", 7)], "k string, total int")
    ranked = windows.rank_by(df.select("k"), df, ["k"], ["-total"], name="place")
    assert {r.k: r.place for r in ranked.collect()} == {"a": 2, "b": 1, "c": 1}


def test_planted_topics_are_found(frame):
    rng = random.Random(12)
    planted = {"sea": ["boat", "tide", "sail", "reef", "gull", "mast"], "farm": ["plough", "barn", "hay", "goat", "field", "mill"]}
    rows = [(f"{kind}{i}", " ".join(rng.choices(words, k=25) + rng.choices(["day", "one"], k=3))) for kind, words in planted.items() for i in range(25)]
    cells = topics.document_terms(frame(rows, "id string, text string"), "id", "text")
    texts, terms = topics.fit_topics(cells, "id", [2], seed=3, rounds=12)
    shares = {r.id: r.w for r in texts.collect()}
    top = {kind: {max((0, 1), key=lambda t: shares[i][t]) for i in shares if i.startswith(kind)} for kind in planted}
    assert len(top["sea"]) == len(top["farm"]) == 1 and top["sea"] != top["farm"]
    weights = {r.term: r.w for r in terms.collect()}
    for kind, words in planted.items():
        (t,) = top[kind]
        assert sorted(weights, key=lambda w: -weights[w][t])[:6] == sorted(words, key=lambda w: -weights[w][t])


def _comments(frame):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(90)]
    rows = [(i % 60, " ".join(rng.choices(vocabulary, weights=range(1, 91), k=rng.randint(0, 40)))) for i in range(75)]
    return topics.document_terms(frame([*rows, (None, "w1 lonely"), (99, None)], "id int, text string"), "id", "text")


def _plain_fit(cells, k, seed, rounds):
    """The rounds of a topic model, cell by cell."""
    start = {t: [1 + int(hashlib.md5(f"{t}|{i}|{seed}".encode()).hexdigest()[:4], 16) / 65536 for i in range(1, k + 1)] for _, t, _ in cells}
    cells = [c for c in cells if c[0] is not None]
    theta = {d: [1 / k] * k for d, _, _ in cells}
    phi, total = start, [sum(w[i] for w in start.values()) for i in range(k)]
    for _ in range(rounds):
        texts, terms = {d: [0.0] * k for d in theta}, {t: [topics.ETA] * k for _, t, _ in cells}
        for d, t, n in cells:
            p = [phi[t][i] / total[i] * theta[d][i] for i in range(k)]
            for i in range(k):
                texts[d][i] += n * p[i] / sum(p)
                terms[t][i] += n * p[i] / sum(p)
        theta = {d: [(x + topics.ALPHA) / (sum(w) + k * topics.ALPHA) for x in w] for d, w in texts.items()}
        phi, total = terms, [sum(w[i] for w in terms.values()) for i in range(k)]
    return theta, {t: [w[i] / total[i] for i in range(k)] for t, w in phi.items()}


@pytest.mark.parametrize("held", [1 << 24, 300])
def test_topics_in_one_task_or_in_blocks(frame, monkeypatch, held):
    monkeypatch.setattr(topics, "CHUNK", 100)
    monkeypatch.setattr(topics, "HELD", held)
    monkeypatch.setattr(topics, "BLOCK", 300)
    cells = _comments(frame)
    texts, terms = topics.fit_topics(cells, "id", [3, 2], 5, rounds=3)
    plain = [_plain_fit([tuple(r) for r in cells.collect()], k, 5, 3) for k in (3, 2)]
    for got, side in ((texts, 0), (terms, 1)):
        rows = {r[0]: r.w for r in got.collect()}
        assert rows.keys() == plain[0][side].keys()
        for key, w in rows.items():
            assert w == pytest.approx(plain[0][side][key] + plain[1][side][key], rel=1e-9)
    scores = topics.tune_k(cells, "id", [2, 3], 5, rounds=3).collect()
    want = topics.topic_scores(terms, [3, 2]).collect()
    for s, w in zip(scores, reversed(want)):
        assert tuple(s) == pytest.approx(tuple(w), rel=1e-9)


def test_tuning_leaves_no_scratch_tables(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr("granary.session.shared_dir", lambda spark: str(tmp_path))
    cells = _comments(frame)
    topics.tune_k(cells, "id", range(2, 4), 5, rounds=2).collect()
    assert [p for p in tmp_path.rglob("*.parquet")] == []


def test_crowded_partners_are_not_joined(frame, monkeypatch):
    monkeypatch.setattr(network, "SQUARE", 7)
    monkeypatch.setattr(network, "DEALT", 150)
    rng = random.Random(4)
    crowd = [(f"i{i}", f"v{v}") for v in range(12) for i in rng.sample(range(40), rng.randint(10, 40))]
    for rows in (crowd, crowd + [("i1", "few"), ("i2", "few"), ("i2", "few"), ("i3", "one"), (None, "v1"), ("i4", None)]):
        edges = network.cooccurrence(frame(rows, "item string, via string"))
        held = {}
        for item, via in rows:
            if item and via:
                held.setdefault(via, set()).add(item)
        want = Counter(pair for items in held.values() for pair in itertools.combinations(sorted(items), 2))
        assert {(r.src, r.dst): r.weight for r in edges.collect()} == want
        if rows is crowd:
            assert "sequence(" not in edges._jdf.queryExecution().optimizedPlan().toString()
