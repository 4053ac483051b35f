"""Reading and writing files."""

import glob

from pyspark.sql import functions as F

from granary.session import SETTINGS, scratch_path, shared_dir
from granary.sources.sinks import load_tables, save_tables, write_csv_r, write_split
from granary.sources.tables import (
    choose_files,
    file_names,
    nullify_tokens,
    read_chosen,
    read_csv_inferred,
    read_text_table,
    read_typed,
    read_yearly,
    skip_rows,
    union_harmonised,
    union_tagged,
    year_of_name,
)


def test_text_landing_skips_repeated_headers_of_each_file(spark, tmp_path):
    for name in ("a", "b"):
        lines = ["id,v", "long name,text", *[f"{name}{i},{i}" for i in range(50)]]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    text = read_text_table(spark, str(tmp_path), ordinal="_row")
    assert dict(text.dtypes)["v"] == "string" and text.count() == 102
    body = skip_rows(text, "_row", 1)
    assert body.count() == 100 and body.where("v = 'text'").isEmpty()
    assert [r.id for r in body.orderBy("_row").select("id").limit(3).collect()] == ["a0", "a1", "a2"]
    numbered = body.select(F.col("v").try_cast("int").alias("place"), "id")
    assert skip_rows(numbered, "place", 40).count() == 18


def test_csv_spellings(spark, tmp_path, frame):
    path = str(tmp_path / "out")
    write_csv_r(frame([("a", True, 1.5), (None, False, None), ("", None, 2.0)], "s string, f boolean, x double").coalesce(1), path)
    lines = open(glob.glob(f"{path}/*.csv")[0]).read().splitlines()
    assert lines == ["s,f,x", "a,TRUE,1.5", "NA,FALSE,NA", ",NA,2.0"]


def test_typed_and_inferred_reads(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Code,4 Person SMI\nAL,5\n")
    assert read_csv_inferred(spark, str(tmp_path / "t.csv"), {"4 Person SMI": "smi4"}).dtypes == [("Code", "string"), ("smi4", "int")]
    assert read_typed(spark, str(tmp_path / "t.csv"), "code string, smi4 double").first().smi4 == 5.0


def test_files_are_chosen_by_pattern(frame):
    names = ["2020 Decision Book.xlsx", "2019 Decision Book.xlsx", "Notes.txt"]
    assert choose_files(names, "Decision Book", "2019|Original") == names[:1]
    df = frame([(n,) for n in names], "path string")
    assert [r.path for r in choose_files(df, "Decision Book", "2019|Original").collect()] == names[:1]


def test_the_year_is_that_of_the_file_name(frame):
    df = frame([("/data/v2/2021 Decision Book.xlsx",)], "path string")
    assert df.select(year_of_name(file_names("path"))).first()[0] == 2021


def test_drifting_tables_are_stacked(frame):
    a, b = frame([(1, 2)], "k int, x int"), frame([(1, "y")], "k int, z string")
    got = union_tagged({"one": a, "two": b}, "sheet").collect()
    assert [(r.sheet, r.x, r.z) for r in got] == [("one", 2, None), ("two", None, "y")]
    c, d = frame([(5,)], "line int"), frame([("x",)], "line string")
    assert [r.line for r in union_harmonised([c, d], {"line": "string"}).collect()] == ["5", "x"]


def test_many_files_are_read_in_one_scan(spark, frame):
    folder = scratch_path(spark, "books")
    frame([(1, 2.0, "yes")], "number int, amount double, decision string").write.parquet(f"{folder}/a/Decision Book 2021+.parquet")
    frame([(2, 3.0)], "number int, amount double").write.parquet(f"{folder}/b/c/2022 Decision Book.parquet")
    for name in ("2022 Decision Book Original", "Notes 2022"):
        frame([(9, 9.0)], "number int, amount double").write.parquet(f"{folder}/b/{name}.parquet")
    df = read_chosen(spark, [f"{folder}/a", f"{folder}/b"], "Decision Book", "Original", tag="book", year="fy")
    assert sorted(r[:] for r in df.collect()) == [(1, 2.0, "yes", "Decision Book 2021+", 2021), (2, 3.0, None, "2022 Decision Book", 2022)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_yearly_folders_are_pruned(spark, frame):
    path = scratch_path(spark, "years")
    write_split(frame([(1, 5, 2019), (2, 6, 2020), (3, 7, 2021), (4, 8, 2021)], "k int, line int, fy int"), path, "fy")
    df = read_yearly(spark, path, "fy", [2020, 2021], {"line": "string"}, F.col("k") < 4)
    assert sorted(r[:] for r in df.collect()) == [(2, "6", 2020), (3, "7", 2021)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(fy" in plan


def test_tokens_become_missing(frame):
    df = nullify_tokens(frame([("-",), ("null",), ("5",), (None,)], "s string"), ["s"], ["null", "-", "**"])
    assert [r.s for r in df.collect()] == [None, None, "5", None]


def test_stage_tables_and_split_folders(spark, frame):
    folder = scratch_path(spark, "stage")
    assert folder.startswith(shared_dir(spark))
    df = frame([(1, "a"), (2, "b")], "k int, s string")
    save_tables({"t": df}, folder)
    assert load_tables(spark, folder, "t")["t"].count() == 2
    write_split(df, f"{folder}/split", "s")
    assert spark.read.parquet(f"{folder}/split").where("s = 'b'").first().k == 2


def test_session_settings(spark):
    assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())
