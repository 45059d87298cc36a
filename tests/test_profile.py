"""Expectations for profiles of small inline tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tableprep.operators import profile
from tableprep.operators.profile import column_profile, profile_document, quick_profile, sample_values, table_profile, top_values
from tableprep.sources.tables import as_table, list_table_files, load_table, load_tables, table_metadata


def by_name(df):
    return {r["name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def wells(spark):
    """Six readings of three wells, one depth unknown, no row twice."""
    rows = [("north", 4.5, True), ("north", 5.0, False), ("south", None, False), ("south", 12.5, False), ("mill", 0.5, False), ("mill", 1.0, True)]
    return spark.createDataFrame(rows, "well string, depth double, dry boolean")


def test_counts_ranges_and_top_values(wells):
    table = table_profile(wells, "wells").first()
    assert (table["row_count"], table["duplicate_row_count"], table["column_count"]) == (6, 0, 3)
    cols = by_name(column_profile(wells, "wells"))
    depth = cols["depth"]
    assert (depth["missing_count"], depth["missing_rate"], depth["num_min"], depth["num_median"], depth["num_max"]) == (1, 0.166667, 0.5, 4.5, 12.5)
    dry = cols["dry"]["top_values"]
    assert [(v["value"], v["count"], v["rate"]) for v in dry] == [("false", 4, 0.666667), ("true", 2, 0.333333)]
    assert cols["well"]["unique_rate"] == 0.5


def test_csv_dates_are_detected(spark, tmp_path):
    path = tmp_path / "harvest.csv"
    path.write_text("picked;row;kilos\n03-09-2023;7;12.5\n28-08-2023;7;9\n30-08-2023;8;NA\n")
    cols = by_name(column_profile(load_table(spark, str(path), sep=";"), path.name))
    assert (cols["picked"]["datetime_format"], cols["picked"]["datetime_min"], cols["picked"]["datetime_max"]) == (
        "dd-MM-yyyy", "2023-08-28T00:00:00", "2023-09-03T00:00:00",
    )
    assert (cols["kilos"]["type_class"], cols["kilos"]["missing_count"]) == ("float", 1)
    iso = tmp_path / "iso.csv"
    iso.write_text("picked\n2023-09-03\n2023-08-28\n")
    assert by_name(column_profile(load_table(spark, str(iso))))["picked"]["datetime_min"] == "2023-08-28T00:00:00"


def test_csv_kinds_gaps_and_line_breaks(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('tag,level,open,note\n007,3000000000,True,"two\nlines, ""quoted"""\nNA,4,false,n/a\n12,null,,plain\n')
    df = load_table(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "bigint", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [(7, 3_000_000_000, True, 'two\nlines, "quoted"'), (None, 4, False, None), (12, None, None, "plain")]
    as_written = load_table(spark, str(path), missing=None)
    assert as_written.schema["tag"].dataType.simpleString() == "string" and as_written.where("note = 'n/a'").count() == 1
    meta = table_metadata(df, str(path)).first()
    assert (meta["file_name"], meta["file_size_bytes"], meta["row_count"]) == ("notes.csv", path.stat().st_size, 3)


def test_column_cap(spark):
    df = spark.createDataFrame([("p", 1.5, True, 9), ("q", 2.5, False, 8)], "part string, load double, spare boolean, shelf int")
    assert [r["name"] for r in column_profile(df, max_columns=3).collect()] == ["part", "load", "spare"]
    assert table_profile(df, max_columns=3).first()["truncated_columns"] == ["shelf"]


def test_nan_is_missing_and_json_has_no_nan(spark):
    rows = [(dt.datetime(2019, 5, 4, 6), float("nan")), (dt.datetime(2019, 5, 4, 7), 7.25), (dt.datetime(2019, 5, 4, 8), float("nan"))]
    columns = column_profile(spark.createDataFrame(rows, "read_at timestamp, salt double"), "sea")
    salt = by_name(columns)["salt"]
    assert (salt["sample_values"], salt["missing_count"], salt["num_std"]) == (["7.25"], 2, 0.0)
    tables = table_profile(spark.createDataFrame(rows, "read_at timestamp, salt double"), "sea")
    for row in profile_document(tables, columns).collect():
        json.loads(row["document"], parse_constant=lambda c: pytest.fail(c))


def test_infinite_summaries_are_null(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    x = by_name(column_profile(df))["x"]
    assert (x["num_min"], x["num_max"], x["num_mean"], x["num_std"]) == (1.0, None, None, None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, t timestamp")
    assert table_profile(df).first()["row_count"] == 0
    cols = by_name(column_profile(df))
    assert [cols[c]["missing_rate"] for c in "abt"] == [0.0, 0.0, 0.0]
    assert cols["a"]["num_mean"] is None and cols["a"]["sample_values"] == []
    assert cols["t"]["has_datetime_summary"]


def test_booleans_decimals_nested_and_odd_names(spark):
    df = spark.sql(
        "SELECT id % 2 = 0 AS flag, cast(id AS decimal(10, 2)) AS `a.b`, array(id) AS list, map('k', id) AS m, "
        "cast('x' AS binary) AS bin, date'2024-01-01' AS d FROM range(4)"
    )
    cols = by_name(column_profile(df))
    assert [cols[c]["type_class"] for c in ("flag", "a.b", "list", "m", "bin", "d")] == ["boolean", "numeric", "object", "object", "object", "datetime"]
    assert (cols["flag"]["num_mean"], cols["a.b"]["num_median"]) == (0.5, 1.5)
    assert [cols[c]["unique_count"] for c in ("flag", "a.b", "list", "m", "bin", "d")] == [2, 4, 4, 4, 1, 1]
    assert table_profile(df).first()["duplicate_row_count"] == 0


def test_duplicates_see_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), (None, None)], "x string, y string")
    assert table_profile(df).first()["duplicate_row_count"] == 1


def test_long_texts_are_reported_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "1",), (long + "1",), (long + "2",), ("short",)], "t string")
    t = by_name(column_profile(df))["t"]
    assert t["unique_count"] == 3
    assert t["top_values"][0]["value"] == long + "1" and t["top_values"][0]["count"] == 2
    assert set(t["sample_values"]) == {long + "1", long + "2", "short"}


def test_same_result_in_any_partitioning(wells):
    want = [tuple(r) for r in column_profile(wells).collect()]
    for n in (1, 7):
        assert [tuple(r) for r in column_profile(wells.repartition(n)).collect()] == want


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported data file extension"):
        load_table(spark, str(tmp_path / "a.xml"))
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        load_tables(spark, [])


def test_quick_profile_is_close(wells):
    exact, quick = by_name(column_profile(wells)), by_name(quick_profile(wells))
    for name in exact:
        assert quick[name]["unique_count"] == exact[name]["unique_count"]
        assert quick[name]["missing_rate"] == exact[name]["missing_rate"]
    assert quick["depth"]["num_median"] == 4.5


def test_tables_and_paths_are_both_taken(spark, wells, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    df, name, kind = as_table(spark, str(path))
    assert (df.count(), name, kind) == (2, "x.jsonl", "path")
    assert as_table(spark, wells)[1:] == ("dataframe", "dataframe")
    with pytest.raises(TypeError):
        as_table(spark, 3)


def test_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.csv", "a.PARQUET", "notes.md", "sub/c.json"):
        (tmp_path / name).write_text("x")
    names = [r["file_name"] for r in list_table_files(spark, str(tmp_path)).collect()]
    assert names == ["a.PARQUET", "b.csv"]
    deep = [r["file_name"] for r in list_table_files(spark, str(tmp_path), recursive=True).collect()]
    assert deep == ["a.PARQUET", "b.csv", "c.json"]
    with pytest.raises(FileNotFoundError):
        list_table_files(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        list_table_files(spark, str(tmp_path / "b.csv"))


def test_json_document_and_encoding(spark, tmp_path):
    doc, latin = tmp_path / "d.json", tmp_path / "l.csv"
    doc.write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    latin.write_bytes("a;b\n1;é\n".encode("latin-1"))
    assert sorted(map(tuple, load_table(spark, str(doc)).collect()), key=str) == [(1, "x"), (2, None)]
    assert load_table(spark, str(latin), encoding="latin1", sep=";").first()["b"] == "é"


def test_long_texts_are_ordered_by_their_whole(spark):
    rows = [("x" * 64 + c,) for c in "fedcba"] + [("x" * 64 + "f",)] * 2 + [("short",)]
    df = spark.createDataFrame(rows, "t string")
    samples = [r["value"] for r in sample_values(df, 4).orderBy("rank").collect()]
    assert samples == ["short"] + ["x" * 64 + c for c in "abc"]
    tops = [(r["value"][-1], r["count"]) for r in top_values(df, 4).orderBy("rank").collect()]
    assert tops == [("f", 3), ("t", 1), ("a", 1), ("b", 1)]


def test_padded_dates_are_dates(spark):
    df = spark.createDataFrame([(" " * n + f"2024-05-0{n % 9 + 1}" + " " * n,) for n in (0, 1, 20, 90)], "t string")
    row = column_profile(df).first()
    assert row["datetime_format"] == "yyyy-MM-dd" and row["datetime_min"][:10] == "2024-05-01"


def test_smallest_short_texts_come_from_their_counts(spark, monkeypatch):
    long = "m" * 70
    rows = [("b", long + "2", "z"), ("a", long + "1", "a" * 80), ("b", long + "1", "y"), ("c", "n", "x")]
    df = spark.createDataFrame(rows, "short string, long string, mixed string")
    read_again, smallest = [], profile.smallest_texts
    monkeypatch.setattr(profile, "smallest_texts", lambda df, positions, k: read_again.extend(positions) or smallest(df, positions, k))
    found = {}
    for r in profile.sample_values(df, 2).orderBy("name", "rank").collect():
        found.setdefault(r["name"], []).append((r["value"], r["count"]))
    assert found == {"short": [("a", 1), ("b", 2)], "long": [(long + "1", 2), (long + "2", 1)], "mixed": [("a" * 80, 1), ("x", 1)]}
    assert sorted(read_again) == [1, 2]
