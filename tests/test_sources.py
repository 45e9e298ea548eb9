"""Sources, sinks, records and inferred keys."""

import json

import pytest

from tablewright import TableSource
from tablewright.sources import parse_json, prediction_rows, read_csv, records, rows_to_json, unique_columns, write_csv


def test_open_and_fail(spark, sf, tmp_path):
    assert len(TableSource.from_parquet(spark, sf).list_tables()) == 14
    with pytest.raises(ConnectionError):
        TableSource.from_parquet(spark, str(tmp_path / "missing"))
    with pytest.raises(ConnectionError):
        TableSource.from_jdbc(spark, "jdbc:unknown://host/db", ["t"])
    with pytest.raises(ValueError, match="Unknown table"):
        TableSource.from_parquet(spark, sf, ["nation"]).table("moon")


def test_catalog_tables(spark, sf):
    TableSource.from_parquet(spark, sf, ["region"])
    assert TableSource.from_catalog(spark).load_table("region").count() == 5


def test_limits(spark, sf):
    source = TableSource.from_parquet(spark, sf, ["nation"])
    assert source.load_table("nation", 0).count() == 0
    assert source.load_table("nation", 3).count() == 3
    assert source.load_table("nation").count() == 25


def test_schema_rows(spark, sf):
    rows = TableSource.from_parquet(spark, sf, ["region"]).schemas().collect()
    assert [(r["column_name"], r["type"]) for r in rows] == [("r_regionkey", "int"), ("r_name", "string")]


def test_keys_need_whole_values(spark):
    # equal beginnings, one repeated value, one gap
    rows = [("a" * 400 + str(i), i, None if i == 5 else i, i % 9) for i in range(10)]
    df = spark.createDataFrame(rows, "t string, i int, gap int, few int")
    assert unique_columns(df) == ["t", "i"]
    assert unique_columns(df.unionAll(df.limit(1))) == []


def test_relations_without_orphans(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "dept_id int").write.parquet(str(tmp_path / "dept.parquet"))
    spark.createDataFrame([(10, 1), (11, 1), (12, None)], "emp_id int, dept_id int").write.parquet(str(tmp_path / "emp.parquet"))
    spark.createDataFrame([(7, 1), (8, 2), (9, 2), (6, 99)], "sale_id int, dept_id int").write.parquet(str(tmp_path / "sale.parquet"))
    source = TableSource.from_parquet(spark, str(tmp_path))
    named = {tuple(r) for r in source.foreign_keys(match_names=True).collect()}
    assert named == {("emp", "dept_id", "dept", "dept_id", 1, 3, True)}
    assert {tuple(r) for r in source.foreign_keys().collect()} == named
    overview = {r["table_name"]: r for r in source.overview().collect()}
    assert overview["emp"]["primary_keys"] == ["emp_id"] and overview["dept"]["foreign_keys"] is None


def test_relations_need_no_equal_names(spark, tmp_path):
    """Whole numbers of two widths, texts with long equal beginnings, gaps, signed zeros and NaN."""
    tables = {
        "emp": spark.createDataFrame([(i, "x" * 80 + str(i), i / 2) for i in range(1, 9)], "emp_id bigint, code string, pay double"),
        "team": spark.createDataFrame(
            [(100, 3, "x" * 80 + "4", 0.5, None), (101, 3, "x" * 80 + "9", float("nan"), None), (102, None, None, 4.0, None)],
            "team_id int, manager_id int, label string, best double, nothing int"),
        "zero": spark.createDataFrame([(0.0, 3), (1.0, 8)], "z double, boss smallint"),
        "sign": spark.createDataFrame([(-0.0,), (1.0,), (-0.0,)], "s double"),
    }
    found = {tuple(r)[:6] for r in TableSource(spark, tables).foreign_keys().collect()}
    assert found == {
        ("team", "manager_id", "emp", "emp_id", 1, 8), ("zero", "boss", "emp", "emp_id", 2, 8), ("sign", "s", "zero", "z", 2, 2),
        ("team", "manager_id", "zero", "boss", 1, 2),
    }


def test_relations_over_more_columns_than_one_word(spark):
    wide = spark.createDataFrame([tuple(range(k, k + 150)) for k in range(3)], [f"c{i}" for i in range(150)])
    keys = spark.createDataFrame([(i,) for i in range(120)], "k long")
    found = {(r["table_name"], r["column_name"]) for r in TableSource(spark, {"wide": wide, "keys": keys}).foreign_keys().collect()}
    assert found == {("wide", f"c{i}") for i in range(118)}


def test_records(spark):
    schema = "a int, x double, s string, unused int"
    assert records(spark, {"a": 1, "x": 2}, schema).collect()[0].asDict() == {"a": 1, "x": 2.0}
    assert records(spark, '[{"s": "p"}, {"s": null, "a": 3}]', schema).count() == 2
    for bad in ("3", "[1]", "{broken"):
        with pytest.raises(ValueError):
            records(spark, bad, schema)
    with pytest.raises(ValueError, match="not both"):
        prediction_rows(spark, "{}", "file.csv")
    with pytest.raises(FileNotFoundError):
        prediction_rows(spark, csv_path="/nowhere/rows.csv")
    assert prediction_rows(spark) is None


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "a,b"), (2, None, 'q"uote'), (3, float("nan"), "")], "i int, x double, s string")
    write_csv(df, str(tmp_path / "rows"))
    back = {r["i"]: r for r in read_csv(spark, str(tmp_path / "rows"), df.schema).collect()}
    assert back[1]["x"] == 0.1 and back[2]["s"] == 'q"uote' and back[3]["x"] is None
    texts = rows_to_json(df)
    assert json.loads(texts.where("json LIKE '%\"i\":3%'").first()["json"])["x"] is None
    assert parse_json(texts, "json", df.schema).count() == 3
