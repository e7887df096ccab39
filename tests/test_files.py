from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import types as T

from portfolia.operators import alerts
from portfolia.sources import files
from portfolia.sources.versions import NoSuchVersion, SnapshotTable

from tests.conftest import plan_of

AB = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("b", T.IntegerType())])


@pytest.fixture
def sample(tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a, B\n 1 , 2 \n3\n4,5,6\nx,7\n")
    return str(tmp_path / "x.csv")


def test_lenient_csv(spark, sample):
    # Short and long lines are good rows; only a value that fails to parse is bad.
    rows = files.read_csv_entity(spark, sample, AB).collect()
    assert [(r.A, r.b) for r in rows] == [(1, 2), (3, None), (4, 5), (None, 7)]
    good, bad = files.load_skip_bad_rows(spark, sample, AB)
    assert [(r.A, r.b) for r in good.collect()] == [(1, 2), (3, None), (4, 5)]
    assert [(r.b, r._bad) for r in bad.collect()] == [(7, ["A"])]


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("A,B\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n20,10\n")
    (tmp_path / "3 x.csv").write_text("B\n200\n")
    rows = files.read_csv_entity(spark, str(tmp_path), AB).collect()
    assert sorted((r.A or 0, r.b) for r in rows) == [(0, 200), (1, 2), (10, 20)]
    assert files.copy_into_by_name(spark, str(tmp_path), AB).count() == 3


def test_thousand_headers_in_one_plan(spark, tmp_path):
    """Every file has a header of its own; the plan holds one scan of the data, as for one header."""
    for i in range(1000):
        (tmp_path / f"{i}.csv").write_text("\n".join(["", " ", f'b,"x {i}", A', f"{i},z,{2 * i}", "b,x,A", ""]))
    df = files.read_csv_entity(spark, str(tmp_path), AB)
    assert plan_of(df).count("Scan csv") == 1 and "Union" not in plan_of(df)
    rows = df.where("A IS NOT NULL").collect()
    assert sorted((r.A, r.b) for r in rows) == [(2 * i, i) for i in range(1000)]
    assert df.count() == 2000  # a line that repeats the header is data


def test_headers_are_read_from_the_first_bytes(spark, tmp_path, monkeypatch):
    stream = io.BytesIO(b"\r\n \na,\xc3\xa9\r" + b"1,2\n" * 3_000_000)
    assert files.first_line(stream) == "a,é" and stream.tell() == 1 << 16
    assert files.first_line(io.BytesIO(b"\n\n")) is None and files.first_line(io.BytesIO(b"x" * 99), 10) == "x" * 99
    (tmp_path / "1 x.csv").write_text("\n a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("")
    got = [r.header for r in files.header_lines(spark, str(tmp_path)).collect()]

    def refuse(path):
        raise OSError(path)

    monkeypatch.setattr(files, "_open", refuse)  # Spark alone can read the files
    other = [r.header.strip() for r in files.header_lines(spark, str(tmp_path)).collect()]
    assert got == other == ["a,b"]


def test_names_without_a_schema(spark, tmp_path):
    (tmp_path / "1.csv").write_text("B,a\n1,2\n")
    (tmp_path / "2.csv").write_text("A,c\n3,4\n")
    df = files.read_csv_entity(spark, str(tmp_path))
    assert df.columns == ["A", "c", "B"] and sorted(map(tuple, df.collect()), key=str) == [("2", None, "1"), ("3", "4", None)]
    (tmp_path / "3.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError, match="occurs twice"):
        files.read_csv_entity(spark, str(tmp_path), AB)


def test_keys_keep_their_identity(spark):
    rows = [(v,) for v in ("007", "7", "1e3", "900085.0", " 900086.00 ", "900085.6", "", None)]
    got = spark.createDataFrame(rows, "k string").select(files.normalise_key("k").alias("k"))
    assert [r.k for r in got.collect()] == ["007", "7", "1e3", "900085", "900086", "900085.6", None, None]


def test_strict_load_stops(spark, sample):
    with pytest.raises(Exception, match="cannot load A"):
        files.copy_into_by_name(spark, sample, AB).collect()


def test_invalid_utf8_is_replaced(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes(b"a\ncaf\xff\n")
    assert files.read_csv_entity(spark, str(tmp_path / "u.csv")).first().a == "caf�"


def test_question_mark_and_none_are_data(spark, tmp_path):
    (tmp_path / "q.csv").write_text("p,q\n?,None\n,x\n")
    rows = files.read_csv_entity(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.p, r.q) for r in rows] == [("?", "None"), (None, "x")]


def test_missing_column_and_key(spark, tmp_path):
    (tmp_path / "k.csv").write_text("Policy_Number\n900085.0\n\nPOL-1\n900086\n")
    schema = T.StructType([T.StructField("policy_number", T.StringType()), T.StructField("age", T.LongType())])
    rows = files.copy_into_by_name(spark, str(tmp_path / "k.csv"), schema).collect()
    assert [(r.policy_number, r.age) for r in rows] == [("900085", None), ("POL-1", None), ("900086", None)]


def test_json_array(spark, tmp_path):
    people = [{"id": i, "tags": ["a", str(i)], "m": {"x": i / 2}} for i in range(15)]
    (tmp_path / "b.json").write_text(json.dumps(people))
    path = str(tmp_path / "b.json")
    assert files.read_json_entity(spark, path).count() == 15
    schema = files.infer_entity_schema(spark, path, "json")
    assert schema.names == ["ID", "M", "TAGS"] and files.create_from_template(spark, schema).count() == 0
    assert [r.column_name for r in files.describe_schema(spark, schema).orderBy("ordinal").collect()] == schema.names
    raw = files.sample_raw_json(spark, path, 10).collect()
    assert len(raw) == 10 and json.loads(raw[3].record.toJson())["id"] == 3


def test_listing_and_scan(spark, tmp_path):
    for name, size in (("a.yaml", 10), ("b.YML", 20), ("c.txt", 30), ("d.yaml", 2000)):
        (tmp_path / name).write_text("x" * size)
    out = files.select_files(spark, str(tmp_path), suffixes=(".yaml", ".yml"), max_bytes=1000).collect()
    assert [(r.file_name, r.length) for r in out] == [("a.yaml", 10), ("b.YML", 20)]
    assert files.select_files(spark, str(tmp_path), pattern=r".*/c\.txt$").count() == 1
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.yaml").write_text("same")
    assert files.select_files(spark, str(tmp_path), pattern="m[.]yaml$").count() == 2
    assert files.largest_file(spark, str(tmp_path)).first().file_name == "d.yaml"
    assert len(files.document_scan(spark, str(tmp_path), "*.txt").first().raw_text) == 30


def test_write_export_fallback(spark, tmp_path):
    df = files.literal_rows(spark, [(1, "a,b"), (2, None)], "n int, s string")
    assert files.write_table(df, str(tmp_path / "t")).count() == 2
    files.export_records_csv(df, str(tmp_path / "e"))
    back = files.read_csv_entity(spark, str(tmp_path / "e"))
    assert sorted((r.n, r.s) for r in back.collect())[0] == ("1", "a,b")
    assert files.or_else(df, df).count() == 2
    assert files.or_else(df.where("false"), df).count() == 2


def test_versions(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "v"))
    table.commit(spark.range(5), "2024-01-01 00:00:00")
    table.commit(spark.range(3), "2024-01-02 00:00:00")
    assert table.read_as_of("2024-01-01 12:00:00").count() == 5
    assert table.read_as_of("2024-01-02 00:00:00").count() == 3
    assert table.read_before("2024-01-02 00:00:00").count() == 5
    with pytest.raises(NoSuchVersion):
        table.read_before("2024-01-01 00:00:00")
    table.commit(spark.range(4), "2024-01-02 00:00:00")  # a repeated commit replaces itself
    assert table.latest().count() == 4 and table.log().count() == 2
    # A write that never reached the log is not seen.
    spark.range(9).write.parquet(str(tmp_path / "v/data/commit=2024-01-03T000000"))
    assert table.latest().count() == 4
    done = table.restore_version(str(tmp_path / "r"), "2024-01-01 05:00:00").first()
    assert (done.restored_rows, done.version_rows) == (5, 5)


def test_alerts_and_metadata(spark):
    spark.range(1).createOrReplaceTempView("present_view")
    rules = [alerts.MissingTableRule("A", "present_view"), alerts.MissingTableRule("B", "absent_view")]
    rows = {r.alert: r for r in alerts.evaluate_alerts(spark, rules, "2024-01-01 00:00:00").collect()}
    assert not rows["A"].triggered and rows["A"].message is None
    assert rows["B"].triggered and "absent_view" in rows["B"].message
    checks = files.metadata_checks(spark, {"present_view": ["id", "x"], "absent_view": ["y"]}).collect()
    assert [(r.table_exists, r.missing_columns) for r in checks] == [(True, ["x"]), (False, ["y"])]
    assert files.exists_probe(spark, "absent_view").first().table_missing


def test_types_are_told_by_values_and_names(spark, tmp_path):
    (tmp_path / "1.csv").write_text("i,l,d,day,at,flag,s,none\n1,9999999999,1.5,2024-01-01,2024-01-01 10:00:00,true,x,\n,,,,,,,\n")
    (tmp_path / "2.csv").write_text("S,FLAG,AT,DAY,D,L,I\n1,FALSE,2024-02-01T10:00:00,2023-12-31,2,3,-7\n")
    found = files.infer_entity_schema(spark, str(tmp_path))
    assert {f.name: f.dataType.simpleString() for f in found} == {
        "I": "int", "L": "bigint", "D": "double", "DAY": "date", "AT": "timestamp", "FLAG": "boolean", "S": "string",
        "NONE": "string"}
