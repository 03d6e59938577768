"""Changes between files, on small hand-made ones."""

import json

from turnloom.operators.schema_drift import drift_changes, number_in, parse_line, unified_rows

SCHEMA = "stream string, file_name string, written_at int, line_no int, raw string"


def lines(files):
    return [("s", name, at, i + 1, raw) for at, (name, rows) in enumerate(files) for i, raw in enumerate(rows)]


def changes(spark, rows):
    return {(r.file_name, r.field_path, r.change_kind) for r in drift_changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def run(i, **fields):
    return json.dumps({"run_id": f"r{i}", **fields})


def test_all_kinds(spark):
    a = [run(i, der=i / 7, host="h", env={"dev": f"d{i}"}, old=i * 3) for i in range(4)]
    b = [run(i, error_rate=f"{i / 7 * 100:.6f}%", dev=f"d{i}", new=5) for i in range(2, 6)]
    found = changes(spark, lines([("a.jsonl", a), ("b.jsonl", b)]))
    assert found == {
        ("b.jsonl", "error_rate", "renamed"), ("b.jsonl", "error_rate", "retyped"), ("b.jsonl", "dev", "moved"),
        ("b.jsonl", "new", "added"), ("b.jsonl", "old", "removed"), ("b.jsonl", "host", "removed"),
    }


def test_csv_and_broken_lines(spark):
    a = ["run_id,der,note", "r1,0.5,x", 'r2,0.25,"a, b"']
    b = ["run_id,rate,note", "r2,0.25,", "r3,0.75,z", "r4,0"]
    rows = lines([("a.csv", a), ("b.csv", b)])
    assert changes(spark, rows + rows[:2]) == {("b.csv", "rate", "renamed")}


def test_empty_null_and_single_files(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("s", "a.jsonl", 1, 1, None), ("s", None, 1, 1, "{}"), (None, "b.jsonl", None, 1, '{"x": 1}')]) == set()


def test_unified_follows_renames(spark):
    a = [run(i, metrics={"der": i / 7}) for i in range(4)]
    b = [run(i, metrics={"rate": i / 7}) for i in range(2, 6)]
    rows = unified_rows(spark.createDataFrame(lines([("a.jsonl", a), ("b.jsonl", b)]), SCHEMA)).collect()
    assert len(rows) == 6 and {r.run_id: round(r.der, 6) for r in rows} == {f"r{i}": round(i / 7, 6) for i in range(6)}
    assert {r.file_name for r in rows if r.run_id in ("r2", "r3")} == {"a.jsonl"}


def test_values():
    assert number_in("92.5%") == 0.925 and number_in("0.25 u") == 0.25 and number_in("3.12.8") is None and number_in("cpu") is None
    assert parse_line('{"a": {"b": null}, "c": {}}', None, False) == [("a.b", "null", None, None), ("c", "str", None, "{}")]
    assert parse_line('{"a": 1', None, False) == [] and parse_line("x,y", "a", False) == []
