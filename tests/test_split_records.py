"""Records of files that are cut into splits: found without moving the text, whatever a split starts inside of."""

import json

from chatloom.sources.arrays import read_json_array
from chatloom.sources.csvfiles import read_csv_messages
from chatloom.sources.formats import first_json_records
from chatloom.streaming.ingest import drain, stream_array_messages
from conftest import pairs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_rows_are_joined_within_the_scan(spark, splits, write):
    rows = [(f"q{i} \"\"x\"\",\n\n line", f"a{i}") for i in range(40)]
    text = "question,answer\n\n" + "".join(f'"{q}",{a}\n' for q, a in rows) + '"open\nend'
    found = read_csv_messages(spark, write("a.csv", text), whole_file_bytes=0)
    assert "MapInArrow" in plan(found)
    assert pairs(found) == [(q.replace('""', '"'), a) for q, a in rows] + [("open\nend", "")]


def test_large_array_elements_are_joined_within_the_scan(spark, splits, write):
    items = [{"a": 'x}"]{', "n": [[{}], i]} for i in range(30)] + ["}", 5, {}, None]
    found = read_json_array(spark, write("a.json", json.dumps(items)), whole_file_bytes=0)
    assert "MapInArrow" in plan(found)
    values = [row["value"] for row in found.orderBy("path", "pos").collect()]
    assert [json.loads(v) for v in values[:30]] == items[:30] and values[30:] == ["}", "5", "{}", None]


def test_lines_under_an_array_name_are_one_bad_file(spark, splits, write, tmp_path):
    write("b.json", "\n".join(json.dumps({"a": i}) for i in range(60)))
    write("c.json", json.dumps([{"messages": [i]} for i in range(60)]))
    found = {row["path"].rsplit("/", 1)[1]: (row["container"], row["value"])
             for row in first_json_records(spark, str(tmp_path), whole_file_bytes=16).collect()}
    assert found == {"b.json": ("lines", '{"a": 0}'), "c.json": ("array", '{"messages":[0]}')}


def test_large_streamed_arrays_are_read_by_pieces(spark, write, tmp_path):
    items = [{"instruction": f'{i} }}" [', "output": "é{"} for i in range(50)]
    write("in/a.json", json.dumps(items))
    write("in/b.json", json.dumps(items[:2]))
    write("in/bad.json", json.dumps(items[:3])[:-1])
    write("in/no.json", json.dumps(items[0]))
    stream = stream_array_messages(spark, str(tmp_path / "in"), "alpaca", whole_file_bytes=200)
    assert "MapInArrow" in stream._jdf.queryExecution().analyzed().toString()
    found = drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {}
    for row in found.collect():
        got.setdefault(row["path"].rsplit("/", 1)[1], []).append(row["messages"] and row["messages"][0]["content"])
    asked = [item["instruction"] for item in items]
    assert sorted(got["a.json"]) == sorted(asked) and sorted(got["b.json"]) == asked[:2]
    assert got["bad.json"].count(None) == 1 and set(got["bad.json"]) <= {None, *asked[:3]} and got["no.json"] == [None]
