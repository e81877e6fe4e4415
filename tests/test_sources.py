import json

import pytest
from conftest import pairs, turns
from pyspark.sql import functions as F

from chatloom.sources import datasets, prompts
from chatloom.sources.arrays import read_json_array
from chatloom.sources.files import with_ordinal
from chatloom.sources.formats import detect_format, detect_formats, supported_formats


def load(spark, path, **options):
    return datasets.load_dataset(spark, path, shuffle=False, **options)


# ---- chat records ---------------------------------------------------------


def test_chat_array(spark, write):
    path = write("a.json", '[{"messages":[{"role":"user","content":"x"}]},{"messages":[]}]')
    assert turns(load(spark, path)) == [[("user", "x")], []]


def test_chat_lines(spark, write):
    lines = '{"messages":[{"role":"user","content":"x"}]}\n{"messages":[{"role":"user","content":"y","extra":1}]}\n'
    path = write("a.jsonl", lines)
    assert detect_format(spark, path) == ("lines", "sharegpt")
    assert turns(load(spark, path)) == [[("user", "x")], [("user", "y")]]


def test_missing_content_becomes_empty(spark, write):
    path = write("a.json", '[{"messages":[{"role":"user"}]}]')
    assert turns(load(spark, path)) == [[("user", "")]]


def test_pretty_printed_array(spark, write):
    records = [{"messages": [{"role": "user", "content": f'q "{i}" [}}{{'}], "meta": {"a": [1, {}]}} for i in range(5)]
    path = write("a.json", json.dumps(records, indent=2))
    expected = [[("user", r["messages"][0]["content"])] for r in records]
    assert turns(load(spark, path)) == expected


def test_chat_record_without_messages_fails(spark, write):
    path = write("a.json", '[{"messages":[]},{"note":1}]')
    with pytest.raises(Exception, match="bad record"):
        load(spark, path).collect()


# ---- instruction records --------------------------------------------------


def test_alpaca_input(spark, write):
    path = write("a.json", json.dumps([{"instruction": " i ", "input": "n", "output": " o "}]))
    assert pairs(load(spark, path)) == [("i \n\nn", "o")]


def test_alpaca_response(spark, write):
    path = write("a.json", json.dumps([{"instruction": "i", "input": "", "response": "r"}]))
    assert pairs(load(spark, path)) == [("i", "r")]


def test_alpaca_without_answer(spark, write):
    path = write("a.jsonl", '{"instruction":"i"}\n')
    assert pairs(load(spark, path)) == [("i", "")]


# ---- question/answer records ----------------------------------------------


@pytest.mark.parametrize(
    "record, expected",
    [
        ('{"question":"","prompt":"p","answer":0,"response":"r"}', ("p", "r")),
        ('{"question":"0","answer":"a"}', ("0", "a")),
        ('{"question":"q","answer":{"text":"t"}}', ("q", "t")),
        ('{"question":"q","answer":{"n":1}}', ("q", '{"n":1}')),
        ('{"question":"q","answer":"{\\"text\\":\\"t\\"}"}', ("q", '{"text":"t"}')),
        ('{"question":"a","question":"b","answer":"c"}', ("b", "c")),
        ('{"question":"false","answer":false,"output":"o"}', ("false", "o")),
        ('{"question":0.0,"prompt":"p","answer":-0,"completion":"c"}', ("p", "c")),
        ('{"question":"q","answer":[],"response":{},"output":[0]}', ("q", "[0]")),
        ('{"question":1.0,"answer":12}', ("1.0", "12")),
        ('{"question":null,"input":"i"}', ("i", "")),
        ('{"other":1}', ("", "")),
        ('{"question":"\\u3000 a b \\t\\u00a0","answer":"\\u001ca"}', ("a b", "a")),
    ],
)
def test_question_answer(spark, write, record, expected):
    path = write("a.jsonl", f"\n{record}\n   \n")
    assert pairs(datasets.read_qa(spark, path)) == [expected]


def test_question_answer_array(spark, write):
    path = write("a.json", '[{"question":"q","answer":"a"}]')
    assert detect_format(spark, path) == ("array", "jsonl")
    assert pairs(load(spark, path)) == [("q", "a")]


@pytest.mark.parametrize("line", ["{bad", '{"question":"q"} junk', '{"question":"q"}{"a":1}', "[1]", '"s"', "{'question':'q'}"])
def test_bad_line(spark, write, line):
    path = write("a.jsonl", f'{{"question":"q","answer":"a"}}\n{line}\n')
    with pytest.raises(Exception, match="bad record"):
        datasets.read_qa(spark, path).collect()
    kept = datasets.read_qa(spark, path, on_bad="null").orderBy("pos").collect()
    assert [r["messages"] is None for r in kept] == [False, True]


# ---- CSV ------------------------------------------------------------------

QUOTED = 'question,answer\n"say ""hi""\nthere",a1\n\nq2\nq3,a3,extra\nq4,\n q5 , a5 \n'
QUOTED_PAIRS = [('say "hi"\nthere', "a1"), ("q2", ""), ("q3", "a3"), ("q4", ""), ("q5", "a5")]


def test_csv_quoted(spark, write):
    assert pairs(load(spark, write("a.csv", QUOTED))) == QUOTED_PAIRS


def test_csv_quoted_in_splits(spark, write, splits):
    path = write("a.csv", QUOTED + QUOTED.split("\n", 1)[1] * 20)
    assert pairs(load(spark, path, whole_file_bytes=0)) == QUOTED_PAIRS * 21


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Question,Answer\nq,a\n", [("q", "a")]),
        ("a\nx\n", [("x", "")]),
        ("answer,prompt,question\n1,2,3\n", [("2", "1")]),
        ("instruction,input,response,output\ni,,r,\ni,n,r,o\n", [("i", "r"), ("i\n\nn", "o")]),
        ("input,instruction,answer\nn,i,a\n", [("i\n\nn", "a")]),
        ("question,other\nq,o\n", [("q", "o")]),
        ("question,question,answer\n1,2,3\n", [("2", "3")]),
    ],
)
def test_csv_columns(spark, write, text, expected):
    assert pairs(load(spark, write("a.csv", text))) == expected


def test_csv_without_rows_fails(spark, write):
    with pytest.raises(ValueError, match="no CSV rows"):
        load(spark, write("a.csv", "question,answer\n"))


def test_csv_folder_with_other_headers(spark, write):
    write("d/a.csv", "question,answer\nq,a\n")
    path = write("d/b.csv", "answer,note,question\nA,n,Q\n")
    assert pairs(load(spark, path.rsplit("/", 1)[0])) == [("q", "a"), ("Q", "A")]


# ---- text -----------------------------------------------------------------

PARAGRAPHS = "p1 l1\np1 l2\n\n\np2\n\n \n\np3\n"
SAMPLES = [("p1 l1\np1 l2",), ("p2",), ("p3",)]


@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("whole", [10**9, 0])
def test_paragraphs(spark, write, line_end, whole):
    path = write("a.txt", PARAGRAPHS.replace("\n", line_end))
    assert pairs(load(spark, path, whole_file_bytes=whole)) == SAMPLES


def test_paragraphs_in_splits(spark, write, splits):
    path = write("a.txt", (PARAGRAPHS + "\n") * 50)
    assert pairs(load(spark, path, whole_file_bytes=0)) == SAMPLES * 50


def test_whitespace_line_does_not_split(spark, write):
    path = write("a.txt", "a\n \nb\n")
    for whole in (10**9, 0):
        assert pairs(load(spark, path, whole_file_bytes=whole)) == [("a\n \nb",)]


def test_text_folder(spark, write):
    write("d/b.txt", "two\n\nparts \n")
    path = write("d/c.txt", " \n")
    assert turns(load(spark, path.rsplit("/", 1)[0])) == [[("assistant", "two\n\nparts")]]


# ---- arrays in splits -----------------------------------------------------


@pytest.mark.parametrize("indent", [None, 1])
def test_large_array_equals_whole(spark, write, splits, indent):
    records = [
        {"question": f'{i} "}}" \\ {{ [ \\" {"x" * (i % 90)}', "answer": {"text": "a}", "n": [{"k": "]"}] * (i % 3)}}
        for i in range(150)
    ]
    path = write("a.json", json.dumps(records, indent=indent, ensure_ascii=bool(indent)) + "\n")
    whole = [r["value"] for r in read_json_array(spark, path).orderBy("pos").collect()]
    cut = [r["value"] for r in read_json_array(spark, path, whole_file_bytes=0).orderBy("pos").collect()]
    assert [json.loads(v) for v in whole] == records
    assert cut == whole


def test_large_array_with_scalars(spark, write, splits):
    items = ["a } b", {"x": 1}, 3, None, [1, {"y": "]"}], {"z": {}}, "end"] * 12
    path = write("a.json", json.dumps(items))
    cut = read_json_array(spark, path, whole_file_bytes=0, typed=True).orderBy("pos").collect()
    assert [json.loads(r["value"]) for r in cut] == items


def test_large_file_that_is_no_array(spark, write, splits):
    write("d/a.json", '{"a":1}\n' * 50)
    path = write("d/b.json", json.dumps([{"a": i} for i in range(50)]))
    folder = path.rsplit("/", 1)[0]
    assert read_json_array(spark, folder, whole_file_bytes=0, skip_others=True).count() == 50
    for whole in (10**9, 0):
        with pytest.raises(Exception, match="not a JSON array"):
            read_json_array(spark, folder, whole_file_bytes=whole).collect()


@pytest.mark.parametrize("tail", ["", '{"a":', "] junk", "]]", ", ]", '{"a":1}', ' {"a":1}]'])
@pytest.mark.parametrize("whole", [10**9, 0])
def test_broken_array_fails(spark, write, splits, tail, whole):
    path = write("a.json", "[" + ",".join('{"question":"q"}' for _ in range(20)) + tail)
    with pytest.raises(Exception, match="not a JSON array"):
        read_json_array(spark, path, whole_file_bytes=whole).collect()


def test_explicit_format_ignores_the_file_name(spark, write):
    path = write("a.txt", '[{"messages":[{"role":"user","content":"x"}]}]')
    assert turns(load(spark, path, format="sharegpt")) == [[("user", "x")]]


# ---- detection ------------------------------------------------------------


@pytest.mark.parametrize(
    "name, text, expected",
    [
        ("a.csv", "x,y\n1,2\n", ("lines", "csv")),
        ("a.txt", "[1]", ("lines", "text")),
        ("a.json", '[{"messages":[]}]', ("array", "sharegpt")),
        ("a.json", '[{"instruction":"i","output":"o"}]', ("array", "alpaca")),
        ("a.json", '[{"prompt":"p","completion":"c"}]', ("array", "jsonl")),
        ("a.json", '[{"other":1}]', ("array", "sharegpt")),
        ("a.json", "[]", ("array", "sharegpt")),
        ("a.jsonl", '{"messages":[]}\n', ("lines", "sharegpt")),
        ("a.jsonl", '{"instruction":"i"}\n', ("lines", "alpaca")),
        ("a.jsonl", '{"x":1}\n', ("lines", "jsonl")),
        ("a.jsonl", "not json\n", ("lines", "text")),
        ("a.json", "", ("lines", "text")),
    ],
)
def test_detection(spark, write, name, text, expected):
    path = write(name, text)
    assert detect_format(spark, path) == expected
    for whole in (10**9, 0):
        rows = detect_formats(spark, path, whole_file_bytes=whole).collect()
        if text:
            assert [(r["container"], r["format"]) for r in rows] == [expected]


def test_folder_prefers_json(spark, write):
    write("d/a.csv", "x\n1\n")
    write("d/b.txt", "t")
    path = write("d/z.jsonl", '{"question":"q"}\n')
    assert detect_format(spark, path.rsplit("/", 1)[0]) == ("lines", "jsonl")


def test_supported_formats(spark):
    assert {r["format"] for r in supported_formats(spark).collect()} == {
        "sharegpt", "alpaca", "jsonl", "csv", "text", "auto"
    }


# ---- loading --------------------------------------------------------------


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        load(spark, str(tmp_path / "none.json"))


def test_folder_loads_all_files(spark, write):
    write("d/a.jsonl", '{"question":"1"}\n')
    path = write("d/b.jsonl", '{"question":"2"}\n{"question":"3"}\n')
    folder = path.rsplit("/", 1)[0]
    assert [q for q, _ in pairs(load(spark, folder))] == ["1", "2", "3"]


@pytest.mark.parametrize("n, expected", [(None, 40), (0, 40), (40, 40), (99, 40), (7, 7)])
def test_sample_limits(spark, write, n, expected):
    path = write("a.jsonl", "".join(f'{{"question":"{i}"}}\n' for i in range(40)))
    for shuffle in (True, False):
        assert datasets.load_dataset(spark, path, max_samples=n, shuffle=shuffle).count() == expected


def test_shuffle_does_not_depend_on_splits(spark, write):
    path = write("a.jsonl", "".join(f'{{"question":"{i % 9} {"x" * 30}"}}\n' for i in range(60)))

    def order():
        rows = datasets.load_dataset(spark, path).collect()
        return [r["messages"][0]["content"] for r in rows]

    plain = order()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert order() == plain
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(plain) == sorted(f"{i % 9} {'x' * 30}" for i in range(60))


def test_ordinals_over_splits(spark, write, splits):
    path = write("a.jsonl", "".join(f'{{"question":"{i}"}}\n' for i in range(200)))
    records = datasets.read_json_records(spark, path, "lines")
    rows = with_ordinal(records).select("ordinal", F.get_json_object("value", "$.question").alias("q")).collect()
    assert sorted((r["ordinal"], int(r["q"])) for r in rows) == [(i, i) for i in range(200)]


# ---- prompts --------------------------------------------------------------


def prompt_list(df):
    return [r["prompt"] for r in df.orderBy("pos").collect()]


def test_prompts_json(spark, write):
    path = write("a.json", '["a",{"prompt":"b"},{"x":1}," "]')
    assert prompt_list(prompts.read_prompts(spark, path)) == ["a", "b", ""]


def test_prompts_json_string_that_looks_like_an_object(spark, write):
    path = write("a.json", json.dumps(['{"prompt":"p"}', "1", {"question": 7}]))
    assert prompt_list(prompts.read_prompts(spark, path)) == ['{"prompt":"p"}', "1", "7"]


def test_prompts_object(spark, write):
    assert prompt_list(prompts.read_prompts(spark, write("a.json", '{"q1":"x","q2":"y"}'))) == ["q1", "q2"]


def test_prompts_csv_and_txt(spark, write):
    assert prompt_list(prompts.read_prompts(spark, write("a.csv", "question\nq1\n"))) == ["question", "q1"]
    assert prompt_list(prompts.read_prompts(spark, write("a.txt", " q1 \n\n\t\nq2"))) == ["q1", "q2"]


def test_prompts_jsonl(spark, write):
    path = write("a.jsonl", '{"question":" a "}\n\n{"input":"b"}\n{"x":1}\n{"instruction":"c","question":""}\n')
    assert prompt_list(prompts.read_prompts(spark, path)) == ["a", "b", "c"]
    assert prompt_list(prompts.read_prompts(spark, path, narrow=True)) == [" a "]


def test_prompts_json_narrow(spark, write):
    path = write("a.json", '[" a ",{"question":"","prompt":"p"},{"prompt":"b"},{"input":"c"}]')
    assert prompt_list(prompts.read_prompts(spark, path, narrow=True)) == [" a ", "", "b", ""]


def test_no_prompts(spark, write):
    with pytest.raises(ValueError, match="no prompts"):
        prompts.read_prompts(spark, write("a.jsonl", '{"x":1}\n'))


def test_csv_stray_quotes_in_splits(spark, write, splits):
    rows = ['5" pipe,a', '"x ""y"" ,\n""z",b', 'n,"t\n\nu"', 'p"q,"r"', '"a"b,"c""\n"', 'plain,text', '"","""q"""']
    text = "question,answer\n" + "".join(f"{r}\n" for r in rows) * 15
    path = write("a.csv", text)
    whole = pairs(load(spark, path))
    assert len(whole) == 15 * len(rows)
    assert whole[:4] == [('5" pipe', "a"), ('x "y" ,\n"z', "b"), ("n", "t\n\nu"), ('p"q', "r")]
    assert pairs(load(spark, path, whole_file_bytes=0)) == whole


def test_names_with_marks(spark, write):
    path = write("d e/a b+c%41.jsonl", '{"question":"q"}\n')
    assert detect_format(spark, path.rsplit("/", 1)[0]) == ("lines", "jsonl")
    rows = load(spark, path.rsplit("/", 1)[0]).collect()
    assert [r["path"].removeprefix("file:") for r in rows] == [path]
    table = write("f g/t u.csv", "question,answer\nq,a\n")
    assert pairs(load(spark, table)) == [("q", "a")]


LONG_HEADER = '\n"ques\n\ntion","an""swer\n",question,answer\n'


@pytest.mark.parametrize("whole", [10**9, 0])
def test_csv_header_over_lines(spark, write, splits, whole):
    rows = "".join(f'x{i},y,"q\n{i}",a{i}\n' for i in range(40))
    path = write("d/a.csv", LONG_HEADER + rows)
    expected = [(f"q\n{i}", f"a{i}") for i in range(40)]
    assert pairs(load(spark, path, whole_file_bytes=whole)) == expected
    write("d/b.csv", "answer,question\nA,Q\n")
    write("d/c.csv", '"question\n"\n')
    assert pairs(load(spark, path.rsplit("/", 1)[0], whole_file_bytes=whole)) == expected + [("Q", "A")]


@pytest.mark.parametrize("whole", [10**9, 0])
def test_first_element_beyond_a_split(spark, write, splits, whole):
    items = [{"instruction": "i" * 900 + "{}[", "output": "o"}, {"instruction": "j", "output": "p"}]
    path = write("a.json", json.dumps(items))
    assert detect_format(spark, path) == ("array", "alpaca")
    assert [r["format"] for r in detect_formats(spark, path, whole_file_bytes=whole).collect()] == ["alpaca"]
    assert pairs(load(spark, path, whole_file_bytes=whole)) == [(items[0]["instruction"], "o"), ("j", "p")]


@pytest.mark.parametrize("whole", [10**9, 0])
def test_folder_of_arrays_and_lines(spark, write, whole):
    write("d/a.jsonl", '{"messages": [{"role": "user", "content": "l"}]}\n')
    write("d/b.json", '[{"messages": [{"role": "user", "content": "x"}]},\n {"messages": [{"role": "user", "content": "y"}]}]')
    path = write("d/c.json", '{"messages": [{"role": "user", "content": "z"}]}\n\n{"messages": [{"role": "user", "content": "w"}]}\n')
    assert turns(load(spark, path.rsplit("/", 1)[0], whole_file_bytes=whole)) == [[("user", c)] for c in "xyzw"]
